"""The entry module must load when PySpark comes from its zip (no jars folder beside it)."""

import glob
import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_load_with_pyspark_from_zip():
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    site = os.path.dirname(os.path.dirname(pyspark.__file__))
    path = os.pathsep.join([os.path.join(lib, "pyspark.zip"), *glob.glob(os.path.join(lib, "py4j*.zip")), ROOT])
    code = (f"import sys; sys.path.append({site!r}); import pyspark, __spark_entry__ as e; "
            "assert '.zip' in pyspark.__file__; print(len(e.queries()), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-S", "-c", code], env={**os.environ, "PYTHONPATH": path},
                         capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n_queries, n_twins = map(int, out.stdout.split())
    assert n_queries >= n_twins > 60


def test_scratch_folder_is_refused_off_local():
    import pytest

    from pricefold.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
