import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pricefold.session import get_spark
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    return get_spark("local[2]", app="pricefold-llm-tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with extra columns whose names clash with inner ones."""
    def make(rows):
        full = [(i, t, "en", "s", None, 7, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, h long, _id int, score string") \
            .repartition(3)
    return make
