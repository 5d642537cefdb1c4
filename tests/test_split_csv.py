"""Multi-line CSV cut at every place gives the rows of the one-task reader."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricefold.sources import catalog_io as IO
from pricefold.sources import split_csv as SC

ROWS = ['id,text,price', '1,plain,2.5', '2,"a ""quoted"" one",3', '3,"two\nlines, and ""q""\n",4', '', '4,,5', '5,"",6', '6,12" pipe,7',
        '7,"""",8', '8,"\n\n\n""\n",', '9,é"x"y,"1\n"']


@pytest.fixture
def cut(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def to(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")
    yield to
    for k in keys:
        spark.conf.unset(k)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("csv")
    (d / "a.csv").write_bytes("\n".join(ROWS + [""]).encode())
    (d / "b.csv").write_bytes("\r\n".join(r.replace("\n", "\r\n") for r in ROWS).encode())
    return str(d)


@pytest.mark.parametrize("size, broadcast_blocks", [(1 << 20, 9), (37, 9), (9, 0)])
def test_rows_are_those_of_the_one_task_reader(spark, cut, folder, size, broadcast_blocks):
    whole = IO.read_catalog_csv_whole(spark, folder)
    want = sorted(map(repr, whole.collect()))
    cut(size)
    out = SC.read_split_csv(spark, folder, whole.schema, IO.CSV_OPTIONS, broadcast_blocks)
    assert sorted(map(repr, out.collect())) == want


def test_tasks_follow_the_file_size(spark, cut, tmp_path):
    text = "".join('%d,"line one\nline ""two""\n%s",1.5\n' % (i, "x" * (i % 90)) for i in range(3000))
    (tmp_path / "big.csv").write_text("sample_id,catalog_content,price\n" + text)
    cut(16_000)
    out = IO.read_catalog_csv(spark, str(tmp_path))
    assert out.count() == 3000 and out.select(F.countDistinct("sample_id")).first()[0] == 3000
    assert out.rdd.getNumPartitions() >= len(text) // 16_000


def _plain(text: bytes, inside: bool) -> bool:
    """Mark by mark: a quote at a value's start opens it, a lone quote closes it."""
    state = "in" if inside else "start"
    for c in text.decode("latin-1"):
        if state == "in":
            state = "quote" if c == '"' else "in"
        elif state == "quote":
            state = "in" if c == '"' else "start" if c == "," else "out"
        elif c == ",":
            state = "start"
        else:
            state = "in" if state == "start" and c == '"' else "out"
    return state == "in"


@settings(max_examples=500, deadline=None)
@given(st.text('",a', max_size=14), st.booleans())
def test_state_after_a_line(text, inside):
    assert SC.ends_inside(text.encode(), inside) == _plain(text.encode(), inside)
