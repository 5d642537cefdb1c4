"""Schema aliases, loaders and payload guards."""

import pytest
from pyspark.sql import functions as F

from pricefold.session import scratch_dir
from pricefold.sources import catalog_io as IO


def test_resolve_column_name():
    cols = ["unique_identifier", "Description", "Description_clean_len", "Price"]
    assert IO.resolve_column_name(cols, "sample_id") == "unique_identifier"
    assert IO.resolve_column_name(cols, "catalog_content_clean_len") == "Description_clean_len"
    assert IO.resolve_column_name(cols, "price") == "Price"
    assert IO.resolve_column_name(cols, "other") == "other"


def test_required_columns_count_under_any_spelling():
    assert IO.missing_required_columns(["unique_identifier", "Description"], ["sample_id", "catalog_content", "price"]) == ["price"]


def test_aliases_do_not_replace_a_present_name(spark):
    df = spark.createDataFrame([(1, 2.0, "t")], "sample_id long, unique_identifier double, Description string")
    out, renames = IO.normalize_to_train_schema(df)
    assert out.columns == ["sample_id", "unique_identifier", "catalog_content"] and renames == {"Description": "catalog_content"}


def test_missing_required_column_raises(spark):
    df = spark.createDataFrame([(1, "x")], "unique_identifier long, Description string")
    path = scratch_dir(spark, "t-csv")
    IO.write_csv(df, path)
    with pytest.raises(ValueError):
        IO.load_train_df(spark, path)
    t = IO.load_catalog(spark, path, ["sample_id", "catalog_content"])
    assert t.columns == ["sample_id", "catalog_content"]


def test_missing_latency_log_is_empty(spark):
    df = IO.load_latency_events(spark, scratch_dir(spark, "nope") + "/absent.jsonl")
    assert df.count() == 0 and "seconds_per_row" in df.columns


def test_payload_over_limit_rejected(spark):
    small = '{"records": [' + ",".join('{"sample_id": %d}' % i for i in range(3)) + "]}"
    big = '{"records": [' + ",".join('{"sample_id": %d}' % i for i in range(201)) + "]}"
    bad = [(3, "{broken"), (4, None), (5, '{"records": 7}'), (6, '{"records": []}')]
    df = spark.createDataFrame([(1, small), (2, big), *bad], "req long, body string")
    status = {r.req: r.status for r in IO.payload_status(df).collect()}
    assert status == {1: "accepted", 2: "too_many_records:201>200", 3: "malformed", 4: "malformed", 5: "malformed", 6: "accepted"}
    out = IO.records_to_table(df)
    assert out.count() == 3 and out.select(F.countDistinct("req")).first()[0] == 1


def test_flatten(spark):
    df = spark.createDataFrame([(1, (2, [3, 4]))], "a long, s struct<b:long, c:array<long>>")
    out = IO.flatten(df)
    assert out.columns == ["a", "s.b", "s.c"] and out.first()["s.c"] == "3,4"
