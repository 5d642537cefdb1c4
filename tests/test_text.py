"""Catalog text operators: literal rows from the reference's tests and unit quirks."""

import math

from pyspark.sql import functions as F

from pricefold.functions import text as T
from pricefold.functions import units as U


def _one(spark, col_fn, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(col_fn(F.col("t")).alias("r")).first()["r"]


def test_parser_rows(spark):
    rows = [("Protein powder 2 lb + 16 oz value pack",), ("Shampoo 500 ml pack of 2",), ("No quantity mentioned",)]
    df = T.add_parsed_features(spark.createDataFrame(rows, "catalog_content string"))
    got = {r["catalog_content"]: r for r in df.collect()}
    a = got["Protein powder 2 lb + 16 oz value pack"]
    assert a["parsed_total_weight_g"] > 1000
    assert math.isclose(a["parsed_total_weight_g"], 2 * 453.59237 + 16 * 28.349523125)
    assert a["parsed_ounces"] == 16.0
    b = got["Shampoo 500 ml pack of 2"]
    assert b["parsed_total_volume_ml"] == 500.0
    assert b["parsed_total_count_units"] >= 2
    assert (b["parsed_value"], b["parsed_unit"]) == (500.0, "ml")
    c = got["No quantity mentioned"]
    assert c["parsed_has_quantity"] == 0.0 and c["parsed_quantity_mentions"] == 0.0
    assert (c["parsed_value"], c["parsed_unit"]) == (0.0, "")


def test_value_unit_without_known_unit(spark):
    r = _one(spark, T.parse_value_unit, "500 grams of rice")
    assert (r["value"], r["unit"]) == (500.0, "")


def test_parse_ounces(spark):
    assert _one(spark, T.parse_ounces, "12 fl oz bottle") == 0.0
    assert _one(spark, T.parse_ounces, "7oz and 2.5 OZ") == 9.5


def test_unit_normalisation_quirks(spark):
    cases = {"kg": "g", "bag": "g", "milliliter": "l", "l": "unknown", "fl.oz": "oz", "Fl Oz": "floz",
             "24": "count", None: "unknown", "---": "unknown", "Ounce": "oz", "Count": "count", "tin": "inch"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r["u"]: r["n"] for r in df.select("u", U.normalize_unit(F.col("u")).alias("n")).collect()}
    assert got == cases


def test_convert_to_base(spark):
    df = spark.createDataFrame([("2", "lb"), ("x", "oz"), ("5", "kg"), ("3", "floz")], "v string, u string")
    rows = df.select(U.convert_to_base(F.col("v"), F.col("u")).alias("c")).collect()
    assert math.isclose(rows[0]["c"]["value_converted"], 907.184) and rows[0]["c"]["base_unit"] == "g"
    assert math.isnan(rows[1]["c"]["value_converted"]) and rows[1]["c"]["base_unit"] == "unknown"
    assert (rows[2]["c"]["value_converted"], rows[2]["c"]["base_unit"]) == (5.0, "unknown")
    assert math.isclose(rows[3]["c"]["value_converted"], 3 * 29.5735) and rows[3]["c"]["base_unit"] == "ml"


def test_cleaners_and_stats(spark):
    assert _one(spark, T.basic_clean, "  <b>Hello</b>\n World!! 50%  ") == "hello world 50%"
    assert _one(spark, T.basic_clean, None) == ""
    assert _one(spark, T.embed_clean, "12 OZ Pack of 3 (new)") == "12 ounce pack_of 3 new"
    df = spark.createDataFrame([("a b. c;",), ("",)], "t string")
    st = df.select(*T.text_stats(F.col("t"), "x")).collect()
    assert (st[0]["x_num_words"], st[0]["x_num_chars"], st[0]["x_num_sentences"]) == (3, 7, 3)
    assert st[1]["x_num_sentences"] == 0


def test_catalog_entry_parse(spark):
    text = ("Item Name: Wireless Mouse\nBullet Point 1: Ergonomic Design\nBullet Point 2: 2.4GHz Wireless\n"
            "Product Description: A comfortable mouse.\nValue: 85\nUnit: grams")
    df = spark.createDataFrame([(1, text, "l", 9.5), (2, None, "", 1.0), (3, "Value: 1.2.3", "", 2.0)],
                               "sample_id long, catalog_content string, image_link string, price double")
    out = {r["sample_id"]: r for r in T.process_catalog(df).collect()}
    assert T.process_catalog(df).columns == ["sample_id", "item_name", "product_description", "value", "unit",
                                             "bullet_points_str", "price"]
    assert out[1]["item_name"] == "Wireless Mouse" and out[1]["value"] == 85.0 and out[1]["unit"] == "grams"
    assert out[1]["bullet_points_str"] == "Ergonomic Design; 2.4GHz Wireless"
    assert out[2]["item_name"] is None and out[2]["bullet_points_str"] == ""
    assert out[3]["value"] is None  # malformed number -> null, not an error


def test_number_text_as_python_writes_it(spark):
    values = [0.0, 1.0, -2.5, 85.0, 1e7, 12345678.9, 9.99e15, 1e16, 1.5e17, 0.001, 0.00012345, 1e-4, 5e-05, -1.25e-7, 1e100, float("nan"), float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.t for r in df.select("i", U.number_text(F.col("v")).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [str(v) for v in values]


def test_fallback_rows_without_the_column(spark):
    from pricefold.operators import quality as Q
    df = spark.createDataFrame([(None,), (" ",), ("x",)], "t string")
    assert df.where(Q.needs_fallback(df, "t")).count() == 2 and df.where(Q.needs_fallback(df, "absent")).count() == 3
