"""TXT-10 and TXT-11 on entries whose fields are written out here."""

import pytest

from pricefold.functions import text as T

FULL = ("Item Name: Green Tea\nBullet Point 1: Fresh leaf\nBullet Point 2: 20 bags\n"
        "Product Description: Best <b>Origin</b><p>Uji<p/> <b>Use</b> Brew\nValue: 20.0\nUnit: Count\n")

CASES = [
    (None, None),
    ("plain words", (None, None, None, None, None)),
    (FULL, ("Green Tea", ["Fresh leaf", "20 bags"], "Best\n\n**Origin:** Uji\n\n**Use:** Brew", "20.0", "Count")),
    # the item's line must end
    ("Item Name: Tea", (None, None, None, None, None)),
    # only \\n ends a line
    ("Item Name: Tea\r\nValue: 3\r\nUnit: g\r\n", ("Tea", None, None, "3", "g")),
    # a bullet's own "Value: " is taken out with the bullet
    ("Bullet Point 1: a Value: 9\nValue: 2.0\nUnit: kg\n", (None, ["a Value: 9"], None, "2.0", "kg")),
    ("Bullet Point 1: see Product Description: none\nProduct Description: real\n",
     (None, ["see Product Description: none"], "real", None, None)),
    # numbered otherwise than by place: the bullet stays in the text and is read again
    ("Bullet Point 7: a Value: 9\nValue: 2.0\n", (None, ["a Value: 9"], None, "9", None)),
    # equal bullets both count under the first one's number
    ("Bullet Point 1: x\nBullet Point 1: x\nUnit: oz\n", (None, ["x", "x"], None, None, "oz")),
    # a title seen twice keeps its place and its last text
    ("Product Description: <b>A</b>1<b>B</b>2<b>A</b>3\nValue: 1\n", (None, None, "**A:** 3\n\n**B:** 2", "1", None)),
    ("Product Description: two\nlines <b>\nUnit: ml", (None, None, "two\nlines", None, "ml")),
]


@pytest.mark.parametrize("text,want", CASES, ids=range(len(CASES)))
def test_fields(spark, text, want):
    df = spark.createDataFrame([(text,)], "catalog_content string")
    got = T.extract_catalog_fields(df).first()["fields"]
    if want is None:
        assert got is None
        return
    assert (got["item_name"], got["bullet_points"], got["product_description"], got["value"], got["unit"]) == want


def test_entry_fields_with_other_line_ends(spark):
    df = spark.createDataFrame([("Item Name: Tea \r\nBullet Point 1: x\r\nUnit: Fl Oz\r\nValue: 1.5\r\n",),
                                ("Value: 1.2.3\nItem Name:\n\nNext",)], "catalog_content string")
    a, b = T.parse_catalog_entries(df).collect()
    assert (a.item_name, a.unit, a.value) == ("Tea", "Fl", 1.5)
    assert b.value is None and b.item_name == "Next"
