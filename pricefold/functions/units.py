"""Unit rules and unit normalisation (TXT-6 rules, TXT-14, TXT-15, TXT-16).

The rule tables are small literals; they are applied as ``CASE`` / map
expressions, so a lookup is a JVM-side expression, never a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's): quantity unit -> (bucket, scale).
# ---------------------------------------------------------------------------
QUANTITY_UNIT_RULES = {
    "mg": ("weight_g", 0.001),
    "milligram": ("weight_g", 0.001),
    "milligrams": ("weight_g", 0.001),
    "g": ("weight_g", 1.0),
    "gram": ("weight_g", 1.0),
    "grams": ("weight_g", 1.0),
    "kg": ("weight_g", 1000.0),
    "kilogram": ("weight_g", 1000.0),
    "kilograms": ("weight_g", 1000.0),
    "oz": ("weight_g", 28.349523125),
    "ounce": ("weight_g", 28.349523125),
    "ounces": ("weight_g", 28.349523125),
    "lb": ("weight_g", 453.59237),
    "lbs": ("weight_g", 453.59237),
    "pound": ("weight_g", 453.59237),
    "pounds": ("weight_g", 453.59237),
    "ml": ("volume_ml", 1.0),
    "milliliter": ("volume_ml", 1.0),
    "milliliters": ("volume_ml", 1.0),
    "l": ("volume_ml", 1000.0),
    "liter": ("volume_ml", 1000.0),
    "liters": ("volume_ml", 1000.0),
    "fl oz": ("volume_ml", 29.5735295625),
    "floz": ("volume_ml", 29.5735295625),
    "ct": ("count_units", 1.0),
    "count": ("count_units", 1.0),
    "pcs": ("count_units", 1.0),
    "pc": ("count_units", 1.0),
    "piece": ("count_units", 1.0),
    "pieces": ("count_units", 1.0),
    "pack": ("count_units", 1.0),
    "packs": ("count_units", 1.0),
    "serving": ("count_units", 1.0),
    "servings": ("count_units", 1.0),
    "bar": ("count_units", 1.0),
    "bars": ("count_units", 1.0),
}

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's): unit text variant -> normal unit.
# Order matters: the first variant contained in the cleaned text wins.
# ---------------------------------------------------------------------------
UNIT_VARIANTS = [
    ("fl oz", "floz"), ("fluid ounce", "floz"), ("fluid ounces", "floz"), ("fl.oz", "floz"),
    ("fl oz.", "floz"), ("fl ounce", "floz"), ("fluidounce", "floz"),
    ("ltr", "l"), ("liter", "l"), ("liters", "l"), ("litre", "l"), ("litres", "l"),
    ("milliliter", "ml"), ("millilitre", "ml"), ("mililitro", "ml"), ("ml", "ml"),
    ("oz", "oz"), ("ounce", "oz"), ("ounces", "oz"),
    ("gram", "g"), ("grams", "g"), ("gramm", "g"), ("gr", "g"), ("g", "g"), ("kg", "kg"),
    ("pound", "lb"), ("pounds", "lb"), ("lb", "lb"), ("lbs", "lb"),
    ("count", "count"), ("ct", "count"), ("each", "count"), ("piece", "count"), ("pieces", "count"),
    ("unit", "count"), ("units", "count"), ("bottle", "count"), ("bottles", "count"), ("jar", "count"),
    ("can", "count"), ("cans", "count"), ("capsule", "count"), ("bag", "count"), ("bags", "count"),
    ("pouch", "count"),
    ("pack", "pack"), ("packs", "pack"), ("box", "pack"), ("boxes", "pack"), ("carton", "pack"),
    ("bucket", "pack"), ("k-cups", "pack"), ("per box", "pack"), ("per package", "pack"),
    ("per carton", "pack"), ("box/12", "pack"),
    ("sq ft", "sqft"), ("foot", "ft"), ("ft", "ft"), ("in", "inch"),
]
# unit words that mean "no unit"
BLANK_UNITS = ["none", "---", "-", "product_weight"]
# normal unit -> (factor, base unit)
BASE_CONVERSIONS = [
    ("floz", 29.5735, "ml"), ("ml", 1.0, "ml"), ("l", 1000.0, "ml"),
    ("oz", 28.3495, "g"), ("lb", 453.592, "g"), ("g", 1.0, "g"),
    ("inch", 1.0, "inch"), ("ft", 12.0, "inch"), ("sqft", 1.0, "sqft"),
    ("count", 1.0, "count"), ("pack", 1.0, "pack"), ("unknown", 1.0, "unknown"),
]


def normalize_unit(c: Column) -> Column:
    """TXT-14: free unit text -> normal unit; ``unknown`` when nothing fits."""
    raw = c.cast("string")
    u = F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"[^a-z0-9 ]+", "")
    # one constant array; the first variant (in list order) contained in u wins
    variants = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in UNIT_VARIANTS])
    hits = F.filter(variants, lambda x: F.contains(u, x["k"]))
    matched = F.when(F.size(hits) > 0, F.element_at(hits, 1)["v"]) \
               .when(u.rlike(r"^\d+$"), F.lit("count")).otherwise(F.lit("unknown"))
    blank = raw.isNull() | (F.regexp_replace(raw, r"^\s+|\s+$", "") == "") | F.lower(raw).isin(BLANK_UNITS)
    return F.when(blank, F.lit("unknown")).otherwise(matched)


def convert_to_base(value: Column, unit: Column) -> Column:
    """TXT-15: STRUCT<value_converted DOUBLE, base_unit STRING>.  A value that is
    not a number gives (NaN, unknown); an unlisted unit keeps the value as unknown."""
    v = value.cast("string").try_cast("double")
    u = F.lower(F.regexp_replace(unit.cast("string"), r"^\s+|\s+$", ""))
    # two constant maps: the unit text is read twice, not once per rule branch
    factors = F.create_map(*[x for name, f, _ in BASE_CONVERSIONS for x in (F.lit(name), F.lit(f))])
    bases = F.create_map(*[x for name, _, b in BASE_CONVERSIONS for x in (F.lit(name), F.lit(b))])
    factor = F.coalesce(F.try_element_at(factors, u), F.lit(1.0))
    base = F.coalesce(F.try_element_at(bases, u), F.lit("unknown"))
    return F.when(v.isNull(), F.struct(F.lit(float("nan")).alias("value_converted"),
                                       F.lit("unknown").alias("base_unit"))) \
            .otherwise(F.struct((v * factor).alias("value_converted"), base.alias("base_unit")))


def number_text(v: Column) -> Column:
    """A double as Python's ``str`` writes it: shortest digits, plain from 1e-4 up to 1e16, else ``1e+16``, ``5e-05``."""
    s, size = v.cast("string"), F.abs(v)
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"),
                        F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return (F.when(F.isnan(v), "nan").when(size == float("inf"), F.when(v > 0, "inf").otherwise("-inf"))
            .when(~s.contains("E"), s).when((size >= 1e-4) & (size < 1e16), plain).otherwise(exponent))


def measure_text(converted: Column) -> Column:
    """TXT-16: "<value> <base unit>"."""
    return F.concat_ws(" ", number_text(converted["value_converted"]), converted["base_unit"])
