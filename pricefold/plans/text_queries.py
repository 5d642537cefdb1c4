"""Catalog text queries (TXT-*, FLT-1, SCH-5/6/7) over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import units as U
from ..operators import quality as Q
from ..sources import tables as S
from . import duck as D
from .registry import query


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ flagship
@query("catalog_quantity_by_unit", "TXT-5 TXT-6 TXT-8 TXT-9 MTH-1", oracle=f"""
WITH {D.parsed_cte()}
SELECT parsed_unit, count(*) AS n_rows,
       round(sum(parsed_total_weight_g), 6) AS total_weight_g,
       round(sum(parsed_total_volume_ml), 6) AS total_volume_ml,
       round(sum(parsed_total_count_units), 6) AS total_count_units,
       round(sum(parsed_quantity_mentions), 6) AS mentions,
       round(sum(parsed_ounces), 6) AS ounces,
       round(avg(parsed_value_log1p), 6) AS avg_value_log1p,
       round(avg(parsed_weight_log1p), 6) AS avg_weight_log1p,
       round(avg(ln(1 + greatest(price, 0))), 6) AS avg_price_log1p
FROM parsed GROUP BY parsed_unit
""")
def catalog_quantity_by_unit(spark, sf_dir):
    parsed = T.add_parsed_features(S.catalog(spark, sf_dir))
    return parsed.groupBy("parsed_unit").agg(
        F.count(F.lit(1)).alias("n_rows"),
        r6(F.sum("parsed_total_weight_g")).alias("total_weight_g"),
        r6(F.sum("parsed_total_volume_ml")).alias("total_volume_ml"),
        r6(F.sum("parsed_total_count_units")).alias("total_count_units"),
        r6(F.sum("parsed_quantity_mentions")).alias("mentions"),
        r6(F.sum("parsed_ounces")).alias("ounces"),
        r6(F.avg("parsed_value_log1p")).alias("avg_value_log1p"),
        r6(F.avg("parsed_weight_log1p")).alias("avg_weight_log1p"),
        r6(F.avg(F.log1p(F.greatest(F.col("price"), F.lit(0.0))))).alias("avg_price_log1p"))


@query("catalog_parsed_features", "TXT-4 TXT-5 TXT-6 TXT-7 TXT-8 TXT-9", oracle=f"""
WITH {D.parsed_cte()}
SELECT sample_id, catalog_content_clean_len, round(parsed_ounces, 6) AS parsed_ounces,
       round(parsed_value, 6) AS parsed_value, parsed_unit,
       round(parsed_total_weight_g, 6) AS parsed_total_weight_g,
       round(parsed_total_volume_ml, 6) AS parsed_total_volume_ml,
       round(parsed_total_count_units, 6) AS parsed_total_count_units,
       parsed_quantity_mentions, parsed_has_quantity,
       round(parsed_value_log1p, 6) AS parsed_value_log1p, round(parsed_weight_log1p, 6) AS parsed_weight_log1p,
       round(parsed_volume_log1p, 6) AS parsed_volume_log1p, round(parsed_count_log1p, 6) AS parsed_count_log1p
FROM parsed
""")
def catalog_parsed_features(spark, sf_dir):
    p = T.add_parsed_features(S.catalog(spark, sf_dir))
    dbl = ["parsed_ounces", "parsed_value", "parsed_total_weight_g", "parsed_total_volume_ml",
           "parsed_total_count_units", "parsed_value_log1p", "parsed_weight_log1p",
           "parsed_volume_log1p", "parsed_count_log1p"]
    return p.select("sample_id", F.col("catalog_content_clean_len").cast("long").alias("catalog_content_clean_len"),
                    "parsed_unit", "parsed_quantity_mentions", "parsed_has_quantity",
                    *[r6(F.col(c)).alias(c) for c in dbl])


_ENTRY_DUCK = """
entries AS (
  SELECT sample_id, price, catalog_content AS s,
    CASE WHEN catalog_content IS NULL THEN NULL
         WHEN regexp_matches(catalog_content, 'Item Name:\\s*(.+)')
         THEN regexp_replace(regexp_extract(catalog_content, 'Item Name:\\s*(.+)', 1), '^\\s+|\\s+$', '', 'g') END AS item_name,
    CASE WHEN catalog_content IS NULL THEN []::VARCHAR[]
         ELSE regexp_extract_all(catalog_content, 'Bullet Point\\s*\\d+:\\s*(.+)', 1) END AS bullet_points,
    CASE WHEN catalog_content IS NULL THEN NULL
         WHEN regexp_matches(catalog_content, 'Product Description:\\s*(.+)')
         THEN regexp_replace(regexp_extract(catalog_content, 'Product Description:\\s*(.+)', 1), '^\\s+|\\s+$', '', 'g') END
      AS product_description,
    CASE WHEN catalog_content IS NULL OR regexp_extract(catalog_content, 'Value:\\s*([\\d\\.]+)', 1) = '' THEN NULL
         ELSE TRY_CAST(regexp_extract(catalog_content, 'Value:\\s*([\\d\\.]+)', 1) AS DOUBLE) END AS value,
    CASE WHEN catalog_content IS NULL THEN NULL
         WHEN regexp_matches(catalog_content, 'Unit:\\s*([A-Za-z]+)')
         THEN regexp_extract(catalog_content, 'Unit:\\s*([A-Za-z]+)', 1) END AS unit
  FROM catalog)
"""


@query("catalog_entry_fields", "TXT-11 TXT-12 TXT-13 SCH-5 SCH-6 SCH-7", oracle=f"""
WITH {_ENTRY_DUCK}
SELECT sample_id, item_name, product_description, value, unit,
       array_to_string(bullet_points, '; ') AS bullet_points_str, price
FROM entries
""")
def catalog_entry_fields(spark, sf_dir):
    return T.process_catalog(S.catalog(spark, sf_dir))


def _duck_normalize_unit(e: str) -> str:
    u = f"regexp_replace(lower(regexp_replace({e}, '^\\s+|\\s+$', '', 'g')), '[^a-z0-9 ]+', '', 'g')"
    whens = " ".join(f"WHEN contains({u}, {D.q(k)}) THEN {D.q(v)}" for k, v in U.UNIT_VARIANTS)
    blanks = ", ".join(D.q(b) for b in U.BLANK_UNITS)
    return (f"CASE WHEN {e} IS NULL OR regexp_replace({e}, '^\\s+|\\s+$', '', 'g') = '' OR lower({e}) IN ({blanks}) "
            f"THEN 'unknown' {whens} WHEN regexp_full_match({u}, '\\d+') THEN 'count' ELSE 'unknown' END")


def _duck_convert(v: str, u: str) -> tuple[str, str]:
    fw = " ".join(f"WHEN {D.q(n)} THEN {f!r}" for n, f, _ in U.BASE_CONVERSIONS)
    bw = " ".join(f"WHEN {D.q(n)} THEN {D.q(b)}" for n, _, b in U.BASE_CONVERSIONS)
    uu = f"lower(regexp_replace({u}, '^\\s+|\\s+$', '', 'g'))"
    val = f"CASE WHEN {v} IS NULL THEN 'NaN'::DOUBLE ELSE {v} * (CASE {uu} {fw} ELSE 1.0 END) END"
    base = f"CASE WHEN {v} IS NULL THEN 'unknown' ELSE (CASE {uu} {bw} ELSE 'unknown' END) END"
    return val, base


_CV, _CB = _duck_convert("value", "unit_clean")


@query("catalog_unit_normalised", "TXT-11 TXT-14 TXT-15 TXT-16", oracle=f"""
WITH {_ENTRY_DUCK}, n AS (SELECT sample_id, value, unit, {_duck_normalize_unit('unit')} AS unit_clean FROM entries),
c AS (SELECT sample_id, unit, unit_clean, {_CV} AS v, {_CB} AS base_unit FROM n)
SELECT sample_id, unit, unit_clean, round(v, 6) AS value_converted, base_unit,
       (CASE WHEN isnan(v) THEN 'nan' ELSE CAST(v AS VARCHAR) END) || ' ' || base_unit AS measure_text
FROM c
""")
def catalog_unit_normalised(spark, sf_dir):
    e = T.parse_catalog_entries(S.catalog(spark, sf_dir))
    n = e.select("sample_id", "value", "unit", U.normalize_unit(F.col("unit")).alias("unit_clean"))
    c = n.select("sample_id", "unit", "unit_clean", U.convert_to_base(F.col("value"), F.col("unit_clean")).alias("cv"))
    return c.select("sample_id", "unit", "unit_clean", r6(F.col("cv.value_converted")).alias("value_converted"),
                    F.col("cv.base_unit").alias("base_unit"), U.measure_text(F.col("cv")).alias("measure_text"))


_SPELLINGS = ["Liter", " fl oz ", "Fl. Oz.", "ft", "feet", "inches", "in", "sq ft", "packs", "Box of 2", "lbs", "Kg", "grams",
              "each", "12", "", "none", "Ounces", "ML", "can", "K-Cups", "wishes?", "---", "ounce (oz)"]
_SPELLED = f"""
sp AS (SELECT sample_id, list_extract({[*_SPELLINGS]!r}, CAST(sample_id % {len(_SPELLINGS)} + 1 AS BIGINT)) AS unit,
              CASE sample_id % 5 WHEN 0 THEN price * 1000000 WHEN 1 THEN price / 10000000 WHEN 2 THEN NULL ELSE price END AS value FROM catalog)
"""


@query("unit_spellings_normalised", "TXT-14 TXT-15 TXT-16", oracle=f"""
WITH {_SPELLED}, n AS (SELECT sample_id, value, unit, {_duck_normalize_unit('unit')} AS unit_clean FROM sp),
c AS (SELECT sample_id, unit_clean, {_CV} AS v, {_CB} AS base_unit FROM n)
SELECT sample_id, unit_clean, base_unit, (CASE WHEN isnan(v) THEN 'nan' ELSE CAST(v AS VARCHAR) END) || ' ' || base_unit AS measure_text
FROM c
""")
def unit_spellings_normalised(spark, sf_dir):
    """Spellings that reach every base unit, with values that are absent, very large and very small."""
    i, price = F.col("sample_id"), F.col("price")
    t = S.catalog(spark, sf_dir).select(
        "sample_id", F.element_at(F.array(*[F.lit(x) for x in _SPELLINGS]), (i % len(_SPELLINGS) + 1).cast("int")).alias("unit"),
        F.when(i % 5 == 0, price * 1000000).when(i % 5 == 1, price / 10000000).when(i % 5 == 2, None).otherwise(price).alias("value"))
    n = t.select("sample_id", "value", U.normalize_unit(F.col("unit")).alias("unit_clean"))
    c = n.select("sample_id", "unit_clean", U.convert_to_base(F.col("value"), F.col("unit_clean")).alias("cv"))
    return c.select("sample_id", "unit_clean", F.col("cv.base_unit").alias("base_unit"), U.measure_text(F.col("cv")).alias("measure_text"))


@query("catalog_unit_mix", "TXT-14 TXT-15", oracle=f"""
WITH {_ENTRY_DUCK}, n AS (SELECT sample_id, value, unit, {_duck_normalize_unit('unit')} AS unit_clean FROM entries),
c AS (SELECT unit_clean, {_CB} AS base_unit, {_CV} AS value_converted FROM n)
SELECT unit_clean, base_unit, count(*) AS n_rows,
       round(sum(CASE WHEN isnan(value_converted) THEN 0 ELSE value_converted END), 6) AS total_converted
FROM c GROUP BY unit_clean, base_unit
""")
def catalog_unit_mix(spark, sf_dir):
    e = T.parse_catalog_entries(S.catalog(spark, sf_dir))
    n = e.select("value", U.normalize_unit(F.col("unit")).alias("unit_clean"))  # normalised once
    c = n.select("unit_clean", U.convert_to_base(F.col("value"), F.col("unit_clean")).alias("cv"))
    return c.groupBy("unit_clean", F.col("cv.base_unit").alias("base_unit")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        r6(F.sum(F.when(F.isnan("cv.value_converted"), 0.0).otherwise(F.col("cv.value_converted"))))
        .alias("total_converted"))


@query("documents_basic_clean", "TXT-1", oracle=f"""
SELECT doc_id, {D.basic_clean('text')} AS clean_text FROM documents
""")
def documents_basic_clean(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.basic_clean(F.col("text")).alias("clean_text"))


@query("documents_text_stats", "TXT-2 TXT-3 TXT-4", oracle=f"""
WITH c AS (SELECT doc_id, text, {D.embed_clean('text')} AS t FROM documents)
SELECT doc_id, length(coalesce(text, '')) AS text_clean_len, {D.word_count('t')} AS doc_num_words,
       length(t) AS doc_num_chars, {D.sentence_count('t')} AS doc_num_sentences,
       md5(t) AS clean_md5
FROM c
""")
def documents_text_stats(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    c = d.select("doc_id", "text", T.embed_clean(F.col("text")).alias("t"))
    out = c.select("doc_id", F.length(T.text_or_empty(F.col("text"))).alias("text_clean_len"),
                   *T.text_stats(F.col("t"), "doc"), F.md5("t").alias("clean_md5"))
    return out.select(*[F.col(x).cast("long").alias(x) if x not in ("doc_id", "clean_md5") else F.col(x)
                        for x in out.columns])


@query("pages_tag_strip", "TXT-1", oracle=f"""
SELECT page_id, length({D.basic_clean('html')}) AS clean_chars, md5({D.basic_clean('html')}) AS clean_md5 FROM pages
""")
def pages_tag_strip(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages")
    c = p.select("page_id", T.basic_clean(F.col("html")).alias("t"))
    return c.select("page_id", F.length("t").cast("long").alias("clean_chars"), F.md5("t").alias("clean_md5"))


@query("catalog_blank_text", "FLT-1 FLT-2", oracle="""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE trim(coalesce(catalog_content, '')) = '') AS blank_text_rows,
       count(*) FILTER (WHERE image_link IS NULL OR trim(image_link) = '') AS image_fallback_rows,
       count(*) FILTER (WHERE catalog_content IS NULL OR trim(catalog_content) = '') AS text_fallback_rows,
       count(*) AS absent_fallback_rows
FROM catalog
""")
def catalog_blank_text(spark, sf_dir):
    c = S.catalog(spark, sf_dir)
    flag = lambda col: F.count_if(Q.needs_fallback(c, col))                                     # noqa: E731
    return c.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.trim(F.coalesce(F.col("catalog_content"), F.lit(""))) == "").alias("blank_text_rows"),
                 flag("image_link").alias("image_fallback_rows"), flag("catalog_content").alias("text_fallback_rows"),
                 flag("no_such_column").alias("absent_fallback_rows"))


@query("documents_char_drop", "TXT-17", oracle="""
WITH c AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS chars FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(chars, lambda ch, i:
         CAST(('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(i - 1 AS VARCHAR), '42')), 1, 8)) AS BIGINT)
         / 4294967296.0 >= 0.1), '')) AS noisy_md5
FROM c
""")
def documents_char_drop(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.char_drop(F.col("text"), F.col("doc_id"), 0.1, seed=42)).alias("noisy_md5"))
