"""Catalog text operators as Spark column expressions (TXT-1 .. TXT-13, TXT-17).

All functions take and return ``Column`` objects built from JVM-side built-ins
(``regexp_*``, higher-order array functions), so they stay inside whole-stage
codegen; only TXT-17's md5 draws run in Python, over arrays of many characters.

Regex dialect: Java.  ``\\d``, ``\\s``, ``\\w`` and ``\\b`` are ASCII classes
(the reference's Python ``re`` uses Unicode classes); inputs here are ASCII for
the quantity grammar, and all cleaning rules replace non-ASCII letters anyway.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import QUANTITY_UNIT_RULES

# ---------------------------------------------------------------------------
# Patterns that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
# number followed by a unit, case-insensitive
QUANTITY_PATTERN = (r"(?i)(\d+(?:\.\d+)?)\s*(fl\s*oz|floz|mg|g|kg|oz|ounce|ounces|lb|lbs|pound|pounds|ml|l|"
                    r"liter|liters|milliliter|milliliters|ct|count|pcs|pc|piece|pieces|pack|packs|serving|"
                    r"servings|bar|bars)\b")
# count word followed by a number ("pack of 2")
UNIT_FIRST_PATTERN = (r"(?i)(pack|packs|ct|count|pcs|pc|piece|pieces|serving|servings|bar|bars)\s*(?:of\s*)?"
                      r"(\d+(?:\.\d+)?)\b")
OUNCE_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*oz\b"
VALUE_UNIT_PATTERN = (r"(?i)(\d+(?:\.\d+)?)[\s\-]*(mg|g|kg|oz|ml|l|pack|count|ct|bars|pcs|pieces|servings|ounce|"
                      r"pound|lb|ozs)?\b")
# TextCleaner.basic: characters kept
BASIC_KEEP = r"[^0-9a-zA-Z\.\,\-\s\%\/]"
# clean_text (embedding variant): characters kept
V2_KEEP = r"[^a-z0-9\s\.\-\/%]"
TAG = r"<[^>]*>"
SECTION_TAG = r"<[pb/]*>"
# catalog entry, one line per field ((?d): only \n ends a line, as in Python)
ENTRY_ITEM = r"(?d)Item Name:\s*(.+)"
ENTRY_BULLET = r"(?d)Bullet Point\s*\d+:\s*(.+)"
ENTRY_DESCRIPTION = r"(?d)Product Description:\s*(.+)"
ENTRY_VALUE = r"Value:\s*([\d\.]+)"
ENTRY_UNIT = r"Unit:\s*([A-Za-z]+)"
# catalog entry, fields over several lines
FIELD_ITEM = r"(?d)Item Name: (.*?)\n"
FIELD_BULLET = r"(?sd)Bullet Point \d+: (.*?)(?=\n(?:Bullet Point \d+:|Product Description:|Value:|Unit:|$))"
FIELD_DESCRIPTION = r"(?sd)Product Description: (.*?)(?=\nValue:|\nUnit:|$)"
FIELD_SECTION = r"(?sd)<b>(.*?)</b>(.*?(?=<b>|$))"
FIELD_VALUE = r"(?d)Value: (.*?)(?:\n|$)"
FIELD_UNIT = r"(?d)Unit: (.*?)(?:\n|$)"


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


# --------------------------------------------------------------- TXT-1 / TXT-2
def basic_clean(c: Column) -> Column:
    """TXT-1: whitespace folded, lower case, tags and odd punctuation to spaces."""
    s = _collapse(F.regexp_replace(_strip(text_or_empty(c)), r"[\n\r]", " "))
    s = F.lower(s)
    s = F.regexp_replace(s, TAG, " ")
    s = F.regexp_replace(s, BASIC_KEEP, " ")
    return _strip(_collapse(s))


def embed_clean(c: Column) -> Column:
    """TXT-2: lower, keep [a-z0-9 .-/%], ``oz`` -> ``ounce``, ``pack of`` -> ``pack_of``."""
    s = F.lower(text_or_empty(c))
    s = F.regexp_replace(s, V2_KEEP, " ")
    s = F.regexp_replace(s, r"\boz\b", "ounce")
    s = F.regexp_replace(s, r"\bpack of\b", "pack_of")
    return _strip(_collapse(s))


# ----------------------------------------------------------------------- TXT-3
def word_count(c: Column) -> Column:
    """``len(s.split())``: whitespace-separated non-empty pieces."""
    return F.size(F.filter(F.split(text_or_empty(c), r"\s+"), lambda x: x != ""))


def sentence_count(c: Column) -> Column:
    s = text_or_empty(c)
    n = (F.length(s) - F.length(F.regexp_replace(s, r"[;.]", ""))) + 1
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(n)


def text_stats(c: Column, prefix: str) -> list[Column]:
    return [word_count(c).alias(f"{prefix}_num_words"),
            F.length(text_or_empty(c)).alias(f"{prefix}_num_chars"),
            sentence_count(c).alias(f"{prefix}_num_sentences")]


# ----------------------------------------------------------------- TXT-5..TXT-9
def _matches(c: Column, pattern: str, value_group: int, unit_group: int) -> Column:
    s = text_or_empty(c)
    vals = F.regexp_extract_all(s, F.lit(pattern), value_group)
    units = F.regexp_extract_all(s, F.lit(pattern), unit_group)
    return F.zip_with(vals, units, lambda v, u: F.struct(
        v.cast("double").alias("value"),
        F.replace(F.lower(u), F.lit(" "), F.lit("")).alias("unit")))


def quantities(c: Column) -> Column:
    """TXT-5: ARRAY<STRUCT<value DOUBLE, unit STRING>> in match order: all
    number-unit matches, then all unit-number matches."""
    return F.concat(_matches(c, QUANTITY_PATTERN, 1, 2), _matches(c, UNIT_FIRST_PATTERN, 2, 1))


def _bucket_total(q: Column, bucket: str) -> Column:
    rules = QUANTITY_UNIT_RULES
    scale = F.create_map(*[x for unit, (b, s) in rules.items() if b == bucket
                           for x in (F.lit(unit), F.lit(s))])
    return F.aggregate(q, F.lit(0.0), lambda acc, x: acc + F.coalesce(
        x["value"] * F.try_element_at(scale, x["unit"]), F.lit(0.0)))


def parse_ounces(c: Column) -> Column:
    """TXT-7: sum of ``<n> oz`` amounts; ``12 fl oz`` is not counted (the number is not next to ``oz``)."""
    vals = F.regexp_extract_all(text_or_empty(c), F.lit(OUNCE_PATTERN), 1)
    return F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def parse_value_unit(c: Column) -> Column:
    """TXT-8: first number and optional unit, (0.0, '') when there is no number."""
    s = text_or_empty(c)
    v = F.regexp_extract(s, VALUE_UNIT_PATTERN, 1)
    u = F.regexp_extract(s, VALUE_UNIT_PATTERN, 2)
    return F.struct(F.when(v == "", F.lit(0.0)).otherwise(v.cast("double")).alias("value"),
                    F.lower(u).alias("unit"))


def _totals_from(q: Column) -> list[Column]:
    """TXT-6 totals from a quantities COLUMN (the array is read several times,
    so it must be a column reference, not the regex expression itself)."""
    n = F.size(q).cast("double")
    return [_bucket_total(q, "weight_g").alias("parsed_total_weight_g"),
            _bucket_total(q, "volume_ml").alias("parsed_total_volume_ml"),
            _bucket_total(q, "count_units").alias("parsed_total_count_units"),
            n.alias("parsed_quantity_mentions"),
            F.when(n > 0, 1.0).otherwise(0.0).alias("parsed_has_quantity")]


def add_parsed_features(df, text_col: str = "catalog_content"):
    """TXT-9: the parsed columns of ``add_parsed_features``.  Three projections:
    regex matches once per row, then totals, then the log1p columns."""
    c = F.col(text_col)
    vu = parse_value_unit(c)
    step1 = df.select("*", F.length(text_or_empty(c)).alias(f"{text_col}_clean_len"),
                      parse_ounces(c).alias("parsed_ounces"), vu.alias("_vu"), quantities(c).alias("_q"))
    step2 = step1.select(*[x for x in df.columns], f"{text_col}_clean_len", "parsed_ounces",
                         F.col("_vu.value").alias("parsed_value"), F.col("_vu.unit").alias("parsed_unit"),
                         *_totals_from(F.col("_q")))
    return step2.select(
        "*",
        F.log1p(F.coalesce(F.col("parsed_value"), F.lit(0.0))).alias("parsed_value_log1p"),
        F.log1p(F.coalesce(F.col("parsed_total_weight_g"), F.lit(0.0))).alias("parsed_weight_log1p"),
        F.log1p(F.coalesce(F.col("parsed_total_volume_ml"), F.lit(0.0))).alias("parsed_volume_log1p"),
        F.log1p(F.coalesce(F.col("parsed_total_count_units"), F.lit(0.0))).alias("parsed_count_log1p"))


# ---------------------------------------------------------------- TXT-11..13
def _first_line_field(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), _strip(F.regexp_extract(c, pattern, 1)))


def _entry_value(c: Column) -> Column:
    """Numeric ``Value`` field; text such as ``1.2.3`` gives null instead of an error."""
    txt = F.regexp_extract(c, ENTRY_VALUE, 1)
    return F.when(txt == "", F.lit(None).cast("double")).otherwise(txt.try_cast("double"))


def parse_catalog_entries(df, column_name: str = "catalog_content"):
    """TXT-11 expanded into columns (``item_name``, ``bullet_points``,
    ``product_description``, ``value``, ``unit``)."""
    s = F.col(column_name).cast("string")
    is_text = s.isNotNull()
    return df.select(
        "*",
        F.when(is_text, _first_line_field(s, ENTRY_ITEM)).alias("item_name"),
        F.when(is_text, F.regexp_extract_all(s, F.lit(ENTRY_BULLET), 1))
         .otherwise(F.array().cast("array<string>")).alias("bullet_points"),
        F.when(is_text, _first_line_field(s, ENTRY_DESCRIPTION)).alias("product_description"),
        F.when(is_text, _entry_value(s)).alias("value"),
        F.when(is_text, _first_line_field(s, ENTRY_UNIT)).alias("unit"))


def join_bullets(c: Column) -> Column:
    """TXT-12: bullets joined by '; ', empty or missing list -> ''."""
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ")


def process_catalog(df, text_col: str = "catalog_content", target: str = "price",
                    drop=("catalog_content", "image_link", "bullet_points")):
    """TXT-13: parse, join bullets, drop raw columns, move the target last."""
    out = parse_catalog_entries(df, text_col)
    out = out.withColumn("bullet_points_str", join_bullets(F.col("bullet_points")))
    out = out.drop(*[c for c in drop if c in out.columns])
    if target in out.columns:
        out = out.select(*[c for c in out.columns if c != target], target)
    return out


# ----------------------------------------------------------------------- TXT-10
def extract_catalog_fields(df, text_col: str = "catalog_content", out_col: str = "fields"):
    """TXT-10 as staged projections: every intermediate (text after the item line, text without its bullets, raw
    description, section pairs) is projected once as a column, so the later expressions read it instead of re-running
    its regexes."""
    s = F.col(text_col).cast("string")
    cols = list(df.columns)
    d1 = df.select("*", s.isNotNull().alias("_ok"), s.rlike(FIELD_ITEM).alias("_has_item"),
                   _strip(F.regexp_extract(s, FIELD_ITEM, 1)).alias("_item"),
                   F.regexp_replace(s, r"(?sd)^.*?Item Name: [^\n]*?\n", "").alias("_cut"))
    d2 = d1.select("*", F.when(F.col("_has_item"), F.col("_cut")).otherwise(s).alias("_after0"))
    d2 = d2.select("*", F.regexp_extract_all("_after0", F.lit(FIELD_BULLET), 1).alias("_b"))

    def cut(text, bullet):
        # a bullet is taken out once, under the number of the first bullet with the same text
        head = F.concat(F.lit("Bullet Point "), F.array_position("_b", bullet).cast("string"), F.lit(": "), bullet)
        at = F.instr(text, head)
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(head), F.length(text)))) \
                .otherwise(text)

    d2 = d2.select("*", F.aggregate("_b", F.col("_after0"), cut).alias("_after"))
    a = F.col("_after")
    d3 = d2.select("*", a.rlike(FIELD_DESCRIPTION).alias("_has_desc"), _strip(F.regexp_extract(a, FIELD_DESCRIPTION, 1)).alias("_draw"),
                   F.regexp_replace(a, r"(?sd)^.*?Product Description: .*?(?=\nValue:|\nUnit:|$)", "").alias("_rest0"))
    d = F.col("_draw")
    d4 = d3.select("*", F.locate("<b>", d).alias("_bold"),
                   F.when(F.col("_has_desc"), F.col("_rest0")).otherwise(a).alias("_rest"))
    bold = F.col("_bold")
    d5 = d4.select("*", F.when(bold > 0, _strip(F.substring(d, F.lit(1), bold - 1)))
                   .otherwise(_strip(F.regexp_replace(d, SECTION_TAG, ""))).alias("_init"),
                   F.when(bold > 0, d.substr(bold, F.length(d))).alias("_sec"))
    sec = F.col("_sec")
    d6 = d5.select("*", F.zip_with(
        F.transform(F.regexp_extract_all(sec, F.lit(FIELD_SECTION), 1), lambda t: _strip(F.regexp_replace(t, SECTION_TAG, ""))),
        F.transform(F.regexp_extract_all(sec, F.lit(FIELD_SECTION), 2), lambda t: _strip(F.regexp_replace(t, SECTION_TAG, ""))),
        lambda t, v: F.struct(t.alias("t"), v.alias("v"))).alias("_pairs"))
    pairs = F.col("_pairs")
    titles = F.transform(pairs, lambda p: p["t"])
    # dict semantics: a repeated title keeps its first position and its last content
    dedup = F.filter(F.transform(pairs, lambda p, i: F.struct(
        p["t"].alias("t"), F.element_at(F.filter(pairs, lambda q: q["t"] == p["t"]), -1)["v"].alias("v"),
        (F.array_position(titles, p["t"]) == i + 1).alias("first"))), lambda x: x["first"])
    lines = F.transform(dedup, lambda x: F.concat(F.lit("**"), x["t"], F.lit(":** "), x["v"], F.lit("\n\n")))
    init = F.col("_init")
    combined = F.concat(F.when(F.length(init) > 0, F.concat(init, F.lit("\n\n"))).otherwise(F.lit("")),
                        F.when(F.size(pairs) > 0, F.array_join(lines, "")).otherwise(F.lit("")))
    rest = F.col("_rest")
    fields = F.struct(
        F.when(F.col("_has_item"), F.col("_item")).alias("item_name"),
        F.when(F.size("_b") > 0, F.transform("_b", _strip)).alias("bullet_points"),
        F.when(F.col("_has_desc"), _strip(combined)).alias("product_description"),
        F.when(rest.rlike("Value: "), _strip(F.regexp_extract(rest, FIELD_VALUE, 1))).alias("value"),
        F.when(rest.rlike("Unit: "), _strip(F.regexp_extract(rest, FIELD_UNIT, 1))).alias("unit"))
    return d6.select(*cols, F.when(F.col("_ok"), fields).alias(out_col))


# ----------------------------------------------------------------------- TXT-17
def char_drop(c: Column, key: Column, p: float, seed: int = 42) -> Column:
    """TXT-17 (re-aimed): drop each character with probability ``p`` using a
    repeatable md5 draw on (key, position, seed)."""
    tail = f":{seed}"

    @F.pandas_udf("string")
    def kept(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(_kept_chars(texts, keys, p, tail), dtype=object)
    return kept(text_or_empty(c), key.cast("string"))


def _kept_chars(texts, keys, p: float, tail: str) -> Iterator[str]:
    """The texts without the dropped characters; draws are made for many texts at once.  An absent key is left out of the
    drawn message, as ``concat_ws`` does."""
    held, size = [], 0
    for text, key in zip(texts, keys):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        held.append((codes, b"" if key is None else f"{key}:".encode()))
        size += len(codes)
        if size >= 1 << 18:
            yield from _drop(held, p, tail)
            held, size = [], 0
    yield from _drop(held, p, tail)


def _drop(held: list, p: float, tail: str) -> Iterator[str]:
    keep = [np.ones(len(codes), bool) for codes, _ in held]
    groups: dict[tuple[int, int], list] = {}               # (length of the prefix, digits of the position) -> texts
    for k, (codes, prefix) in enumerate(held):
        low, digits = 0, 1
        while low < len(codes):
            high = min(len(codes), 10 ** digits)
            groups.setdefault((len(prefix), digits), []).append((k, low, high))
            low, digits = high, digits + 1
    for (_, digits), parts in groups.items():
        heads = np.frombuffer(b"".join(held[k][1] for k, _, _ in parts), np.uint8).reshape(len(parts), -1)
        of = np.repeat(np.arange(len(parts)), [high - low for _, low, high in parts])
        at = np.concatenate([np.arange(low, high) for _, low, high in parts])
        stay = np.concatenate([md5_words(heads, of[a:a + _LANE], at[a:a + _LANE], digits, tail.encode()) / 4294967296.0 >= p
                               for a in range(0, len(at), _LANE)])
        done = 0
        for k, low, high in parts:
            keep[k][low:high] = stay[done:done + high - low]
            done += high - low
    for (codes, _), use in zip(held, keep):
        yield codes[use].tobytes().decode("utf-32-le")


_LANE = 8_192
_MD5_K = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_MD5_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def md5_words(heads: np.ndarray, of: np.ndarray, number: np.ndarray, digits: int, tail: bytes) -> np.ndarray:
    """The first 32 bits (big-endian) of the md5 of ``heads[of] + str(number) + tail``; all numbers have ``digits`` digits.
    Messages of one block are hashed side by side."""
    size = heads.shape[1] + digits + len(tail)
    if size > 55:
        raw = [bytes(heads[k]) + str(n).encode() + tail for k, n in zip(of.tolist(), number.tolist())]
        return np.frombuffer(b"".join(hashlib.md5(x).digest()[:4] for x in raw), ">u4").astype(np.uint32)
    row = [h[of] for h in np.ascontiguousarray(heads.T)]
    rest, figures = number.astype(np.uint32), []
    for _ in range(digits):
        above = rest // np.uint32(10)
        figures.append((rest - above * np.uint32(10) + np.uint32(48)).astype(np.uint8))
        rest = above
    row += figures[::-1]
    row += [np.full(len(of), x, np.uint8) for x in (*tail, 0x80)]
    words = []
    for i in range(0, len(row), 4):
        w = np.zeros(len(of), np.uint32)
        for k, b in enumerate(row[i:i + 4]):
            w |= b.astype(np.uint32) << np.uint32(8 * k)
        words.append(w)
    words += [None] * (14 - len(words)) + [np.uint32(8 * size), None]
    a, b, c, d, f, high = (np.full(len(of), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0, 0))
    for i in range(61):                                    # the last three steps do not change the first word
        if i < 16:                                         # d ^ (b & (c ^ d))
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:                                       # c ^ (d & (b ^ c))
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:                                              # c ^ (b | ~d)
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(_MD5_K[i] + (int(words[g]) if isinstance(words[g], np.uint32) else 0) & 0xFFFFFFFF)
        if isinstance(words[g], np.ndarray):
            f += words[g]
        turn = _MD5_TURN[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=high)
        f >>= np.uint32(32 - turn)
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(0x67452301)).byteswap()
