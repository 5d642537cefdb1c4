"""DuckDB expression builders used by the oracle texts.

The oracle is an independent SQL statement of each operator's meaning; these
helpers only spell out long CASE lists (unit rules) and repeated regex chains.
DuckDB 2 lambdas use the ``lambda x: ...`` form.
"""

from __future__ import annotations

from ..functions import text as T
from ..functions.units import QUANTITY_UNIT_RULES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def collapse(e: str) -> str:
    return f"regexp_replace({e}, '\\s+', ' ', 'g')"


def basic_clean(e: str) -> str:
    s = collapse(f"regexp_replace({strip(f'coalesce({e}, {q(str())})')}, '[\\n\\r]', ' ', 'g')")
    s = f"lower({s})"
    s = f"regexp_replace({s}, {q(T.TAG)}, ' ', 'g')"
    s = f"regexp_replace({s}, {q(T.BASIC_KEEP)}, ' ', 'g')"
    return strip(collapse(s))


def embed_clean(e: str) -> str:
    s = f"lower(coalesce({e}, ''))"
    s = f"regexp_replace({s}, {q(T.V2_KEEP)}, ' ', 'g')"
    s = f"regexp_replace({s}, '\\boz\\b', 'ounce', 'g')"
    s = f"regexp_replace({s}, '\\bpack of\\b', 'pack_of', 'g')"
    return strip(collapse(s))


def word_count(e: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({e}, ''), '\\s+'), lambda x: x <> ''))"


def sentence_count(e: str) -> str:
    s = f"coalesce({e}, '')"
    return (f"CASE WHEN length({s}) = 0 THEN 0 ELSE "
            f"length({s}) - length(regexp_replace({s}, '[;.]', '', 'g')) + 1 END")


def matches(e: str, pattern: str, vg: int, ug: int) -> str:
    """list of {value, unit} structs for one pattern (DuckDB)."""
    s = f"coalesce({e}, '')"
    return (f"list_transform(regexp_extract_all({s}, {q(pattern)}, 0), lambda m: "
            f"struct_pack(value := CAST(regexp_extract(m, {q(pattern)}, {vg}) AS DOUBLE), "
            f"unit := replace(lower(regexp_extract(m, {q(pattern)}, {ug})), ' ', '')))")


def quantities(e: str) -> str:
    return f"list_concat({matches(e, T.QUANTITY_PATTERN, 1, 2)}, {matches(e, T.UNIT_FIRST_PATTERN, 2, 1)})"


def bucket_scale(unit_expr: str, bucket: str) -> str:
    whens = " ".join(f"WHEN {q(u)} THEN {s!r}" for u, (b, s) in QUANTITY_UNIT_RULES.items() if b == bucket)
    return f"(CASE {unit_expr} {whens} ELSE 0.0 END)"


def bucket_total(qexpr: str, bucket: str) -> str:
    return (f"list_reduce(list_prepend(0.0::DOUBLE, list_transform({qexpr}, lambda x: x.value * "
            f"{bucket_scale('x.unit', bucket)})), lambda a, b: a + b)")


def parse_ounces(e: str) -> str:
    return (f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(regexp_extract_all(coalesce({e}, ''), "
            f"{q(T.OUNCE_PATTERN)}, 1), lambda v: CAST(v AS DOUBLE))), lambda a, b: a + b)")


def value_unit(e: str) -> tuple[str, str]:
    s = f"coalesce({e}, '')"
    v = f"regexp_extract({s}, {q(T.VALUE_UNIT_PATTERN)}, 1)"
    u = f"lower(regexp_extract({s}, {q(T.VALUE_UNIT_PATTERN)}, 2))"
    return f"(CASE WHEN {v} = '' THEN 0.0 ELSE CAST({v} AS DOUBLE) END)", u


def parsed_features_select(text_col: str = "catalog_content") -> str:
    """DuckDB select list equal to ``add_parsed_features`` (TXT-9)."""
    v, u = value_unit(text_col)
    qx = quantities(text_col)
    return (f"length(coalesce({text_col}, '')) AS {text_col}_clean_len, "
            f"{parse_ounces(text_col)} AS parsed_ounces, {v} AS parsed_value, {u} AS parsed_unit, "
            f"{bucket_total(qx, 'weight_g')} AS parsed_total_weight_g, "
            f"{bucket_total(qx, 'volume_ml')} AS parsed_total_volume_ml, "
            f"{bucket_total(qx, 'count_units')} AS parsed_total_count_units, "
            f"CAST(len({qx}) AS DOUBLE) AS parsed_quantity_mentions, "
            f"CASE WHEN len({qx}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS parsed_has_quantity")


def parsed_cte(source: str = "catalog", text_col: str = "catalog_content") -> str:
    return (f"parsed0 AS (SELECT *, {parsed_features_select(text_col)} FROM {source}), "
            f"parsed AS (SELECT *, ln(1 + parsed_value) AS parsed_value_log1p, "
            f"ln(1 + parsed_total_weight_g) AS parsed_weight_log1p, "
            f"ln(1 + parsed_total_volume_ml) AS parsed_volume_log1p, "
            f"ln(1 + parsed_total_count_units) AS parsed_count_log1p FROM parsed0)")


def bucket_name(unit_expr: str) -> str:
    whens = " ".join(f"WHEN {q(u)} THEN {q(b)}" for u, (b, _) in QUANTITY_UNIT_RULES.items())
    return f"(CASE {unit_expr} {whens} END)"


def bucket_scale_any(unit_expr: str) -> str:
    whens = " ".join(f"WHEN {q(u)} THEN {s!r}" for u, (_, s) in QUANTITY_UNIT_RULES.items())
    return f"(CASE {unit_expr} {whens} ELSE 0.0 END)"
