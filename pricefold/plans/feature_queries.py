"""Feature queries (FEA-*, SEL-*, LOG-1/2, ARR-*, FLT-5/7, SCH-4/8/11, HSH-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as FE
from ..operators import neighbours as NB
from ..operators import logtransform as LG
from ..session import scratch_dir
from ..operators.ranking import stored
from ..sources import tables as S
from . import duck as D
from .registry import query


def r6(c):
    return F.round(c, 6)


def _stop_sql() -> str:
    return "[" + ", ".join(D.q(w) for w in FE.english_stop_words()) + "]"


_TFIDF_DUCK = """
WITH t0 AS (SELECT doc_id, list_filter(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'),
                   lambda w: length(w) >= 2), lambda w: NOT list_contains({stop}, w)) AS t FROM documents),
t1 AS (SELECT doc_id, list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                                          ELSE []::VARCHAR[] END) AS g FROM t0),
tok AS (SELECT doc_id, unnest(g) AS term FROM t1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
vocab AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf
          FROM st ORDER BY total DESC, term LIMIT 500),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
"""


@query("documents_tfidf", "FEA-1 TXT-18", oracle=_TFIDF_DUCK.replace("{stop}", _stop_sql()))
def documents_tfidf(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    long = FE.tfidf_long(d, "doc_id", "text", max_features=500, stop_words=FE.english_stop_words())
    return long.withColumn("weight", r6(F.col("weight")))


_SCALE_COLS = ["catalog_content_clean_len", "parsed_total_weight_g", "parsed_quantity_mentions"]


@query("catalog_scaled_features", "FEA-4 FEA-5 SCH-4", oracle=f"""
WITH {D.parsed_cte()},
s AS (SELECT {", ".join(f"avg(coalesce({c}, 0)) AS m_{c}, stddev_pop(coalesce({c}, 0)) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _SCALE_COLS)} FROM parsed)
SELECT sample_id,
  {", ".join(f"round((coalesce({c}, 0) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS z_{c}" for c in _SCALE_COLS)},
  {", ".join(f"round(CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.0 END, 6) AS mm_{c}" for c in _SCALE_COLS)}
FROM parsed, s
""")
def catalog_scaled_features(spark, sf_dir):
    p = stored(T.add_parsed_features(S.catalog(spark, sf_dir)).select("sample_id", *_SCALE_COLS), "scaled-columns")
    z = FE.apply_standard(p, FE.fit_standard(p, _SCALE_COLS), ["sample_id"])
    mm = FE.minmax_scale(p, _SCALE_COLS, ["sample_id"])
    z = z.select("sample_id", *[r6(F.col(c)).alias(f"z_{c}") for c in _SCALE_COLS])
    mm = mm.select("sample_id", *[r6(F.col(c).cast("double")).alias(f"mm_{c}") for c in _SCALE_COLS])
    return z.join(mm, "sample_id")


@query("part_type_codes", "FEA-6", oracle="""
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(p_type, 'NA')) - 1 AS INTEGER) AS type_code FROM part
""")
def part_type_codes(spark, sf_dir):
    p = S.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return FE.apply_labels(p, FE.fit_labels(p, "p_type"), "p_type", "type_code").select("p_partkey", "type_code")


_EMB_LONG_DUCK = """
long AS (SELECT vec_id, CAST(label AS DOUBLE) AS y, CAST(embedding[i] AS DOUBLE) AS x, i - 1 AS idx
         FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding))
"""


@query("embedding_f_regression", "SEL-1 TOP-5", oracle=f"""
WITH {_EMB_LONG_DUCK},
st AS (SELECT idx, corr(x, y) AS r, count(*) AS n FROM long GROUP BY idx),
f AS (SELECT idx, r * r / (1 - r * r) * (n - 2) AS f_score FROM st)
SELECT CAST(idx AS INTEGER) AS idx, round(f_score, 6) AS f_score,
       row_number() OVER (ORDER BY f_score DESC, idx) <= 8 AS selected FROM f
""")
def embedding_f_regression(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    sc = FE.f_regression_scores(FE.vector_long(e, "vec_id", "embedding", "label"))
    chosen = FE.select_top_k(sc, "f_score", 8, n_features=64)
    return sc.select("idx", r6(F.col("f_score")).alias("f_score"), F.col("idx").isin(chosen).alias("selected"))


@query("embedding_mutual_info", "SEL-2", oracle=f"""
WITH {_EMB_LONG_DUCK},
ex AS (SELECT idx, quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM long GROUP BY idx),
ey AS (SELECT quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM long WHERE idx = 0),
b AS (SELECT l.idx, len(list_filter(ex.e, lambda v: l.x > v)) AS bx, len(list_filter(ey.e, lambda v: l.y > v)) AS yb
      FROM long l JOIN ex USING (idx), ey),
j AS (SELECT idx, bx, yb, count(*) AS nxy FROM b GROUP BY ALL),
k AS (SELECT *, sum(nxy) OVER (PARTITION BY idx) AS n, sum(nxy) OVER (PARTITION BY idx, bx) AS nx,
             sum(nxy) OVER (PARTITION BY idx, yb) AS ny FROM j)
SELECT CAST(idx AS INTEGER) AS idx, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mi FROM k GROUP BY idx
""")
def embedding_mutual_info(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    mi = FE.binned_mutual_info(FE.vector_long(e, "vec_id", "embedding", "label"))
    return mi.select("idx", r6(F.col("mi")).alias("mi"))


@query("embedding_nearest_mutual_info", "SEL-2", oracle=f"""
WITH {_EMB_LONG_DUCK},
st AS (SELECT idx, avg(x) AS mx, CAST(CAST(stddev_pop(x) AS FLOAT) AS DOUBLE) AS sx,
              avg(y) AS my, CAST(CAST(stddev_pop(y) AS FLOAT) AS DOUBLE) AS sy FROM long GROUP BY idx),
g AS (SELECT idx, vec_id, CAST(floor((x / sx - floor(mx / sx)) * 4294967296) AS BIGINT) AS x,
             CAST(floor((y / sy - floor(my / sy)) * 4294967296) AS BIGINT) AS y FROM long JOIN st USING (idx)),
r AS (SELECT a.idx, a.vec_id, any_value(a.x) AS x, any_value(a.y) AS y,
             min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS r
      FROM g a JOIN g b ON a.idx = b.idx AND a.vec_id <> b.vec_id GROUP BY a.idx, a.vec_id),
c AS (SELECT r.idx, r.vec_id, count(*) FILTER (WHERE abs(r.x - g.x) < greatest(r, 1)) AS cx,
             count(*) FILTER (WHERE abs(r.y - g.y) < greatest(r, 1)) AS cy
      FROM r JOIN g USING (idx) GROUP BY r.idx, r.vec_id),
n AS (SELECT count(*) AS n FROM embeddings),
psi AS (SELECT m, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / m) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
        FROM (SELECT unnest(range(1, n + 2)) AS m FROM n))
SELECT CAST(idx AS INTEGER) AS idx, count(*) AS n,
       round(greatest(0, any_value(pn.p) + (SELECT p FROM psi WHERE m = 3) - avg(px.p + py.p)), 6) AS mi
FROM c JOIN psi px ON px.m = cx JOIN psi py ON py.m = cy, n JOIN psi pn ON pn.m = n.n GROUP BY idx
""")
def embedding_nearest_mutual_info(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    mi = NB.nearest_mutual_info(FE.vector_long(e, "vec_id", "embedding", "label"))
    return mi.select("idx", "n", r6(F.col("mi")).alias("mi"))


@query("embedding_vector_ops", "ARR-1 ARR-2 FLT-5 FLT-7 SCH-8 SCH-9 SCH-11 SEL-3", oracle="""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e)
SELECT vec_id, round(nrm, 6) AS l2_norm, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: i * v[i] / (nrm + 1e-12))), 6) AS normalized_position_sum,
       nrm <= 1e-12 AS is_zero, len(list_concat(v, v[1:16])) AS concat_width,
       round(list_sum(list_concat(v, list_transform(range(16), lambda i: 0.0))[1:80]), 6) AS aligned_sum,
       round(v[3] + v[6] + v[11], 6) AS sliced_sum,
       len(list_filter(v, lambda x: NOT isnan(x) AND abs(x) < 'inf'::DOUBLE)) AS finite_count
FROM n
""")
def embedding_vector_ops(spark, sf_dir):
    e = S.table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    nrm = FE.l2_norm(v)
    return e.select(
        "vec_id", r6(nrm).alias("l2_norm"),
        r6(F.aggregate(F.transform(FE.l2_normalize(FE.zero_fill(v, 64), 1e-12), lambda x, i: x * (i + 1)), F.lit(0.0),
                       lambda a, x: a + x)).alias("normalized_position_sum"),
        FE.is_zero_vector(v).alias("is_zero"),
        F.size(FE.concat_vectors(v, F.slice(v, 1, 16))).cast("long").alias("concat_width"),
        r6(F.aggregate(FE.align_width(v, 80), F.lit(0.0), lambda a, x: a + x)).alias("aligned_sum"),
        r6(F.aggregate(FE.slice_vector(v, [2, 5, 10]), F.lit(0.0), lambda a, x: a + x)).alias("sliced_sum"),
        F.size(F.filter(v, FE.is_finite)).cast("long").alias("finite_count"))


HASH_DIM = 300


@query("catalog_hash_embedding", "ARR-3 TXT-2", oracle=f"""
WITH c AS (SELECT sample_id, list_filter(string_split_regex({D.embed_clean('catalog_content')}, '\\s+'), lambda x: x <> '') AS tk
           FROM catalog),
t AS (SELECT DISTINCT unnest(tk) AS t FROM c),
h AS (SELECT t, d, CAST(('0x' || substr(md5(concat_ws(':', t, CAST(d AS VARCHAR), '0')), 1, 8)) AS BIGINT)
             / 4294967296.0 * 2.0 - 1.0 AS x FROM t, range({HASH_DIM}) r(d)),
e AS (SELECT c.sample_id, h.d, avg(h.x) AS x FROM (SELECT sample_id, unnest(tk) AS t FROM c) c JOIN h USING (t) GROUP BY ALL)
SELECT c.sample_id, coalesce(n, 0) AS n_dims, round(coalesce(s, 0), 6) AS component_sum, round(coalesce(q, 0), 6) AS square_sum,
       round(coalesce(w, 0), 4) AS position_sum
FROM c LEFT JOIN (SELECT sample_id, count(*) FILTER (WHERE x <> 0) AS n, sum(x) AS s, sum(x * x) AS q, sum(x * (d + 1)) AS w
                  FROM e GROUP BY sample_id) USING (sample_id)
""")
def catalog_hash_embedding(spark, sf_dir):
    """All 300 components per row, reported by sums that any wrong, swapped or missing component changes."""
    c = S.catalog(spark, sf_dir).select("sample_id", T.embed_clean(F.col("catalog_content")).alias("t"))
    e = c.select("sample_id", FE.token_hash_embedding(F.col("t"), dim=HASH_DIM).alias("e"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)                       # noqa: E731
    return e.select("sample_id", F.size(F.filter("e", lambda x: x != 0)).cast("long").alias("n_dims"),
                    r6(total(F.col("e"))).alias("component_sum"),
                    r6(total(F.transform("e", lambda x: x * x))).alias("square_sum"),
                    F.round(total(F.transform("e", lambda x, i: x * (i + 1))), 4).alias("position_sum"))


@query("orders_fingerprint", "HSH-1", oracle="""
WITH h AS (SELECT CAST(('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR),
                  coalesce(o_orderstatus, ''), coalesce(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), ''))), 1, 15)) AS BIGINT) AS h FROM orders)
SELECT count(*) AS rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h
""")
def orders_fingerprint(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    return FE.content_fingerprint(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], digits=2)


_GATE_CTE = """
l AS (SELECT 'value' AS feature, CAST(value AS DOUBLE) AS x FROM events
      UNION ALL SELECT 'user_num', CAST(user_id AS DOUBLE) FROM events
      UNION ALL SELECT 'shifted', value - 1.0 FROM events UNION ALL SELECT 'fixed', 1.0 FROM events),
m AS (SELECT feature, count(x) AS n, avg(x) AS mu, min(x) AS mn, max(x) AS mx FROM l GROUP BY feature),
c AS (SELECT m.feature, n, mn, mx, avg(pow(x - mu, 3)) / nullif(pow(avg(pow(x - mu, 2)), 1.5), 0) AS g1
      FROM l JOIN m USING (feature) GROUP BY ALL),
t AS (SELECT *, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS yy,
             3.0 * (n * n + 27.0 * n - 70) * (n + 1.0) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2 FROM c),
u AS (SELECT *, -1 + sqrt(2 * (b2 - 1)) AS w2 FROM t),
v AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS alpha, CASE WHEN yy = 0 THEN 1 ELSE yy END AS y1 FROM u),
z AS (SELECT *, delta * ln(y1 / alpha + sqrt((y1 / alpha) * (y1 / alpha) + 1)) AS z FROM v),
gate AS (SELECT feature, n, round(g1, 6) AS skew,
       CASE WHEN n < 30 THEN 'insufficient_rows' WHEN mn < 0 THEN 'negative' WHEN mx = mn THEN 'constant'
            WHEN abs(z) > 2.5758293035489004 AND g1 >= 1.0 THEN 'selected' ELSE 'not_skewed' END AS reason FROM z)
"""
_GATE_COLS = ["value", "user_num", "shifted", "fixed"]


def _gate_table(spark, sf_dir):
    """A right-skewed, a uniform, a partly negative and a constant feature."""
    ev = S.table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("value").cast("double").alias("value"), F.col("user_id").cast("double").alias("user_num"),
                     (F.col("value") - 1.0).alias("shifted"), F.lit(1.0).alias("fixed"))


@query("event_log_gate", "LOG-1 MET-18 MET-19", oracle=f"WITH {_GATE_CTE} SELECT * FROM gate")
def event_log_gate(spark, sf_dir):
    st = LG.skew_gate_stats(_gate_table(spark, sf_dir), _GATE_COLS)
    return st.select("feature", "n", F.when(F.col("min") < F.col("max"), r6(F.col("skew"))).alias("skew"), "reason")


@query("event_log_gate_applied", "LOG-2", oracle=f"""
WITH {_GATE_CTE}, s AS (SELECT bool_or(feature = 'value' AND reason = 'selected') AS v,
                               bool_or(feature = 'user_num' AND reason = 'selected') AS u FROM gate)
SELECT event_id, round(CASE WHEN v THEN ln(1 + greatest(value, 0)) ELSE value END, 6) AS value,
       round(CASE WHEN u THEN ln(1 + greatest(user_id, 0)) ELSE user_id END, 6) AS user_num
FROM events, s
""")
def event_log_gate_applied(spark, sf_dir):
    """The gate fitted on the table, saved and loaded, then applied at inference (LOG-2)."""
    t = _gate_table(spark, sf_dir)
    path = scratch_dir(spark, "log-gate")
    LG.SkewLogGate(_GATE_COLS).fit(t).save(spark, path)
    out = LG.SkewLogGate.load(spark, path).transform(t)
    return out.select("event_id", r6(F.col("value")).alias("value"), r6(F.col("user_num")).alias("user_num"))


@query("lineitem_log_gate", "LOG-1 LOG-3 MET-18", oracle="""
WITH l AS (SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem
           UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
           UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
m AS (SELECT feature, count(x) AS n, avg(x) AS mu, min(x) AS mn, max(x) AS mx FROM l GROUP BY feature),
c AS (SELECT m.feature, n, mn, mx, avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS g1
      FROM l JOIN m USING (feature) GROUP BY ALL),
t AS (SELECT *, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS yy,
             3.0 * (n * n + 27.0 * n - 70) * (n + 1.0) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2 FROM c),
u AS (SELECT *, -1 + sqrt(2 * (b2 - 1)) AS w2 FROM t),
v AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS alpha, CASE WHEN yy = 0 THEN 1 ELSE yy END AS y1 FROM u),
z AS (SELECT *, delta * ln(y1 / alpha + sqrt((y1 / alpha) * (y1 / alpha) + 1)) AS z FROM v)
SELECT feature, n, round(g1, 6) AS skew,
       CASE WHEN n < 30 THEN 'insufficient_rows' WHEN mn < 0 THEN 'negative' WHEN mx = mn THEN 'constant'
            WHEN abs(z) > 2.5758293035489004 AND g1 >= 0.5 THEN 'selected' ELSE 'not_skewed' END AS reason
FROM z
""")
def lineitem_log_gate(spark, sf_dir):
    li = S.table(spark, sf_dir, "lineitem")
    st = LG.skew_gate_stats(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], min_skew=0.5)
    return st.select("feature", "n", r6(F.col("skew")).alias("skew"), "reason")
