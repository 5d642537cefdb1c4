"""Metric, fold, sampling, ensemble and post-processing queries over the
``predictions`` fixture (o_orderkey-keyed model outputs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as ENS
from ..operators import metrics as M
from ..operators import split as SP
from ..sources import tables as S
from .registry import query

MODELS = ["p_a", "p_b", "p_c"]


def r6(c):
    return F.round(c, 6)


def _long(spark, sf_dir):
    return M.long_predictions(S.predictions(spark, sf_dir), "sample_id", "y", MODELS)


_DUCK_LONG = """
long AS (SELECT sample_id, y, 'p_a' AS model, p_a AS pred FROM predictions
         UNION ALL SELECT sample_id, y, 'p_b', p_b FROM predictions
         UNION ALL SELECT sample_id, y, 'p_c', p_c FROM predictions)
"""

_DUCK_METRICS = """
count(*) AS n,
round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
round(avg(abs(y - pred)), 6) AS mae,
round(CASE WHEN count(y) * var_pop(y) = 0 THEN (CASE WHEN sum((y - pred) * (y - pred)) = 0 THEN 1.0 ELSE 0.0 END)
      ELSE 1 - sum((y - pred) * (y - pred)) / (count(y) * var_pop(y)) END, 6) AS r2,
round(avg(100.0 * abs(pred - y) / greatest((abs(y) + abs(pred)) / 2.0, 1e-8)), 6) AS smape,
round(sqrt(avg(pow(ln(1 + pred + 1e-9) - ln(1 + y + 1e-9), 2))), 6) AS rmsle
"""


def _rounded_metrics(df, keys):
    return df.select(*keys, "n", *[r6(F.col(m)).alias(m) for m in ["rmse", "mae", "r2", "smape", "rmsle"]])


@query("model_comparison", "MET-1 MET-2 MET-3 MET-4 MET-6 MET-9 TOP-1 SNK-5", oracle=f"""
WITH {_DUCK_LONG}
SELECT model, {_DUCK_METRICS} FROM long GROUP BY model
""")
def model_comparison(spark, sf_dir):
    from ..session import scratch_dir
    from ..sources.catalog_io import write_csv
    report = _rounded_metrics(M.regression_metrics(_long(spark, sf_dir), "y", "pred", ["model"]), ["model"])
    write_csv(report.orderBy("smape", "model"), scratch_dir(spark, "model-comparison"))  # SNK-5 report file
    return report


_FOLD_SQL = "CAST(CAST(('0x' || substr(md5(CAST(sample_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) % 5 AS INTEGER)"


@query("metrics_by_fold", "MET-8 SPL-1", oracle=f"""
WITH {_DUCK_LONG}, f AS (SELECT *, {_FOLD_SQL} AS fold FROM long)
SELECT model, fold, {_DUCK_METRICS} FROM f GROUP BY model, fold
""")
def metrics_by_fold(spark, sf_dir):
    f = SP.kfold(_long(spark, sf_dir), "sample_id", 5, 42)
    return _rounded_metrics(M.regression_metrics(f, "y", "pred", ["model", "fold"]), ["model", "fold"])


@query("fold_metric_summary", "MET-10 MET-7", oracle=f"""
WITH {_DUCK_LONG}, f AS (SELECT *, {_FOLD_SQL} AS fold FROM long),
pf AS (SELECT model, fold, count(*) AS n, avg(abs(pred - y) * 100.0 / greatest((abs(y) + abs(pred)) / 2.0, 1e-8)) AS smape,
         CASE WHEN count(y) * var_pop(y) = 0 THEN 0.0 ELSE 1 - sum((y - pred) * (y - pred)) / (count(y) * var_pop(y)) END AS r2
       FROM f GROUP BY model, fold)
SELECT model, round(avg(smape), 6) AS smape_mean, round(stddev_pop(smape), 6) AS smape_std,
       round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std,
       round(avg(CASE WHEN n > 2 THEN 1 - (1 - r2) * (n - 1) / (n - 1 - 1) ELSE r2 END), 6) AS adj_r2_mean
FROM pf GROUP BY model
""")
def fold_metric_summary(spark, sf_dir):
    f = SP.kfold(_long(spark, sf_dir), "sample_id", 5, 42)
    pf = M.regression_metrics(f, "y", "pred", ["model", "fold"])
    pf = pf.withColumn("adj_r2", M.adjusted_r2(F.col("r2"), F.col("n"), 1))
    s = M.fold_summary(pf, ["smape", "r2", "adj_r2"], ["model"])
    return s.select("model", *[r6(F.col(c)).alias(c) for c in
                               ["smape_mean", "smape_std", "r2_mean", "r2_std", "adj_r2_mean"]])


@query("smape_variants", "MET-4 MET-5", oracle="""
SELECT round(avg(100.0 * abs(p_a - y) / greatest((abs(y) + abs(p_a)) / 2.0, 1e-8)), 6) AS smape_floor,
       round(avg(100.0 * 2.0 * abs(p_a - y) / (abs(y) + abs(p_a) + 1e-8)), 6) AS smape_add_eps,
       round(avg(100.0 * 2.0 * abs(p_a - y) / CASE WHEN abs(y) + abs(p_a) = 0 THEN 1e-8 ELSE abs(y) + abs(p_a) END), 6) AS smape_zero_eps,
       round(avg(200.0 * abs(p_a - y) / CASE WHEN abs(y) + abs(p_a) = 0 THEN 1.0 ELSE abs(y) + abs(p_a) END), 6) AS smape_zero_one,
       round(avg(100.0 * abs(p_a - y) / ((abs(y) + abs(p_a)) / 2.0)), 6) AS smape_plain
FROM predictions
""")
def smape_variants(spark, sf_dir):
    p = S.predictions(spark, sf_dir)
    return p.agg(*[r6(F.avg(M.smape_term("y", "p_a", z))).alias(f"smape_{z}")
                   for z in ["floor", "add_eps", "zero_eps", "zero_one", "plain"]])


@query("ensemble_combinations", "ENS-3 ENS-4 ENS-7 ENS-8 ENS-9 ENS-10 SCH-8", oracle="""
SELECT sample_id,
       round((p_a + p_b + p_c) / 3.0, 6) AS ens_mean,
       round(p_a * 0.5 + p_b * 0.3 + p_c * 0.2, 6) AS ens_weighted_sum,
       round(p_a * (2.0 / 4.0) + p_b * (1.0 / 4.0) + p_c * (1.0 / 4.0), 6) AS ens_weighted_mean,
       round(greatest(p_a, p_b, p_c), 6) AS ens_max,
       round(least(p_a, p_b, p_c), 6) AS ens_min,
       round(list_sort([p_a, p_b, p_c])[2], 6) AS ens_median,
       round((list_sort([p_a, p_b])[1] + list_sort([p_a, p_b])[2]) / 2.0, 6) AS ens_median2
FROM predictions
""")
def ensemble_combinations(spark, sf_dir):
    p = S.predictions(spark, sf_dir)
    return p.select("sample_id",
                    r6(ENS.mean_of(MODELS)).alias("ens_mean"),
                    r6(ENS.weighted_sum(MODELS, [0.5, 0.3, 0.2])).alias("ens_weighted_sum"),
                    r6(ENS.weighted_mean(MODELS, [2.0, 1.0, 1.0])).alias("ens_weighted_mean"),
                    r6(ENS.max_of(MODELS)).alias("ens_max"),
                    r6(ENS.min_of(MODELS)).alias("ens_min"),
                    r6(ENS.median_of(MODELS)).alias("ens_median"),
                    r6(ENS.median_of(["p_a", "p_b"])).alias("ens_median2"))


@query("ensemble_vote", "ENS-6", oracle="""
WITH a AS (SELECT sample_id, [CAST(trunc(p_a) AS BIGINT), CAST(trunc(p_b) AS BIGINT), CAST(trunc(p_c) AS BIGINT),
                              CAST(trunc(y) AS BIGINT)] AS arr FROM predictions)
SELECT sample_id,
       list_min(list_filter(arr, lambda x: len(list_filter(arr, lambda z: z = x)) =
                list_max(list_transform(arr, lambda u: len(list_filter(arr, lambda z: z = u)))))) AS vote
FROM a
""")
def ensemble_vote(spark, sf_dir):
    p = S.predictions(spark, sf_dir)
    return p.select("sample_id", ENS.vote_of(["p_a", "p_b", "p_c", "y"]).alias("vote"))


@query("ensemble_predict_submission", "ENS-10 SNK-1 JOI-2", oracle="""
SELECT sample_id, round(p_a * (1.0 / 3.5) + p_b * (2.0 / 3.5) + p_c * (0.5 / 3.5), 6) AS price FROM predictions
""")
def ensemble_predict_submission(spark, sf_dir):
    out = ENS.ensemble_predict(S.predictions(spark, sf_dir), "sample_id", MODELS, "weighted", [1.0, 2.0, 0.5])
    return out.select("sample_id", r6(F.col("price")).alias("price"))


@query("oof_matrix", "JOI-1", oracle="""
SELECT sample_id, p_a, p_b, p_c FROM predictions
""")
def oof_matrix(spark, sf_dir):
    long = _long(spark, sf_dir)
    return ENS.oof_matrix(long, "sample_id", MODELS)


@query("canary_divergence", "JOI-8 MET-13", oracle="""
SELECT count(*) AS n_compared, round(avg(abs(a.p_a - b.p_b)), 6) AS mean_abs_divergence
FROM (SELECT sample_id, p_a FROM predictions) a JOIN (SELECT sample_id, p_b FROM predictions) b USING (sample_id)
""")
def canary_divergence(spark, sf_dir):
    primary = S.predictions(spark, sf_dir).select("sample_id", "p_a")
    canary = S.predictions(spark, sf_dir).select("sample_id", "p_b")
    j = primary.join(canary, "sample_id", "inner")
    return j.agg(F.count(F.lit(1)).alias("n_compared"),
                 r6(F.avg(F.abs(F.col("p_a") - F.col("p_b")))).alias("mean_abs_divergence"))


@query("submission_completeness", "JOI-3 SET-1", oracle="""
WITH sub AS (SELECT l_orderkey AS sample_id, count(*) AS c FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
j AS (SELECT e.sample_id AS eid, s.c FROM (SELECT o_orderkey AS sample_id FROM orders) e FULL OUTER JOIN sub s USING (sample_id))
SELECT count(*) FILTER (WHERE c IS NULL) AS missing_ids,
       CAST(coalesce(sum(c) FILTER (WHERE eid IS NULL), 0) AS BIGINT) AS extra_rows,
       count(*) FILTER (WHERE c > 1) AS duplicated_ids
FROM j
""")
def submission_completeness(spark, sf_dir):
    """Every expected id exactly once: one full outer join on the id, one pass."""
    sub = (S.table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == 1)
           .groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("c")))
    expected = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.lit(1).alias("e"))
    j = expected.join(sub, "sample_id", "full_outer")
    return j.agg(F.count_if(F.col("c").isNull()).alias("missing_ids"),
                 F.coalesce(F.sum(F.when(F.col("e").isNull(), F.col("c"))), F.lit(0)).alias("extra_rows"),
                 F.count_if(F.col("c") > 1).alias("duplicated_ids"))


@query("postprocess_predictions", "MTH-1 MTH-2 MTH-3 MTH-4 SNK-1", oracle="""
SELECT sample_id, round_even(greatest(exp(ln(1 + greatest(y - 2000.0, 0))) - 1, 0.0), 2) AS predicted_price
FROM predictions
""")
def postprocess_predictions(spark, sf_dir):
    from ..operators.postprocess import postprocess
    p = S.predictions(spark, sf_dir)
    log_pred = F.log1p(F.greatest(F.col("y") - 2000.0, F.lit(0.0)))
    return p.select("sample_id", postprocess(log_pred, inverse_log1p=True, min_value=0.0, round_cents=True)
                    .alias("predicted_price"))


@query("kfold_assignment", "SPL-1", oracle=f"""
SELECT {_FOLD_SQL} AS fold, count(*) AS n_rows, round(sum(y), 2) AS y_sum FROM predictions GROUP BY 1
""")
def kfold_assignment(spark, sf_dir):
    f = SP.kfold(S.predictions(spark, sf_dir), "sample_id", 5, 42)
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("y"), 2).alias("y_sum"))


@query("stratified_folds", "SPL-2 WIN-4", oracle="""
WITH e AS (SELECT quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS q FROM predictions),
b AS (SELECT sample_id, y, (y > q[1])::INT + (y > q[2])::INT + (y > q[3])::INT + (y > q[4])::INT AS bin,
             CAST(('0x' || substr(md5(CAST(sample_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) AS h
      FROM predictions, e)
SELECT sample_id, bin, CAST((row_number() OVER (PARTITION BY bin ORDER BY h, sample_id) - 1) % 5 AS INTEGER) AS fold FROM b
""")
def stratified_folds(spark, sf_dir):
    f = SP.stratified_kfold(S.predictions(spark, sf_dir), "sample_id", "y", 5, 42)
    return f.select("sample_id", "bin", "fold")


@query("exact_sample", "SMP-1 SMP-2", oracle="""
WITH h AS (SELECT sample_id, y, CAST(('0x' || substr(md5(CAST(sample_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) AS h,
                  count(*) OVER () AS n FROM predictions)
SELECT sample_id, y FROM (SELECT *, row_number() OVER (ORDER BY h, sample_id) AS rn FROM h) WHERE rn <= round(0.01 * n)
""")
def exact_sample(spark, sf_dir):
    p = S.predictions(spark, sf_dir).select("sample_id", "y")
    return SP.exact_sample(p, "sample_id", frac=0.01, seed=42)


@query("train_test_split", "SPL-3 SPL-4", oracle="""
SELECT CASE WHEN CAST(('0x' || substr(md5(CAST(sample_id AS VARCHAR) || ':42'), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2
            THEN 'test' ELSE 'train' END AS split,
       CASE WHEN CAST(('0x' || substr(md5(CAST(sample_id AS VARCHAR) || ':7'), 1, 8)) AS BIGINT) % 10000 < 1000
            THEN 'canary' ELSE 'primary' END AS route,
       count(*) AS n_rows
FROM predictions GROUP BY 1, 2
""")
def train_test_split(spark, sf_dir):
    p = SP.hash_split(S.predictions(spark, sf_dir), "sample_id", 0.2, 42)
    p = SP.canary_route(p, "sample_id", 10.0, seed=7)
    return p.groupBy("split", "route").agg(F.count(F.lit(1)).alias("n_rows"))


@query("target_skew_gate", "MET-18 MET-19 LOG-3", oracle="""
WITH m AS (SELECT count(y) AS n, avg(y) AS mu FROM predictions),
c AS (SELECT n, avg(pow(y - mu, 3)) / pow(avg(pow(y - mu, 2)), 1.5) AS g1, min(y) AS mn, max(y) AS mx
      FROM predictions, m GROUP BY n),
t AS (SELECT *, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS yy,
             3.0 * (n * n + 27.0 * n - 70) * (n + 1.0) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2 FROM c),
u AS (SELECT *, -1 + sqrt(2 * (b2 - 1)) AS w2 FROM t),
v AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2 / (w2 - 1)) AS alpha,
             CASE WHEN yy = 0 THEN 1 ELSE yy END AS y1 FROM u)
SELECT n, round(g1, 6) AS skew, round(delta * ln(y1 / alpha + sqrt((y1 / alpha) * (y1 / alpha) + 1)), 6) AS z,
       (n >= 30 AND mn >= 0 AND mx > mn AND g1 >= 0.5
        AND abs(delta * ln(y1 / alpha + sqrt((y1 / alpha) * (y1 / alpha) + 1))) > 2.5758293035489004) AS apply_log1p
FROM v
""")
def target_skew_gate(spark, sf_dir):
    from ..operators.logtransform import skew_gate_stats
    return skew_gate_stats(S.predictions(spark, sf_dir), ["y"], min_skew=0.5, alpha_z=M.Z_CRIT_001) \
        .select("n", r6(F.col("skew")).alias("skew"), r6(F.col("z")).alias("z"), "apply_log1p")
