"""Run registry as an append-only event table (REG-1 .. REG-3, WIN-2, WIN-3, TOP-3, JOI-7, MET-23).

Events: (seq, run_id, action, ts, stage, bundle_path, tracking_id).

* ``register`` creates a run (``staging`` if its stage is ``train``, else ``recorded``); registering again keeps the status
  and updates stage, bundle path and tracking id where given.  Any action before it is rejected.
* ``promote_staging`` and ``promote_canary`` set the status; ``approve_production`` makes a run production beside the
  active one.
* ``promote_production``, ``activate`` and ``rollback`` make the run production and the active one, and archive every
  other production run, which counts as an update of those runs.

So a run whose last status event made it production is archived exactly if a later activation exists.  One ``groupBy``
per run and one scalar (the last activation) give all states; only archived runs look up when they were archived,
through blocks of ``BLOCK`` sequence numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import stored

ACTIVATING = ("promote_production", "activate", "rollback")
PRODUCTION = (*ACTIVATING, "approve_production")
BLOCK = 4096


def run_state(events: DataFrame) -> DataFrame:
    """REG-1: run_id, status, is_active, stage, bundle_path, tracking_id, created_ts, updated_seq, updated_ts."""
    first = events.where("action = 'register'").groupBy("run_id").agg(F.min("seq").alias("_born"))
    valid = events.join(first, "run_id").where(F.col("seq") >= F.col("_born"))
    is_reg = F.col("action") == "register"
    given = lambda c: F.max_by(c, F.when(is_reg & F.col(c).isNotNull(), F.col("seq"))).alias(c)
    runs = valid.groupBy("run_id").agg(
        F.max_by("action", F.when(~is_reg, F.col("seq"))).alias("_last"), F.max(F.when(~is_reg, F.col("seq"))).alias("_q"),
        F.min_by("stage", F.when(is_reg, F.col("seq"))).alias("_first_stage"),
        F.max_by("stage", F.when(is_reg, F.col("seq"))).alias("stage"), given("bundle_path"), given("tracking_id"),
        F.min("ts").alias("created_ts"), F.max("seq").alias("_own_seq"), F.max_by("ts", "seq").alias("_own_ts"))
    # read four times below: written once, so that the events are not parsed and joined again for each
    acts = stored(valid.where(F.col("action").isin(*ACTIVATING)).select("seq", "ts", "run_id"), "activations")
    last = acts.agg(F.max(F.struct("seq", "run_id")).alias("a")).first()["a"]     # one row
    g, active = (last["seq"], last["run_id"]) if last else (None, None)
    produced = F.col("_last").isin(*PRODUCTION)
    status = (F.when(F.col("_last").isNull(), F.when(F.col("_first_stage") == "train", "staging").otherwise("recorded"))
              .when(produced, F.when(F.coalesce(F.col("_q") >= F.lit(g), F.lit(True)), "production").otherwise("archived"))
              .when(F.col("_last") == "promote_staging", "staging").otherwise("canary"))
    runs = runs.withColumn("status", status)
    archived = _next_activation(runs.where("status = 'archived'").select("run_id", "_q"), acts)
    runs = runs.join(archived, "run_id", "left")
    later = F.col("_at.seq") > F.col("_own_seq")
    return runs.select("run_id", "status", F.coalesce(F.col("run_id") == F.lit(active), F.lit(False)).alias("is_active"),
                       "stage", "bundle_path", "tracking_id", "created_ts",
                       F.when(later, F.col("_at.seq")).otherwise(F.col("_own_seq")).alias("updated_seq"),
                       F.when(later, F.col("_at.ts")).otherwise(F.col("_own_ts")).alias("updated_ts"))


def _next_activation(runs: DataFrame, acts: DataFrame) -> DataFrame:
    """(run_id, _at = (seq, ts) of the first activation after ``_q``)."""
    acts = acts.select(F.floor(F.col("seq") / BLOCK).alias("block"), F.struct("seq", "ts").alias("at"))
    runs = runs.withColumn("block", F.floor(F.col("_q") / BLOCK))
    same = runs.join(acts, "block").where(F.col("at.seq") > F.col("_q")).groupBy("run_id").agg(F.min("at").alias("own"))
    heads = acts.groupBy("block").agg(F.min("at").alias("head")) \
        .unionByName(runs.select("block").distinct(), allowMissingColumns=True).groupBy("block").agg(F.min("head").alias("head")) \
        .withColumn("group", F.floor(F.col("block") / BLOCK))
    # BLOCK blocks at most in each window; then one row per BLOCK * BLOCK sequence numbers in the last one
    ahead = Window.partitionBy("group").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    heads = heads.withColumn("next", F.first("head", ignorenulls=True).over(ahead))
    beyond = Window.orderBy("group").rowsBetween(1, Window.unboundedFollowing)
    groups = heads.groupBy("group").agg(F.min("head").alias("head")).select("group", F.first("head", ignorenulls=True).over(beyond).alias("far"))
    after = heads.join(groups, "group").select("block", F.coalesce("next", "far").alias("next"))
    return runs.join(after, "block").join(same, "run_id", "left").select("run_id", F.coalesce("own", "next").alias("_at"))


def latest_runs(state: DataFrame, k: int | None = None, backed: bool = True, stage: str | None = None) -> DataFrame:
    """TOP-3 / WIN-2: runs by last update (or creation), newest first, only bundle-backed ones unless asked, only of one
    stage if given; ``k`` of them where a report wants the top."""
    out = state.where(F.col("bundle_path").isNotNull()) if backed else state
    out = out.where(F.col("stage") == stage) if stage else out
    out = out.orderBy(F.desc(F.coalesce("updated_ts", "created_ts")), F.desc("updated_seq"), "run_id")
    return out if k is None else out.limit(k)


def previous_production(state: DataFrame, exclude_run: str | None = None) -> DataFrame:
    """WIN-3: latest run with status production or archived, other than ``exclude_run`` (default: the active run)."""
    cand = state.where(F.col("status").isin("production", "archived"))
    cand = cand.where(F.col("run_id") != exclude_run) if exclude_run else cand.where(~F.col("is_active"))
    return latest_runs(cand, 1, backed=False)


def resolve_run(state: DataFrame, candidates: DataFrame, col: str = "candidate") -> DataFrame:
    """JOI-7 / REG-2: (candidate, run_id): the bundle-backed run with that id, else the bundle-backed run whose tracking id it
    is, else null."""
    backed = state.where(F.col("bundle_path").isNotNull())
    by_id = backed.select(F.col("run_id").alias(col), F.col("run_id").alias("_id"))
    by_track = backed.where(F.col("tracking_id").isNotNull()).groupBy(F.col("tracking_id").alias(col)) \
        .agg(F.min_by("run_id", "created_ts").alias("_track"))
    return candidates.join(by_id, col, "left").join(by_track, col, "left").select(
        *candidates.columns, F.coalesce("_id", "_track").alias("run_id"))


def registry_health(state: DataFrame) -> DataFrame:
    """MET-23: passed if there are runs and the active one has a bundle; ``message`` as the health check words it."""
    one = state.agg(F.count(F.lit(1)).alias("runs"), F.max(F.when(F.col("is_active"), F.col("run_id"))).alias("active_run_id"),
                    F.coalesce(F.bool_or(F.col("is_active") & F.col("bundle_path").isNotNull()), F.lit(False)).alias("passed"))
    head = F.when(F.col("passed"), F.concat(F.lit("Registry OK: "), F.col("runs").cast("string"), F.lit(" runs, active production="))) \
        .otherwise(F.concat(F.lit("Registry incomplete: runs="), F.col("runs").cast("string"), F.lit(", active_production=")))
    return one.withColumn("message", F.concat(head, F.coalesce("active_run_id", F.lit("None"))))


def live_deployment(records: DataFrame, state: DataFrame) -> DataFrame:
    """REG-3: (subject, manifest_run_id, manifest_bundle, tracker_run_id, tracker_bundle) against the registry's active
    run.  Adds ``active_run_id``, ``bundle_path`` (active entry's, else the manifest's, else the tracker's), ``errors`` and
    ``valid``; an absent record (null run id) is not compared."""
    row = state.where("is_active").select("run_id", "bundle_path").first()        # one active run at most
    active, bundle = (row["run_id"], row["bundle_path"]) if row else (None, None)
    a, m, t = F.lit(active).cast("string"), F.col("manifest_run_id"), F.col("tracker_run_id")
    path = F.coalesce(F.lit(bundle).cast("string"), "manifest_bundle", "tracker_bundle")
    mismatch = lambda name, x, y: F.when(x != y, F.concat(F.lit(name + "_run_mismatch:"), x, F.lit("!="), y))
    errors = F.array_compact(F.array(
        F.when(a.isNull(), "missing_active_production_run_id"), mismatch("deployment_manifest", m, a),
        mismatch("production_tracker", t, a), mismatch("deployment_tracker", m, t), F.when(path.isNull(), "missing_bundle_path")))
    return records.withColumn("active_run_id", a).withColumn("bundle_path", path).withColumn("errors", errors) \
                  .withColumn("valid", F.size("errors") == 0)


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))
