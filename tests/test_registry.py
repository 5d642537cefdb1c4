"""Registry states against an ordered replay of the rules, and the lookups over them."""

import random

import pytest
from pyspark.sql import functions as F

from pricefold.operators import registry as REG

SCHEMA = "seq long, run_id string, action string, stage string, bundle_path string, tracking_id string"


def _events(spark, events):
    rows = [(i, *(e + (None,) * (5 - len(e)))) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("seq")))


def _reg(run, stage="train", bundle=True, track=None):
    return (run, "register", stage, f"runs/{run}/bundle" if bundle else None, track)


def _state(spark, events):
    return {r["run_id"]: (r["status"], r["is_active"]) for r in REG.run_state(_events(spark, events)).collect()}


def test_production_can_be_approved_without_activation(spark):
    s = _state(spark, [_reg("A"), _reg("B"), ("A", "promote_production"), ("B", "approve_production")])
    assert s == {"A": ("production", True), "B": ("production", False)}


def test_activation_switches_and_archives(spark):
    s = _state(spark, [_reg("A"), _reg("B"), ("A", "promote_production"), ("B", "approve_production"), ("B", "activate")])
    assert s == {"A": ("archived", False), "B": ("production", True)}


def test_first_status_follows_the_stage_and_registering_again_keeps_it(spark):
    s = _state(spark, [_reg("A"), _reg("P", "promotion"), ("A", "activate"), _reg("A")])
    assert s == {"A": ("production", True), "P": ("recorded", False)}


def test_action_before_register_is_rejected(spark):
    assert _state(spark, [("A", "activate"), _reg("A"), ("C", "promote_canary")]) == {"A": ("staging", False)}


def _replay(events):
    runs, active = {}, None
    for seq, e in enumerate(events):
        run, action, stage, bundle, track = e + (None,) * (5 - len(e))
        if action == "register":
            r = runs.setdefault(run, {"status": "staging" if stage == "train" else "recorded", "created": seq})
            r.update(stage=stage, bundle=bundle or r.get("bundle"), track=track or r.get("track"), updated=seq)
        elif run in runs:
            turns_on = action in ("promote_production", "activate", "rollback")
            if turns_on:
                for name, r in runs.items():
                    if name != run and r["status"] == "production":
                        r.update(status="archived", updated=seq)
                active = run
            status = "production" if turns_on or action == "approve_production" else action.split("_")[1]
            runs[run].update(status=status, updated=seq)
    return {n: (r["status"], n == active, r["stage"], r["bundle"], r["track"], r["created"], r["updated"]) for n, r in runs.items()}


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 7), (3, 1)])
def test_states_equal_an_ordered_replay(spark, monkeypatch, seed, block):
    monkeypatch.setattr(REG, "BLOCK", block)
    rng = random.Random(seed)
    actions = ["register"] * 3 + ["promote_staging", "promote_canary", "approve_production", "promote_production", "activate", "rollback"]
    events = []
    for _ in range(300):
        run, action = f"r{rng.randrange(25)}", rng.choice(actions)
        events.append((run, action) if action != "register" else
                      _reg(run, rng.choice(["train", "promotion"]), rng.random() < 0.6, rng.choice([None, f"t{run}"])))
    got = {r.run_id: (r.status, r.is_active, r.stage, r.bundle_path, r.tracking_id, int(r.created_ts.timestamp()), r.updated_seq)
           for r in REG.run_state(_events(spark, events)).collect()}
    assert got == _replay(events)


def test_ids_resolve_to_the_bundle_backed_run(spark):
    st = REG.run_state(_events(spark, [_reg("train_20260315T123659Z", track="legacy_id_123"), _reg("legacy_id_123", "promotion", False)]))
    ids = spark.createDataFrame([("train_20260315T123659Z",), ("legacy_id_123",), ("nobody",)], "candidate string")
    got = {r.candidate: r.run_id for r in REG.resolve_run(st, ids).collect()}
    assert got == {"train_20260315T123659Z": "train_20260315T123659Z", "legacy_id_123": "train_20260315T123659Z", "nobody": None}


def test_previous_production_is_the_last_archived(spark):
    st = REG.run_state(_events(spark, [_reg("A"), _reg("B"), _reg("C"), ("A", "activate"), ("B", "activate"), ("B", "register"),
                                       ("A", "rollback"), ("C", "activate")]))
    assert REG.previous_production(st).first()["run_id"] == "A"      # archived by C's activation, after B
    assert {r.run_id for r in REG.latest_runs(st, 2).collect()} == {"A", "C"}      # one activation updated both


def test_health_and_live_deployment(spark):
    st = REG.run_state(_events(spark, [_reg("A"), _reg("B", bundle=False), ("A", "activate")]))
    h = REG.registry_health(st).first()
    assert h.passed and h.message == "Registry OK: 2 runs, active production=A"
    rows = [("fine", "A", "x", "A", "y"), ("stale", "B", "x", "A", "y"), ("apart", "A", None, "B", None), ("none", None, None, None, None)]
    rec = spark.createDataFrame(rows, "subject string, manifest_run_id string, manifest_bundle string, tracker_run_id string, tracker_bundle string")
    got = {r.subject: list(r.errors) for r in REG.live_deployment(rec, st).collect()}
    assert got == {"fine": [], "none": [], "stale": ["deployment_manifest_run_mismatch:B!=A", "deployment_tracker_run_mismatch:B!=A"],
                   "apart": ["production_tracker_run_mismatch:B!=A", "deployment_tracker_run_mismatch:A!=B"]}
    idle = REG.run_state(_events(spark, [_reg("B", bundle=False)]))
    assert not REG.registry_health(idle).first().passed
    got = {r.subject: (list(r.errors), r.bundle_path) for r in REG.live_deployment(rec, idle).collect()}
    assert got["none"] == (["missing_active_production_run_id", "missing_bundle_path"], None)
    assert got["fine"] == (["missing_active_production_run_id"], "x")
