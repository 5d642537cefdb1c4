"""Operator 13: exact round trips, the machine over blocks, and digests against a plain loop."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricefold.llm import chat_format as T

PARTS = [*"<>/s[]INSTAYRO ␛\n", "<s>", "</s>", "[INST]", "<<SYS>>", "␛␛", "[/INST]", "é", "😀"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=20).map("".join)
KIND = "conv_id long, turn long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXTS), TEXTS), max_size=6))
def test_any_turns_come_back_from_the_joined_text(turns):
    emit, read = T.turn_segments(T.INSTRUCT), T.reader(T.INSTRUCT)
    parts = [s for role, text in turns for s in emit(role, text)]
    assert read(T.INSTRUCT.opening + "".join(t for t, _ in parts)) == turns
    unescape = T.INSTRUCT.unescaper()
    assert [unescape(t) for t, loss in parts if loss] == [text for role, text in turns if role == "assistant"]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_no_control_string_is_left_in_a_text(text):
    out = T.INSTRUCT.escaper()(text)
    assert not any(c in out for c in T.INSTRUCT.controls) and T.INSTRUCT.unescaper()(out) == text


@pytest.mark.parametrize("change", [
    dict(escape="["), dict(controls=("[INST]", "x")), dict(others=T.INSTRUCT.roles["user"]),
    dict(others=(("[ROLE]", False), ("{text}", False), (" [/ROLE]", False))),
    dict(others=(("[ROLE] ", False), ("{role}", False), ("{text}", False), (" [/ROLE]", False)))])
def test_ambiguous_templates_are_refused(change):
    own = dict(roles=T.INSTRUCT.roles, others=T.INSTRUCT.others, order=T.INSTRUCT.order, controls=T.INSTRUCT.controls)
    with pytest.raises(ValueError):
        T.Template(**{**own, **change})


def brute(rows):
    """{conv: (n_turns, turns sha, loss chars, loss sha, formatted chars, valid)} by a loop over sorted turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        emit, state, valid = T.turn_segments(T.INSTRUCT), T.INSTRUCT.states[0], True
        for *_, role, _ in turns:
            state = T.INSTRUCT.step(state, role)
            valid &= state != T.BROKEN
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for *_, role, x in turns)
        chars = len(T.INSTRUCT.opening) + sum(len(t) for *_, role, x in turns for t, _ in emit(role, x))
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars, valid)
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], KIND + ", block int, segments string, valid boolean").repartition(3)
    return {(r._id if r._id != T.C.NULL_ID else None): (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars, r.valid)
            for r in T.read_back(T.format_conversations(df)).collect()}


def test_short_broken_and_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "first"), (2, 1, "user", None),
            (3, 0, "system", "s"), (3, 1, "system", "s"), (4, 5, "tool", "</s>"), (4, 5, "tool", "</s>"), (4, None, None, "␛"),
            (None, 0, "user", "x"), (None, 0, "user", "x"), (5, 0, "user", ""), (6, -3, "user", "[INST]"), (6, 2, "assistant", "y" * 200_000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:2]) == brute(rows[:2])
    assert T.read_back(T.format_conversations(spark.createDataFrame([], KIND))).count() == 0


@pytest.mark.parametrize("wrong", [None, 0, 130, 131, 499])
def test_a_long_conversation_is_dealt_in_blocks(spark, monkeypatch, wrong):
    monkeypatch.setattr(T, "BLOCK", 10)
    monkeypatch.setattr(T, "FOLD", 4)
    rows = [(9, n, ("user", "assistant")[n % 2] if n != wrong else "assistant" if n % 2 == 0 else "user", f"t{n}") for n in range(500)]
    rows += [(8, n, ("system", "user", "assistant")[n] if n < 3 else ("assistant", "user")[n % 2], "<s>") for n in range(25)] + [(7, 3, "user", "u")]
    assert got(spark, rows) == brute(rows)
    turns = T.format_conversations(spark.createDataFrame(rows, KIND)).where("_id = 9").collect()
    assert len({r.block for r in turns}) == 50 and sorted(r.turn for r in turns if not r.valid) == ([] if wrong is None else list(range(wrong, 500)))
    assert sum(s.text == "<s>" for r in turns for s in r.segments) == 1


def test_query_matches_its_sql(spark):
    import duckdb
    duckdb.sql("create or replace temp view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    out = T.op13_chat_formatting(spark, "/root/testdata/sf0.001")
    want = duckdb.sql(T._oracle(T.INSTRUCT))
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(tuple, out.select(want.columns).collect())) == sorted(want.fetchall())
