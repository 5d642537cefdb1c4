"""Operator 8 against a brute-force scan, and against its SQL twin."""

import hashlib
import random
import re

import duckdb
import pytest

from conftest import SF_SMALL
from pricefold.llm import decontaminate as D
from pricefold.llm.registry import ORACLES, QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                names = windows.get(tuple(w[a:a + size]))
                if names:
                    hit |= set(range(a, a + size))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, docs_of, seed):
    rng = random.Random(seed)
    vocab = ["the", "Of", "tea", "HÖHE", "日本", "x9", "a"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))            # noqa: E731
    items = [(n, say(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for n in range(14)] + [(50, ""), (51, None), (52, "--"), (None, say(15))]
    items = [(n, t) for n, t in items if n is None or len(words(t)) != 1 or n % 3] + [(60, items[3][1])]
    docs = [(n, say(rng.choice([0, 3, 40, 200]))) for n in range(30)]
    docs += [(100 + n, say(30) + " " + (t or "").upper() + " " + say(300)) for n, t in items[:10]]
    docs += [(200, None), (201, ""), (202, "tea " * 30_000), (None, items[0][1]), (3, docs[3][1]), (3, "tea")]
    table = spark.createDataFrame([(n, t, "x") for n, t in items], "item_id long, text string, n_words string")
    out = D.decontaminate(docs_of(docs), table).collect()
    got = sorted(((None if r._id == -(2 ** 63) else r._id, r.n_words, r.n_hit, r.n_items,
                   hashlib.sha256(r["items"].encode()).hexdigest(), r.contaminated) for r in out), key=repr)
    assert got == brute(docs, items)
    clean = D.keep_clean(docs_of(docs), table)
    assert clean.columns == docs_of(docs).columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((g[0] for g in got if not g[5]), key=repr)
    for r in out:                        # spans are byte offsets of the hit words
        text = dict((i, t) for i, t in docs if i not in (3,)).get(r._id)
        if text:
            assert sum(len(words(text.encode()[s.start:s.end].decode())) for s in r.hits) == r.n_hit


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in D.decontaminate(docs_of([(1, "a b")]), none).collect()} == {(0, False)}
    assert D.decontaminate(docs_of([]).where("doc_id = 1"), none).count() == 0


def test_a_large_benchmark_is_refused(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "MAX_ITEM_BYTES", 10)
    with pytest.raises(ValueError, match="test items"):
        D.build_automaton(spark.createDataFrame([(1, "many words of an item")], "item_id long, text string"))


@pytest.mark.parametrize("group", [150, 5000])
def test_more_items_than_one_automaton_holds(spark, docs_of, monkeypatch, group):
    rng = random.Random(7)
    vocab = ["the", "Of", "tea", "HÖHE", "日本", "x9", "a", "b", "c", "d"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))                                      # noqa: E731
    items = [(n, say(rng.choice([2, 4, 6, 12, 13, 14, 30, 90]))) for n in range(40)] + [(50, ""), (51, None), (52, "--"), (None, say(15))]
    items += [(60, items[3][1])]
    docs = [(n, say(rng.choice([0, 3, 40, 200]))) for n in range(30)]
    docs += [(100 + n, say(30) + ", " + (t or "").upper() + " " + say(300)) for n, t in items[:20]]
    docs += [(200, None), (201, ""), (None, items[0][1]), (3, docs[3][1]), (3, "tea"), (300, items[5][1] + " " + items[9][1])]
    table = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    whole = {(r._id, r._sub): r for r in D.decontaminate(docs_of(docs), table).collect()}
    monkeypatch.setattr(D, "MAX_ITEM_BYTES", 10)
    monkeypatch.setattr(D, "GROUP_BYTES", group)
    monkeypatch.setattr(D, "SPLIT_DOCS", 7)
    out = D.decontaminate(docs_of(docs), table).collect()
    assert {(r._id, r._sub): r for r in out} == whole and len(out) == len(docs)
    got = sorted(((None if r._id == -(2 ** 63) else r._id, r.n_words, r.n_hit, r.n_items,
                   hashlib.sha256(r["items"].encode()).hexdigest(), r.contaminated) for r in out), key=repr)
    assert got == brute(docs, items)
    clean = D.keep_clean(docs_of(docs), table)
    assert clean.columns == docs_of(docs).columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((g[0] for g in got if not g[5]), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    res = con.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    df = QUERIES[name](spark, SF_SMALL).select(*cols)
    assert sorted(map(tuple, df.collect())) == sorted(res.fetchall())
