"""Operators 1 and 6 against brute force on whole texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from conftest import SF_SMALL
from pricefold.llm import substring_dedup, suffix_dedup
from pricefold.llm.registry import QUERIES


def ordered(rows):
    return sorted(((-(2 ** 63) if i is None else i, t or "") for i, t in rows))


def brute_bytes(rows, window=100):
    seen, out = set(), []
    for i, text in ordered(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for a in range(len(data) - window + 1):
            w = data[a:a + window]
            if w in seen:
                gone[a:a + window] = b"\1" * window
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((None if i == -(2 ** 63) else i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, window=13):
    first, docs = {}, []
    for n, (i, text) in enumerate(ordered(rows)):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        docs.append((i, n, words))
        for a in range(len(words) - window + 1):
            first.setdefault(tuple(words[a:a + window]), n)
    out = []
    for i, n, words in docs:
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            if first[tuple(words[a:a + window])] < n:
                gone[a:a + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((None if i == -(2 ** 63) else i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "tea", "höher", "日本", "a", "b", "run on", "x" * 30]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 200))) for _ in range(25)]
    texts += [t[:len(t) // 2] + " " + passage + "\n\t " + t[len(t) // 2:] for t in texts[:12]]
    texts += [texts[3]] * 4 + [passage] * 3 + ["", None, "   ", "a" * 700, "ab" * 400, "a" * 150, "tea " * 90]
    texts += [passage[:-7] + " new end " + passage[5:], passage * 3]
    ids = rng.sample(range(-50, 500), len(texts))
    rows = list(zip(ids, texts))
    return rows + [rows[2], (rows[4][0], texts[9]), (None, texts[5]), (None, None)]   # repeats, ties, null ids


@pytest.mark.parametrize("seed,hot,shard", [(1, 20_000, 2 << 20), (2, 2, 3000)])
def test_suffix_dedup_is_exact(spark, docs_of, seed, hot, shard):
    rows = corpus(seed)
    got = suffix_dedup.dedup(docs_of(rows), hot=hot, shard_bytes=shard).collect()
    got = sorted(((None if r._id == -(2 ** 63) else r._id, r.n_bytes, r.n_removed, r.n_spans,
                   hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr)
    assert got == brute_bytes(rows)


def test_a_passage_after_many_contexts_is_dealt_to_bounded_shards(spark, docs_of, monkeypatch):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(i, f"{rng.random()}" * 4 + passage + f"{rng.random()}" * 4) for i in range(150)]
    rows += [(500 + i, "x" * i + passage[:115] + passage) for i in range(20)] + [(None, passage), (3, rows[3][1])]
    dealt, of = [], suffix_dedup.shard_repeats

    def shard_repeats(rows, window, shard_bytes, places=False):
        most = rows.groupBy("shard").agg({"*": "count"}).agg({"count(1)": "max"}).first()[0] or 0
        dealt.append((most, places))
        return of(rows, window, shard_bytes, places)

    monkeypatch.setattr(suffix_dedup, "shard_repeats", shard_repeats)
    for shard in (1000, 2500):               # 170 places of a window, 5 or 12 to a sub-shard
        got = suffix_dedup.dedup(docs_of(rows), hot=2, shard_bytes=shard).collect()
        got = sorted(((None if r._id == -(2 ** 63) else r._id, r.n_bytes, r.n_removed, r.n_spans,
                       hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr)
        assert got == brute_bytes(rows)
    windows = spark.createDataFrame([(7, i, 0, 0, bytearray(b"w" * 100)) for i in range(400)], suffix_dedup.SHARDED)
    spans = sorted(tuple(r) for r in suffix_dedup.hot_repeats(windows, shard_bytes=4000).collect())
    assert spans == [(i, 0, 0, 100) for i in range(1, 400)]
    assert any(places for _, places in dealt) and max(most for most, _ in dealt) <= 60      # of 400 places


def test_substring_dedup_is_exact(spark, docs_of):
    rows = corpus(3)
    got = substring_dedup.dedup(docs_of(rows)).collect()
    got = sorted(((None if r._id == -(2 ** 63) else r._id, r.n_words, r.n_removed,
                   hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=repr)
    assert got == brute_words(rows)


@pytest.mark.parametrize("op", [suffix_dedup, substring_dedup])
def test_empty_table(spark, docs_of, op):
    assert op.dedup(docs_of([]).where("doc_id = 1")).count() == 0


def test_op1_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op1_suffix_array_dedup"](spark, SF_SMALL).collect()), key=repr)
    assert got == brute_bytes(rows)


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(5)
    for _ in range(200):
        t = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 80)), 0).astype(np.int16)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        sa = suffix_dedup.suffix_array(t, 8, len(t))
        assert sa.tolist() == want
        lcp = suffix_dedup.common_prefixes(t, sa, 9)
        for x, y in zip(want[1:], want[:-1]):
            n = 0
            while n < 9 and max(x, y) + n < len(t) and t[x + n] == t[y + n]:
                n += 1
            assert lcp[x] == n


def brute_paths(rows, window):
    """Edges that occur in two documents or more, compacted: {source place: source place of the path's first edge}."""
    where = {}
    for n, text in enumerate(rows):
        words = text.split()
        for a in range(len(words) - window + 1):
            where.setdefault(tuple(words[a:a + window]), []).append((n, a))
    source = {e: min(at) for e, at in where.items() if len({n for n, _ in at}) > 1}
    into, out = {}, {}
    for e in source:
        into.setdefault(e[1:], []).append(e)
        out.setdefault(e[:-1], []).append(e)
    before = {}
    for node, (a, *more) in into.items():
        after = out.get(node, [])
        if not more and len(after) == 1 and (source[a][0], source[a][1] + 1) == source[after[0]]:
            before[after[0]] = a

    def first(e):
        while e in before:
            e = before[e]
        return e
    return {source[e]: source[first(e)] for e in source}


def test_paths_are_the_compacted_graph(spark):
    """All windows as edges, window of four words; many nodes branch, and dropping the node joins would change the paths."""
    window, rng = 4, random.Random(8)
    base = [rng.choice("abcdefgh") for _ in range(120)]
    texts = [" ".join(base), " ".join(base[10:50] + ["x"] + base[51:90]), " ".join(base[30:70] + base[5:40])]
    texts += [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(4)] + [" ".join(base[30:70] + ["y", "z"] + base[80:])]
    node = lambda ws: int.from_bytes(hashlib.sha256(" ".join(ws).encode()).digest()[:8], "big", signed=True)     # noqa: E731
    edges = [(node(w[a:a + window - 1]), node(w[a + 1:a + window]), node(w[a:a + window]), n, 0, a)
             for n, w in enumerate(t.split() for t in texts) for a in range(len(w) - window + 1)]
    hits = substring_dedup.sources(spark.createDataFrame(edges, substring_dedup.EDGES).repartition(5))
    got = {(r.src_id, r.src_pos): (r.src_id, r.path) for r in substring_dedup.compacted(hits).collect()}
    want = brute_paths(texts, window)
    assert got == want and 1 < len(set(want.values())) < len(want)
    spans = substring_dedup.spans_of(hits, substring_dedup.compacted(hits), window).collect()
    words = [t.split() for t in texts]
    covered = {(s._id, p) for s in spans for p in range(s.start, s.end)}
    assert covered == {(h._id, p) for h in hits.collect() for p in range(h.pos, h.pos + window)}
    for s in spans:                                       # the words at the source coordinates are the span's
        assert words[s.src_id][s.src_start: s.src_start + s.end - s.start] == words[s._id][s.start: s.end]
    assert max(s.end - s.start for s in spans) > 3 * window
