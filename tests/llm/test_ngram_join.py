"""Operator 4 against all pairs compared by brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from pricefold.llm import common, ngram_join
from pricefold.llm.registry import QUERIES

LOW = -(2 ** 63)


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    keys, seen = [], defaultdict(int)
    for i, t in sorted(((LOW if i is None else i, t or "") for i, t in rows)):
        keys.append(((i, seen[i]), t))
        seen[i] += 1
    first, copies = {}, defaultdict(int)
    for k, t in sorted(keys):
        first.setdefault(t, k)
        copies[t] += 1
    texts = sorted(first, key=first.get)
    sets = [shingle_set(t) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    links[a] += 1
                    links[b] += 1
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    at = {t: n for n, t in enumerate(texts)}
    return sorted((*k, *first[t], copies[t], *first[texts[find(at[t])]], links[at[t]]) for k, t in keys)


def near(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{n}" for n in range(3000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 40, 120, 300]))) for _ in range(60)]
    for base in texts[:20]:
        words = base.split()
        texts += [near(rng, words, c) for c in (0, 1, 2, 3) if len(words) > 30]
        texts += [base + " tail", base.replace(" ", "\n", 3)]
    family = [rng.choice(vocab) for _ in range(400)]
    texts += [near(rng, family, 3) for _ in range(90)]                       # one large near group
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(60)) for _ in range(90)]   # a shared passage
    texts += ["", None, "  ", "a", "a", "a a a a a a a a", "a a a a a a", texts[70]] + [family and " ".join(family)] * 4
    ids = rng.sample(range(-100, 5000), len(texts))
    rows = list(zip(ids, texts))
    return rows + [rows[3], (rows[5][0], texts[80]), (None, texts[6]), (None, None)]


@pytest.mark.parametrize("seed,limit,block", [(1, 64, 512), (2, 6, 7)])
def test_every_link_and_group(spark, docs_of, seed, limit, block):
    rows = corpus(seed)
    got = ngram_join.near_duplicates(docs_of(rows), limit=limit, block=block).collect()
    got = sorted((r._id, r._sub, r.text_id, r.text_sub, r.n_copies, r.group_id, r.group_sub, r.n_links) for r in got)
    assert got == brute(rows)


def test_a_shared_leaf_behind_one_sided_leaves_is_followed(spark):
    # documents 1 and 2 share leaf 100 only; their smaller leaves, made by splits, have other members
    n = ngram_join.KEPT + 3
    rows = [(p, 1, 0, True) for p in [*range(n), 100]] + [(p, 3, 0, True) for p in range(n)]
    rows += [(50 + p, 2, 0, True) for p in range(n)] + [(50 + p, 4, 0, True) for p in range(n)] + [(100, 2, 0, True)]
    buckets = spark.createDataFrame(rows, "path long, _id long, _sub int, split boolean")
    sketch = {1: b"a" * 32, 2: b"a" * 32, 3: b"b" * 32, 4: b"c" * 32}
    reps = spark.createDataFrame([(i, 0, 100, bytearray(s)) for i, s in sketch.items()], "_id long, _sub int, n int, sketch binary")
    got = ngram_join.block_groups(buckets, reps).collect()
    assert sorted((r.path, r._id) for r in got) == [(100, 1), (100, 2)]


def test_split_buckets_mark_their_members(spark, docs_of):
    passage = " ".join(f"p{n}" for n in range(30))
    rows = [(i, passage + " " + " ".join(f"x{i}y{n}" for n in range(90))) for i in range(40)] + [(90, "z1 z2 z3 z4 z5 z6"), (91, "z1 z2 z3 z4 z5 z6 z7")]
    docs = ngram_join.C.keyed(docs_of(rows))
    got = ngram_join.final_buckets(docs, ngram_join.signatures(docs), limit=6).collect()
    split = {r._id for r in got if r.split}
    assert set(range(40)) <= split and not split & {90, 91}
    assert {90, 91} <= {r._id for r in got if r.path is not None}


def test_the_computed_miss_at_the_threshold_holds_on_every_split_level():
    # one set inside the other at 0.8: shared picks per run are Poisson(0.8 * PICKS); a split repeats that below each path
    mean, none = ngram_join.SIMILARITY * ngram_join.PICKS, 0.0
    same = ngram_join.SIMILARITY + (1 - ngram_join.SIMILARITY) / 256
    unlike = sum(math.comb(ngram_join.SKETCH, k) * same ** k * (1 - same) ** (ngram_join.SKETCH - k) for k in range(ngram_join.ALIKE))
    for level in range(ngram_join.DEPTH):
        none = math.exp(-mean * (1 - none))
        miss = none ** ngram_join.RUNS + unlike
        if level == 0:             # unsplit: KEPT leaves of one side alone come before the first shared one, on either side
            miss += 2 * (1 - ngram_join.SIMILARITY) ** ngram_join.KEPT
        assert miss < 1e-5


def test_keep_one_returns_the_columns_of_the_input(spark, docs_of):
    rows = corpus(4)
    docs = docs_of(rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r[5:7] for r in brute(rows)}
    assert kept.count() == len(groups)


def test_a_similarity_below_the_tuned_one_is_refused(spark, docs_of):
    words = [f"w{n}" for n in range(104)]
    docs = docs_of([(1, " ".join(words)), (2, " ".join(words[:94])), (3, " ".join(words[:86]))])     # 100, 90 and 82 shingles
    for low in (0.5, 0.79, 1.1):
        with pytest.raises(ValueError, match="similarity"):
            ngram_join.near_duplicates(docs, similarity=low)
    got = {s: sorted((r._id, r.n_links) for r in ngram_join.near_duplicates(docs, similarity=s).collect()) for s in (0.8, 0.9)}
    assert got == {0.8: [(1, 2), (2, 2), (3, 2)], 0.9: [(1, 1), (2, 2), (3, 1)]}


def test_empty_table(spark, docs_of):
    assert ngram_join.near_duplicates(docs_of([]).where("doc_id = 1")).count() == 0


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = sorted((a, c, n, g, m) for a, _, c, _, n, g, _, m in brute(rows))
    assert sorted(tuple(r) for r in QUERIES["op4_ngram_jaccard_join"](spark, SF_SMALL).collect()) == want


def test_documents_that_follow_many_paths_are_compared_in_bounded_memory():
    """The 0/1 matrix of documents and followed paths used to be held whole."""
    import tracemalloc
    rng = np.random.default_rng(5)
    m, own = 400, 400
    follows = [np.sort(rng.choice(1 << 40, own, replace=False)) for _ in range(m)]
    follows[7] = np.sort(np.concatenate([follows[7], follows[300][200:201]]))
    n, sketch, place = np.full(m, 50), np.zeros((m, ngram_join.SKETCH), np.uint8), np.arange(m)
    tracemalloc.start()
    left, right, ok = ngram_join._pairs_allowed(place, place, n, np.full(m, 2), sketch, follows, 1 << 41, True, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.triu(np.ones((m, m), bool), 1)
    want[7, 300] = False
    assert (ok == want).all()
    assert peak < 100e6


def test_a_worker_keeps_little_after_signing(monkeypatch):
    """The rolling hashes' powers grow with the text handled at once and stay in the worker."""
    import pyarrow as pa
    for r in ("ROLL_A", "ROLL_B"):
        monkeypatch.setattr(common, r, common.Rolling(getattr(common, r).base))
    texts = [" ".join(f"w{i}_{j}" for j in range(1000)) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([0] * 400, pa.int32()), pa.array(texts)], names=["_id", "_sub", "_text"])

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    assert sum(b.num_rows for b in ngram_join.signatures(Rows())(iter([batch]))) == 400
    assert sum(p.nbytes for r in (common.ROLL_A, common.ROLL_B) for p in (r.up, r.down)) <= 16 << 20
