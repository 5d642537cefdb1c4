"""Operators 7 and 10: held-out accuracy, what may feed a score, and edge cases; operator 7's chain by enumeration."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pricefold.llm import common as C
from pricefold.llm import quality, toxicity
from pricefold.llm.registry import QUERIES

SF = {"quality": "/root/testdata/sf0.01", "toxic": "/root/testdata/sf0.1"}    # toxic labels are too few in the smaller table


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name,label,cut,least", [("op10_quality_classifier", "quality", 0.3, 0.97), ("op7_toxicity", "toxic", 0.5, 0.9)])
def test_held_out_accuracy(spark, name, label, cut, least):
    sf = SF[label]
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert sorted(rows) == sorted(r.doc_id for r in docs)
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in y if rows[i].held_out]
    truth = np.array([y[i] for i in held])
    assert auc(np.array([rows[i].score for i in held]), truth) > least
    assert np.mean([rows[i].predicted == y[i] for i in held]) > 0.93


def corpus():
    rng = random.Random(3)
    vocab = ["the", "of", "river", "höhe", "日本", "tea"]
    texts, labels = [], []
    for i in range(120):
        bad = i % 2
        words = [rng.choice(vocab) for _ in range(rng.randrange(3, 60))]
        if bad:
            words[rng.randrange(len(words))] = "vileword"
            words = [w + "!!" for w in words]
        texts.append((i, " ".join(words)))
        labels.append((i, 1 - bad, bad))
    return texts, labels


@pytest.mark.parametrize("op", [quality, toxicity])
def test_edge_cases(spark, docs_of, op):
    texts, labels = corpus()
    rows = texts + [(500, None), (501, ""), (502, " \n "), (503, "the " * 40_000), (None, "the"), (None, None), (7, texts[7][1]), (7, "other")]
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (999, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    got = op.score(docs, op.fit(docs, table)).collect()
    assert sorted((r._id, r._sub) for r in got)[:2] == [(C.NULL_ID, 0), (C.NULL_ID, 1)]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    score = {(r._id, r._sub): r.score for r in got}
    assert score[500, 0] == score[501, 0]
    # labels of fold 0 and everything but the text change nothing
    flipped = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, t) for i, q, t in labels]
    again = spark.createDataFrame(flipped + [(None, 1, 1), (3, None, None), (999, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    same = {(r._id, r._sub): r.score for r in op.score(docs, op.fit(docs, again)).collect()}
    assert same == score


@pytest.mark.parametrize("op", [quality, toxicity])
def test_without_labels_and_without_documents(spark, docs_of, op):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = docs_of(corpus()[0][:20])
    assert {r.score for r in op.score(docs, op.fit(docs, none)).collect()} == {0.5}
    assert {r.score for r in op.score(docs, op.fit(docs, one)).collect()} == {1.0}
    empty = docs_of([]).where("doc_id = 1")
    assert op.score(empty, op.fit(empty, one)).count() == 0


def test_keep_good_keeps_all_columns(spark, docs_of):
    texts, labels = corpus()
    docs = docs_of(texts)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = quality.keep_good(docs, model)
    want = {r._id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    good = {i for i, q, _ in labels if q}
    assert len(want & good) > 0.9 * len(good)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain(1)
    chain.move, chain.begin = rng.normal(size=(2, 2)), 0.4
    e = rng.normal(size=(5, 2))
    size = np.array([5, 3])
    got = chain.marginals(e, size)
    for k, n in enumerate(size):
        weight = {}
        for tags in itertools.product((0, 1), repeat=int(n)):
            s = chain.begin * tags[0] + sum(e[i, k] * t for i, t in enumerate(tags))
            weight[tags] = np.exp(s + sum(chain.move[a, b] for a, b in zip(tags, tags[1:])))
        for i in range(n):
            assert got[i, k] == pytest.approx(sum(w for t, w in weight.items() if t[i]) / sum(weight.values()))


def test_spans_are_byte_offsets_of_toxic_words(spark, docs_of):
    texts, labels = corpus()
    docs = docs_of(texts)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in toxicity.score(docs, model).collect():
        raw = dict(texts)[r._id].encode()
        assert all(raw[s.start:s.end] == b"vileword" for s in r.spans)
        assert bool(r.spans) == (b"vileword" in raw)


def test_pooling_is_independent_of_the_batch():
    texts = ["tea of the", "", "the the the the", "x | y | z !!"]
    v = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    whole = quality.pooled(*C.buffer_of(pa.array(texts)), v)
    alone = np.concatenate([quality.pooled(*C.buffer_of(pa.array([t])), v) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5)
