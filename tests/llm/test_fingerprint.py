"""Operator 5: edited texts, neighbours and the behaviour of the likeness."""

import hashlib
import random

from conftest import SF_SMALL
from pricefold.llm import fingerprint
from pricefold.llm.registry import QUERIES


def corpus():
    rng = random.Random(1)
    vocab = [f"w{n}" for n in range(400)] + ["höher", "日本語の文", "🙂"]
    texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (1, 2, 3, 4, 30, 200, 900, 40, 7, 60)]
    texts += ["", None, "   ", "x" * 3000, "日" * 50, "a b " * 500, texts[5], "word"]
    return [(i * 7 - 30, t) for i, t in enumerate(texts)] + [(5, texts[6]), (5, texts[4]), (None, texts[7])]


def ordered(rows):
    return sorted(((-(2 ** 63) if i is None else i, t or "") for i, t in rows))


def test_edited_texts_and_neighbours(docs_of, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK_ROWS", 3)
    rows = corpus()
    flat = ordered(rows)
    got = sorted(fingerprint.with_edited(docs_of(rows)).collect(), key=lambda r: (r._id, r._sub))
    prints = {}
    for k, ((i, t), r) in enumerate(zip(flat, got)):
        nxt = flat[(k + 1) % len(flat)][1]
        q = len(t) // 4
        assert (r._id, r.n_chars, r.edited) == (i, len(t), t[:len(t) - q] + nxt[:q])
        assert prints.setdefault(t, r.fp) == r.fp
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        other = got[(k + 1) % len(got)].fp
        a, b = set(r.fp), set(other)
        bins = {x >> 16 for x in a | b}
        assert r.near_next == (len(a & b) / len(bins) if bins else 1.0)
        if len(t) > 300:
            assert r.near_edited > 0.2
    assert prints["x" * 3000] != prints[""]


def test_order_matters_and_copies_are_equal(spark):
    rng = random.Random(4)
    words = [f"t{n}" for n in range(600)]
    halves = " ".join(words[:300]), " ".join(words[300:])
    swap = [" ".join(rng.sample(halves[0].split(), 300)) + " " + halves[1]]
    df = spark.createDataFrame([(0, " ".join(halves)), (1, " ".join(halves[::-1])), (2, swap[0]), (3, " ".join(halves))], "doc_id long, text string")
    fp = {r._id: r.fp for r in fingerprint.fingerprints(df).collect()}
    like = lambda a, b: len(set(fp[a]) & set(fp[b])) / len({x >> 16 for x in set(fp[a]) | set(fp[b])})
    assert like(0, 3) == 1.0
    assert 0.3 < like(0, 1) < 0.8          # same k-mers, halves swapped
    assert like(0, 2) < like(0, 1)


def test_small_tables(docs_of):
    one, = fingerprint.with_edited(docs_of([(1, "a b c d e f g h")])).collect()
    assert one.near_next == 1.0
    assert fingerprint.with_edited(docs_of([]).where("doc_id = 1")).count() == 0


def test_given_table(spark):
    docs = ordered((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op5_document_fingerprints"](spark, SF_SMALL).collect()}
    for k, (i, t) in enumerate(docs):
        nxt, q = docs[(k + 1) % len(docs)][1], len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - q] + nxt[:q]).encode()).hexdigest()
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.3 > 0.05 > sum(r.near_next for r in long) / len(long)


def plain_fingerprint(text):
    """The docstring's four steps, one k-mer at a time, with the xxhash library."""
    import re
    import struct

    import xxhash
    number = lambda v, seed, form: xxhash.xxh64(struct.pack(form, v), seed=seed).intdigest()          # noqa: E731
    tokens = [xxhash.xxh64(t.encode(), seed=42).intdigest() for t in re.findall(r"[^ \t\n\x0b\f\r]{1,%d}" % fingerprint.PIECE, text)]
    kmers, seen = [], {}
    for i, x in enumerate(tokens):
        h = number(x, 42, "<Q")
        if i + 1 < len(tokens):
            h = number(tokens[i + 1], h, "<Q")
        kmers.append(h >> fingerprint.POS_BITS)
    ranked = []
    for i, k in enumerate(kmers):
        seen[k] = seen.get(k, 0) + 1
        h = number(seen[k] - 1, number(k, 42, "<Q"), "<i") >> 1
        ranked.append((h >> fingerprint.POS_BITS, i))
    out = []
    for b in range(fingerprint.BINS):
        two = sorted(r for r in ranked if r[0] >> (63 - fingerprint.BIN_BITS - fingerprint.POS_BITS) == b)[:2]
        if two:
            h = 42
            for rank, _ in sorted(two, key=lambda r: r[1]):
                h = number(rank, h, "<Q")
            out.append(b << 16 | h & 0xFFFF)
    return out


def test_fingerprints_equal_the_plain_ones(docs_of):
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 8000]
    got = sorted(fingerprint.fingerprints(docs_of(rows)).collect(), key=lambda r: (r._id, r._sub))
    assert [(r._id, list(r.fp)) for r in got] == [(i, plain_fingerprint(t)) for i, t in ordered(rows)]
