"""Operator 11 against a plain two-pointer pass over the libraries' own encodings of whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pricefold.llm import common as C
from pricefold.llm import cross_align as X

ODD = [None, "", " ", "  ", "a", " a  b ", "don't stop", "tea \u2581for two", "x\u2581 y z", "<|endoftext|> </s> <s>[INST]",
       "a\u00a0 b \u00a0c", "a\u3000 b \u3000c", "ﬁne Ⅳ ½ e\u0301", "nul\x00 byte", "line\n two\n\n three \t four", "日本 語 テキスト",
       "emoji 😀 😀😀 x", "a" * 3000, "\u2028 \u2029 x", "\x85 x", "trail   ", "word " * 700, "\ufeff bom", "the the the"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    path_a, path_b = X.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def brute(rows, libraries):
    """{doc: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)} by the contract's words."""
    a, b = libraries
    to_byte = X.byte_of_mark()
    links, out = {}, {}
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        ids = a.encode(whole.decode(), add_special_tokens=False).ids, b.encode(text or "")
        spelt = ([bytes(to_byte[c] for c in a.id_to_token(t)) if t != 50256 else b"<|endoftext|>" for t in ids[0]],
                 [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("\u2581", " ").encode() for t in ids[1]])
        if not text or any(b"".join(s) != whole for s in spelt):
            out[i], links[i] = (0, 0, 0, ""), []
            continue
        at = [dict(zip(np.cumsum([len(t) for t in s]).tolist(), range(len(s)))) for s in spelt]
        both = sorted(at[0].keys() & at[1].keys())
        links[i] = [(ids[0][at[0][e]], ids[1][at[1][e]]) for e in both]
        groups, pa_, pb_ = [], 0, 0
        for e in both:
            x, y = at[0][e] + 1, at[1][e] + 1
            groups.append(",".join(map(str, ids[0][pa_:x])) + "|" + ",".join(map(str, ids[1][pb_:y])))
            pa_, pb_ = x, y
        out[i] = (len(ids[0]), len(ids[1]), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(p for ls in links.values() for p in ls)
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return {i: (n_a, n_b, g, len(links[i]), sum(count[p] == top[p[1]] for p in links[i]), sum(count[p] for p in links[i]), sha)
            for i, (n_a, n_b, g, sha) in out.items()}


def got(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_links, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
            for r in df.select(C.public_id(), "*").collect()}


def test_query_matches_brute_force(spark, libraries):
    import duckdb
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    out = X.op11_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    assert set(out.columns) >= {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()}
    assert rows == brute(docs, libraries)


def test_odd_texts(spark, docs_of, libraries):
    rows = list(enumerate(ODD))
    assert got(X.link_statistics(docs_of(rows))) == brute(rows, libraries)


def test_repeated_null_and_no_ids(spark, docs_of, libraries):
    rows = [(None, "tea for two"), (3, "tea for two"), (3, "tea for two"), (3, None)]
    out = sorted((r._id != C.NULL_ID, r._sub, r.n_a, r.count_sum) for r in X.link_statistics(docs_of(rows)).collect())
    assert [o[:2] for o in out] == [(False, 0), (True, 0), (True, 1), (True, 2)]
    assert [o[2] for o in out] == [3, 0, 3, 3] and [o[3] for o in out] == [9, 0, 9, 9]
    assert X.link_statistics(docs_of(rows).limit(0)).count() == 0


def test_align_returns_ids_links_and_cuts(spark, docs_of, libraries):
    a, b = libraries
    for r in X.align(docs_of(list(enumerate(ODD)))).collect():
        text = ODD[r._id]
        if not r.a_ids:
            continue
        assert r.a_ids == a.encode(" " + text, add_special_tokens=False).ids and r.b_ids == b.encode(text)
        assert r.cuts[-1] == len((" " + text).encode()) and r.a_links[-1] == len(r.a_ids) - 1 and r.b_links[-1] == len(r.b_ids) - 1


def test_stretches_blocks_and_forgetting_change_nothing(libraries, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["tea", "the", "ofblethti", "and,", "ö", "é\u00a0x", "two", "", "1999", "don't", "\n", "\u2581z"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 7, 4000, 3, 9000, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["_text"])
    monkeypatch.setattr(X, "UNITS", 8)
    pair = X.Pair(*X.default_paths())
    cut = X.stretches
    monkeypatch.setattr(X, "stretches", lambda data, offs: cut(data, offs, limit=700))
    want = brute(list(enumerate(texts)), libraries)
    for row, doc in X.documents(pair, batch, digest=True):
        shown = b";".join(p[3] for p in doc.parts)
        clean = doc.clean and bool(shown)
        assert (hashlib.sha256(shown).hexdigest() if clean else "") == want[row][6]
        if clean:
            assert (sum(p[0] for p in doc.parts), sum(p[1] for p in doc.parts), sum(len(p[2]) for p in doc.parts)) == want[row][:3]


class Mapped:
    """Stands for the keyed documents: hands out the function that Spark's tasks would run."""
    sparkSession = None

    def mapInArrow(self, run, schema):
        return run


@pytest.fixture
def block_rows(monkeypatch):
    """batches of (_id, _sub, _text) -> what a task makes of them."""
    monkeypatch.setattr(C, "keyed", lambda docs, *_: docs)
    monkeypatch.setattr(C, "bounded_batches", lambda _: None)
    monkeypatch.setattr(X, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda _: 3})())}))
    return X._blocks(Mapped(), "doc_id", "text", X.default_paths())


def text_batch(texts, first=0):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int64()), pa.array([0] * n, pa.int32()), pa.array(texts, pa.string())],
                                      names=["_id", "_sub", "_text"])


def test_blocks_join_the_lists_of_their_batches(block_rows, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["tea", "for", "two", "ofblethti", "and,", "1999", "don't", "ö"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 60, 90)]
    monkeypatch.setattr(C, "STAGE_BYTES", 500)
    monkeypatch.setattr(X, "BLOCK_BYTES", 3000)
    blocks = {}
    for b in block_rows(iter([text_batch(texts[:50]), text_batch(texts[50:], 50)])):
        for r in b.to_pylist():
            blocks.setdefault(r["block"], []).append(r)
    assert sorted(blocks) == [(3 << 32) + i for i in range(len(blocks))] and len(blocks) > 2
    links = {}
    for r, doc in X.documents(X.pair_of(*X.default_paths()), text_batch(texts), digest=True):
        links[r] = np.concatenate([np.zeros(0, np.int64), *(p[2] for p in doc.parts)]).tolist()
    seen = []
    for rows in blocks.values():
        *docs, one = rows
        assert one["_id"] is None and one["pairs"] == sorted(set(one["pairs"]))
        for r in docs:
            assert [one["pairs"][c] for c in r["codes"]] == links[r["_id"]] and r["n_links"] == len(links[r["_id"]])
        total = Counter(p for r in docs for p in links[r["_id"]])
        assert dict(zip(one["pairs"], one["counts"])) == total
        seen += [r["_id"] for r in docs]
    assert seen == list(range(90))


def test_a_block_of_links_is_held_small(block_rows):
    """8 MB of text in batches: the links wait as 4 bytes each, and only one batch's links are sorted at once."""
    import tracemalloc
    rng = np.random.default_rng(9)
    words = np.array(["tea", "for", "two", "the", "and", "of", "a", "in", "to"])
    texts = [" ".join(rng.choice(words, 1000)) for _ in range(120)]
    list(block_rows(iter([text_batch(texts)])))                         # the tokenizers are there now
    tracemalloc.start()
    n = sum(b.num_rows for b in block_rows(text_batch(texts) for _ in range(20)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 2400 and peak < 80 << 20


def test_remembered_units_are_bounded_in_bytes(monkeypatch):
    """Long units: few of them, and many bytes."""
    monkeypatch.setattr(X, "UNIT_BYTES", 40_000, raising=False)
    pair = X.Pair(*X.default_paths())
    rng = np.random.default_rng(10)
    texts = ["".join(rng.choice(list("abcdefgh日本語"), 400)) for _ in range(300)] + ["tea for two"] * 20
    for text in texts * 2:
        (_, doc), = X.documents(pair, text_batch([text]), digest=True)
        assert doc.clean and doc.parts[0][0]
        assert sum(map(len, pair.number)) < 60_000


def test_batches_are_bounded_in_bytes(spark, docs_of):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        for step in (X.align, X.link_statistics):
            spark.conf.unset(key)
            assert step(docs_of([(1, "tea for two")])).count() == 1
            assert spark.conf.get(key, None) == str(C.ARROW_BYTES)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_lockstep_links_equal_ends():
    rng = np.random.default_rng(3)
    end_a, end_b, lanes_a, lanes_b, at = [], [], [0], [0], 0
    for _ in range(40):
        size = int(rng.integers(0, 60))
        for ends, lanes in ((end_a, lanes_a), (end_b, lanes_b)):
            inner = np.sort(rng.choice(np.arange(1, size), rng.integers(0, size), replace=False)) if size > 1 else []
            ends.extend([at + int(x) for x in inner] + ([at + size] if size else []))
            lanes.append(len(ends))
        at += size
    la, lb = X.lockstep(np.array(end_a), np.array(end_b), np.array(lanes_a), np.array(lanes_b))
    assert [end_a[i] for i in la] == [end_b[i] for i in lb] == sorted(set(end_a) & set(end_b))
