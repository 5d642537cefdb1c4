"""Operator 2 against the library on whole texts."""

import hashlib
import random

import pytest

from conftest import SF_SMALL
from pricefold.llm import bpe
from pricefold.llm.registry import QUERIES


def want(rows):
    t = bpe.load(bpe.tokenizer_path())
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["The", "it's", "we'll", "HÖHE", "日本語", "éte", "x1y22", "!!", " ", "\u0085a", "İ", "ΣΑΣ", "don't'ss",
             "<|endoftext|>", "a<|startoftext|>b", "<|endoftext", "🙂👍🏽", "‍", "ſ", "ﬁ", "a" * 60, "\x1c", "'s", "'", "́"]
    seps = [" ", "\n", "  ", "\t", "\r\n", "\x0b", "   "]
    texts = ["".join(rng.choice(vocab) + rng.choice(seps) for _ in range(rng.choice([0, 1, 5, 60, 900]))) for _ in range(40)]
    texts += [texts[4] + texts[5], texts[5] * 2, "", None, " \n ", "q" * 20_000, texts[4]]
    return [*enumerate(texts), (3, texts[3]), (3, "other"), (None, "x y")]


@pytest.mark.parametrize("bits", [1, bpe.CUT_BITS])
def test_ids_and_text_as_the_library(spark, docs_of, monkeypatch, bits):
    rows = corpus(7)
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    got = bpe.encode(docs_of(rows)).select(*bpe.digest_columns()).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want(rows)


def test_many_cuts_and_forgetting_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 200)
    monkeypatch.setattr(bpe, "WORDS", 10)
    t = bpe.load(bpe.tokenizer_path())
    encoder, rng = bpe.Encoder(t), random.Random(3)
    for _ in range(30):
        words = [rng.choice(["the", "tea", "don't", "Ö", "x" * 30]) for _ in range(60)]
        pieces = [" ".join(words[i:i + 7]).encode() + b" " for i in range(0, 60, 7)]
        (ids, shown), = encoder.documents([pieces])
        assert ids.tolist() == t.encode(b"".join(pieces).decode(), add_special_tokens=False).ids
        assert shown.decode() == t.decode(ids.tolist(), skip_special_tokens=False)


def test_joins_that_disagree_are_re_encoded(monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "agree", lambda self, pairs: self.joins.update(dict.fromkeys(pairs, False)))
    t = bpe.load(bpe.tokenizer_path())
    encoder = bpe.Encoder(t)
    pieces = [b"The cat's mat \n", b"don't say", b" HALLO x", b" ", b"one"]
    (ids, shown), = encoder.documents([pieces])
    assert ids.tolist() == t.encode(b"".join(pieces).decode(), add_special_tokens=False).ids
    assert shown.decode() == t.decode(ids.tolist(), skip_special_tokens=False)


def test_a_vocabulary_that_keeps_white_space():
    t = bpe.load(bpe.tokenizer_path("byte_bpe_50k.json"))
    pieces = [b"the cat sat", b" on  the mat", b" and slept\n"]
    (ids, shown), = bpe.Encoder(t).documents([pieces])
    assert ids.tolist() == t.encode(b"".join(pieces).decode(), add_special_tokens=False).ids
    assert shown == b"".join(pieces)


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op2_bpe_encoding"](spark, SF_SMALL).collect()), key=repr) == want(rows)
