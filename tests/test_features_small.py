"""Label codes, top-k selection and the token-hash embedding."""

import hashlib

import pytest

import numpy as np
from pricefold.operators import features as FE
from pricefold.operators.features import tfidf_long


def test_label_codes_sorted_with_na_and_unseen_labels(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, c string")
    codes = FE.fit_labels(df, "c")
    got = {r["id"]: r["code"] for r in FE.apply_labels(df, codes, "c", "code").collect()}
    # sorted labels: "NA" < "a" < "b" (byte order, as a sorted label encoder gives)
    assert got == {2: 0, 3: 1, 1: 2, 4: 2}
    new = spark.createDataFrame([(9, "zz")], "id long, c string")
    with pytest.raises(Exception, match="unseen label: zz"):
        FE.apply_labels(new, codes, "c", "code").collect()


def test_select_top_k(spark):
    sc = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, None), (3, 5.0), (4, 2.0)], "idx int, f double")
    assert FE.select_top_k(sc, "f", 2, 5) == [1, 3]
    assert FE.select_top_k(sc, "f", 99, 5) == [0, 1, 2, 3, 4]
    assert FE.select_top_k(sc, "f", 0, 5, min_features=1) == [1]


def test_token_hash_embedding(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    got = [r.e for r in df.select(FE.token_hash_embedding(F.col("t"), dim=5).alias("e")).collect()]
    h = lambda t, d: int(hashlib.md5(f"{t}:{d}:0".encode()).hexdigest()[:8], 16) / 2 ** 32 * 2 - 1     # noqa: E731
    assert got[0] == pytest.approx([(2 * h("a", d) + h("b", d)) / 3 for d in range(5)])
    assert got[1] == got[2] == [0.0] * 5


@pytest.mark.parametrize("flat", [False, True])
def test_vocabulary_is_the_exact_one_with_and_without_proof(spark, flat):
    """Skewed counts are proven by the summary; where all counts are equal it cannot, and every term is counted."""
    import collections
    rng = np.random.default_rng(3)
    words = [f"w{i:03d}" for i in range(300)]
    p = np.ones(300) if flat else 1.0 / np.arange(1, 301)
    docs = [[words[j] for j in (range(300) if flat else rng.choice(300, 60, p=p / p.sum()))] for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id long, t string")
    got = {r.term for r in tfidf_long(df, "id", "t", max_features=20, ngram_max=1).select("term").distinct().collect()}
    total = collections.Counter(w for d in docs for w in d)
    assert got == set(sorted(total, key=lambda w: (-total[w], w))[:20])


@pytest.mark.parametrize("flat,ngram_max,listed", [(True, 2, 10_000), (False, 2, 10_000), (True, 2, 30), (False, 3, 30)])
def test_only_terms_of_the_vocabulary_are_counted_by_document(spark, monkeypatch, flat, ngram_max, listed):
    """Equal counts used to make the step count every term by document; n-grams are still the exact ones, ties alphabetical."""
    import collections
    import math
    rng = np.random.default_rng(4)
    words = ["the", "x"] + [f"w{i:02d}" for i in range(60)]
    p = np.ones(62) if flat else 1.0 / np.arange(1, 63)
    docs = [(k % 25 if k % 7 else None, " ".join(words[j] + (".", " ", "é-")[j % 3] for j in rng.choice(62, 40, p=p / p.sum())).upper()) for k in range(40)] + [(99, None), (98, "")]
    written = []
    keep = FE.stored
    monkeypatch.setattr(FE, "stored", lambda t, name: written.append(keep(t, name)) or written[-1])
    monkeypatch.setattr(FE, "_LISTED", listed, raising=False)
    df = spark.createDataFrame(docs, "id long, t string")
    got = {(r.id, r.term): r.weight for r in tfidf_long(df, "id", "t", max_features=20, stop_words=["the"], ngram_max=ngram_max).collect()}
    tf = collections.Counter()
    for i, t in docs:
        w = [x for x in "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in (t or "").lower()).split() if len(x) > 1 and x != "the"]
        tf.update((i, " ".join(w[k:k + n])) for n in range(1, ngram_max + 1) for k in range(len(w) - n + 1))
    total, df_of = collections.Counter(), collections.Counter(t for _, t in tf)
    for (_, t), n in tf.items():
        total[t] += n
    vocab = sorted(total, key=lambda t: (-total[t], t))[:20]
    raw = {(i, t): n * (math.log((1 + len(docs)) / (1 + df_of[t])) + 1) for (i, t), n in tf.items() if t in vocab}
    norm = collections.Counter()
    for (i, _), x in raw.items():
        norm[i] += x * x
    assert got == {(i, t): pytest.approx(x / math.sqrt(norm[i])) for (i, t), x in raw.items()}
    assert [t.count() for t in written] == [len(raw)]
