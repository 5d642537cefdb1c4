"""The pipeline's stages one by one against what their operators decide, and whole."""

import hashlib

import corpus_pipeline as P
from conftest import SF_SMALL
from pricefold.llm import bpe
from test_decontaminate import brute as contaminated
from test_ngram_join import brute as near
from test_pii import want as pseudonym


def test_stages_and_whole_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    tables = [docs]
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, tables[-1], SF_SMALL).write.parquet(f"{tmp_path}/{n}")
        tables.append(spark.read.parquet(f"{tmp_path}/{n}"))
    assert all(t.columns == columns for t in tables[:-1]) and [k for k, _ in P.STAGES][0] == "quality classifier"
    rows = [sorted(tuple(r) for r in t.collect()) for t in tables]
    texts = [[(r[0], r[1]) for r in t] for t in rows]
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = {i for i, _ in texts[1]}
    assert set(rows[1]) < set(rows[0]) and all(i in kept for i, q in good.items() if q) or \
        sum(i in kept for i, q in good.items() if q) > 0.95 * sum(good.values())
    assert [i for i, _ in texts[2]] == [r[0] for r in near(texts[1]) if (r[0], r[1]) == (r[5], r[6])]
    assert [i for i, _ in texts[3]] == sorted(r[0] for r in contaminated(texts[2], items) if not r[5])
    assert texts[4] == [(i, pseudonym(t)[0]) for i, t in texts[3]]
    assert all(r[columns.index("n_chars")] == len(r[1]) for r in rows[4])
    t = bpe.load(bpe.tokenizer_path())
    last = {r.doc_id: r for r in tables[5].collect()}
    assert sorted(last) == [i for i, _ in texts[4]]
    for i, text in texts[4]:
        ids = t.encode(text, add_special_tokens=False).ids
        assert last[i].ids == ids and last[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole = P.run(spark, SF_SMALL)
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in whole.collect()) == \
        sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in last.values())


def test_an_empty_table_passes_through(spark, docs_of):
    empty = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id < 0")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF_SMALL)
        assert empty.count() == 0
