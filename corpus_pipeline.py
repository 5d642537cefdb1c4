"""The training-data pipeline over ``documents``: each stage's rows are written as Parquet and read by the next.

Every stage works on all rows its predecessor kept, and all but the last return the columns of ``documents``.  Empty
tables pass through; repeated rows, null ids and null texts are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricefold.llm import bpe, decontaminate, ngram_join, pii, quality
from pricefold.llm import common as C


def keep_quality(spark, docs, sf_dir):
    """Operator 10: documents that score below 0.3 go."""
    return quality.keep_good(docs, quality.fit(docs, C.table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark, docs, sf_dir):
    """Operator 4: of each group of linked or equal texts, the first document stays."""
    return ngram_join.keep_one(docs)


def keep_uncontaminated(spark, docs, sf_dir):
    """Operator 8: documents that the benchmark's items contaminate go."""
    return decontaminate.keep_clean(docs, C.table(spark, sf_dir, "benchmark"))


def pseudonymise(spark, docs, sf_dir):
    """Operator 9: personal values are replaced in place; ``n_chars`` follows the text."""
    out = pii.pseudonymise(docs, key=pii.KEY, found_col="__pii_found").drop("__pii_found")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), "n_chars").cast(kind))
    return out.select(*docs.columns)


def encode(spark, docs, sf_dir):
    """Operator 2: token ids of every kept text, with digests of the ids and of what they decode to."""
    coded = bpe.encode(docs)
    return coded.select("ids", *bpe.digest_columns())


STAGES = [("quality classifier", keep_quality), ("n-gram Jaccard join", keep_one_of_near_duplicates),
          ("benchmark decontamination", keep_uncontaminated), ("PII", pseudonymise),
          ("BPE encoding and decoding", encode)]

ORACLE_SQL = None      # a learned stage, a similarity join and a tokenizer: tested against brute force instead


def run(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
