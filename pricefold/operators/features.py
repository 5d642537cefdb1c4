"""Feature operators (FEA-1, FEA-4, FEA-5, FEA-6, SEL-1, SEL-2, SEL-3, ARR-1..3,
FLT-5, FLT-7, SCH-8, SCH-11, HSH-1).

Long-form (id, term, weight) and per-feature aggregates are the Spark-first
shapes: a wide matrix is never collected.  Only fitted statistics (a
vocabulary of at most ``max_features`` terms, one mean/std per feature)
reach the driver or a broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import exact_percentiles, rank_within, stored

_EMBED_ROWS, _EMBED_TOKENS = 256, 20_000       # rows added up at once; tokens whose vectors a task holds
WORD_SPLIT = r"[^a-z0-9_]+"  # ASCII word characters; tokens are runs of 2+
_IN_WORD = np.array([re.match(WORD_SPLIT, chr(b)) is None for b in range(256)])      # of a byte; no byte of a longer character
_TEXT_BYTES, _LISTED = 1 << 20, 10_000         # text split at once; words that may go on an n-gram, if so few


# Spark ML's default English stop-word list, in its own order.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot
could here's how's let's ought that's there's what's when's where's who's why's would
""".split()


def english_stop_words() -> list[str]:
    """The list ``StopWordsRemover.loadDefaultStopWords('english')`` gives; a literal, so nothing is
    read from disk or a session at import."""
    return list(ENGLISH_STOP_WORDS)


def tfidf_long(docs: DataFrame, id_col: str, text_col: str, max_features: int = 500,
               stop_words: list[str] | None = None, ngram_max: int = 2) -> DataFrame:
    """FEA-1: (id, term, weight) with sklearn's smooth idf ln((1+n)/(1+df)) + 1,
    the ``max_features`` most frequent terms (ties alphabetical) and L2-normalised rows.

    The vocabulary comes first (``_vocabulary``), so only its terms are counted by (id, term)."""
    spark = docs.sparkSession
    _bounded_batches(spark)
    n_docs = docs.count()
    # lower case as the JVM has it; the blank ends a text's last word
    base = docs.select(F.col(id_col).alias("_id"), F.concat(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(" ")).alias("_text"))
    stop = pa.array(stop_words or [], pa.large_string())
    terms = _vocabulary(base, stop, max_features, ngram_max)
    place = pa.array(terms, pa.large_string())
    split = [t.split(" ") for t in terms]
    first, rest = ({w for t in split for w in part(t)} for part in (lambda t: t[:1] if len(t) > 1 else [], lambda t: t[1:]))

    def count(batches):
        for batch, doc, code, names in _tokens(batches, stop):
            rows, found = [doc], [_index(names, place)[code]]
            for at, which, grams in _grams(doc, code, names, first, rest, ngram_max):
                rows.append(doc[at])
                found.append(_index(grams, place)[which])
            rows, found = np.concatenate(rows), np.concatenate(found)
            key, n = np.unique(rows[found >= 0] * len(place) + found[found >= 0], return_counts=True)
            row, term = np.divmod(key, max(1, len(place)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(term.astype(np.int32)), pa.array(n)],
                                             names=["_id", "_term", "tf"])

    schema = T.StructType([base.schema["_id"], T.StructField("_term", T.IntegerType()), T.StructField("tf", T.LongType())])
    # an id that repeats is one document
    tf = stored(base.mapInArrow(count, schema).groupBy("_id", "_term").agg(F.sum("tf").alias("tf")), "term-counts")
    df = {r["_term"]: r["df"] for r in tf.groupBy("_term").agg(F.count(F.lit(1)).alias("df")).collect()}      # max_features rows at most
    vocab = spark.createDataFrame([(k, terms[k], math.log((1.0 + n_docs) / (1.0 + n)) + 1.0) for k, n in df.items()],
                                  "_term int, term string, idf double")
    w = tf.join(F.broadcast(vocab), "_term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("_id")))
    return w.select(F.col("_id").alias(id_col), "term", (F.col("w") / norm).alias("weight"))


def _vocabulary(base: DataFrame, stop: pa.Array, max_features: int, ngram_max: int) -> list[str]:
    """The ``max_features`` most frequent words and n-grams, ties alphabetical, counted exactly.

    A word occurs at least as often as any n-gram that holds it and stands before those it begins.  So an n-gram of the
    vocabulary begins with one of the ``max_features`` first words, and its other words occur as often as the last of
    them at least: only such n-grams are counted.  Where more words than are listed occur that often, any may follow."""
    def words(batches):
        for _, _, code, names in _tokens(batches, stop):
            n = np.bincount(code, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(n)], names=["term", "n"]).filter(pa.array(n > 0))

    def most(counting, limit):
        total = base.mapInArrow(counting, "term string, n long").groupBy("term").agg(F.sum("n").alias("total"))
        return [(r["term"], r["total"]) for r in total.orderBy(F.desc("total"), "term").limit(limit).collect()]   # a top-k report

    listed = max(_LISTED, 2 * max_features)
    ranked = most(words, listed + 1)
    top = ranked[:max_features]
    if ngram_max > 1 and top:
        least = top[-1][1] if len(top) == max_features else 0
        first, rest = {t for t, _ in top}, {t for t, n in ranked if n >= least}
        if len(rest) > listed:
            rest = None

        def grams(batches):
            for _, doc, code, names in _tokens(batches, stop):
                for _, which, found in _grams(doc, code, names, first, rest, ngram_max):
                    yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array(np.bincount(which, minlength=len(found)))],
                                                     names=["term", "n"])

        top += most(grams, max_features)
    return [t for t, _ in sorted(top, key=lambda x: (-x[1], x[0]))[:max_features]]


def _tokens(batches: Iterator[pa.RecordBatch], stop: pa.Array) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """(rows, row of each token, its number, the numbered words) of slices of (_id, lower-cased text with a blank behind)."""
    for whole in batches:
        lo = 0
        ends = np.cumsum(pc.binary_length(whole.column(1)).to_numpy().astype(np.int64))
        while lo < whole.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _TEXT_BYTES, side="right")))
            batch, lo = whole.slice(lo, hi - lo), hi
            text = batch.column(1).cast(pa.large_binary())
            _, offs, data = text.buffers()
            offs = np.frombuffer(offs, np.int64)[text.offset: text.offset + len(text) + 1]
            data, offs = np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]
            inside = _IN_WORD[data]
            edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = end - start > 1                                    # tokens are runs of 2+
            inside[start[~long]] = False
            start, end = start[long], end[long]
            ends_at = np.concatenate([[0], np.cumsum(end - start)])
            words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends_at), pa.py_buffer(data[inside])).dictionary_encode()
            code, names = words.indices.to_numpy().astype(np.int64), words.dictionary
            stay = (_index(names, stop) < 0)[code]
            yield batch, (np.searchsorted(offs, start, side="right") - 1)[stay], code[stay], names


def _index(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each value in ``among``, -1 where it has none."""
    return pc.index_in(values, value_set=among).fill_null(-1).to_numpy().astype(np.int64)


def _grams(doc: np.ndarray, code: np.ndarray, names: pa.Array, first: set[str], rest: set[str] | None,
           ngram_max: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """For each n from 2: (first token of each n-gram, its number, the numbered n-grams), of those that begin with a word
    of ``first`` and go on with words of ``rest`` (None: any)."""
    at = np.flatnonzero((_index(names, pa.array(sorted(first), pa.large_string())) >= 0)[code]) if len(names) else np.zeros(0, np.int64)
    may = np.ones(len(names), bool) if rest is None else _index(names, pa.array(sorted(rest), pa.large_string())) >= 0
    which, grams = code[at], names
    for n in range(2, ngram_max + 1):
        on = at + n - 1 < len(code)
        at, which = at[on], which[on]
        on = (doc[at + n - 1] == doc[at]) & may[code[at + n - 1]]
        at, which = at[on], which[on]
        if not len(at):
            return
        key, which = np.unique(which * len(names) + code[at + n - 1], return_inverse=True)
        head, tail = np.divmod(key, len(names))
        grams = pc.binary_join_element_wise(grams.take(pa.array(head)), names.take(pa.array(tail)), pa.scalar(" ", pa.large_string()))
        yield at, which, grams


def _bounded_batches(spark) -> None:
    """Bound the bytes of an Arrow batch, which by default is bounded by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(4 << 20))


# ------------------------------------------------------------------ FEA-4/5/6
def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """FEA-4 fit: mean and population std per column (nulls filled with 0 first)."""
    row = df.agg(*[a for c in cols for a in (F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"m_{c}"),
                                             F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
                                             .alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def apply_standard(df: DataFrame, stats: dict[str, tuple[float, float]], keep: list[str]) -> DataFrame:
    """FEA-4 transform: (x - mean) / std, std 0 -> 1; null -> 0 before scaling."""
    out = [F.col(k) for k in keep]
    for c, (m, s) in stats.items():
        s = s if s and s > 0 else 1.0
        out.append(((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)).alias(c))
    return df.select(*out)


def minmax_scale(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """FEA-5: (x - min) / (max - min); a constant column maps to 0."""
    row = df.agg(*[a for c in cols for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    out = [F.col(k) for k in keep]
    for c in cols:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        span = (hi - lo) if (hi is not None and lo is not None and hi != lo) else None
        out.append(((F.col(c) - F.lit(lo)) / F.lit(span)).alias(c) if span else F.lit(0.0).alias(c))
    return df.select(*out)


def fit_labels(df: DataFrame, col: str) -> DataFrame:
    """FEA-6 fit: (label, code); null counts as "NA", labels numbered in sorted order from 0 (ranked over many
    partitions, however many labels there are)."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("NA"))
    return rank_within(df.select(v.alias("label")).distinct(), ["label"], rank_col="code") \
        .select("label", F.col("code").cast("int").alias("code"))


def apply_labels(df: DataFrame, codes: DataFrame, col: str, out_col: str) -> DataFrame:
    """FEA-6 transform: a label that the fit has not seen is an error, raised when the row is computed."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("NA"))
    j = df.withColumn("_lbl", v).join(codes.select(F.col("label").alias("_lbl"), F.col("code").alias(out_col)), "_lbl", "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col("_lbl"))).cast("int")
    return j.withColumn(out_col, F.when(F.col(out_col).isNull(), unseen).otherwise(F.col(out_col))).drop("_lbl")


# ------------------------------------------------------------------- SEL-1/2
def vector_long(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Array column -> long (id, idx, x, y)."""
    return df.select(id_col, F.col(label_col).cast("double").alias("y"),
                     F.posexplode(vec_col).alias("idx", "x")).withColumn("x", F.col("x").cast("double"))


def f_regression_scores(long: DataFrame) -> DataFrame:
    """SEL-1: F = r^2 / (1 - r^2) * (n - 2) per feature index, from one
    partial aggregate per feature (corr is mergeable)."""
    st = long.groupBy("idx").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return st.withColumn("f_score", F.pow("r", 2) / (1.0 - F.pow("r", 2)) * (F.col("n") - 2))


def select_top_k(scores: DataFrame, score_col: str, k: int, n_features: int, min_features: int = 1) -> list[int]:
    """k_eff = max(min_features, min(k, n_features)); the chosen indices in order.  At most k_eff pairs reach the
    driver (a top-k report)."""
    k_eff = max(min_features, min(k, n_features))
    return sorted(r["idx"] for r in scores.orderBy(F.desc_nulls_last(score_col), "idx").limit(k_eff).select("idx").collect())


def binned_mutual_info(long: DataFrame, bins: int = 10) -> DataFrame:
    """SEL-2 (re-aimed): mutual information between quantile bins of x (per
    feature) and of y.  Bins come from exact percentiles; counts are partial
    aggregates over (feature, bx, by)."""
    probs = [i / bins for i in range(1, bins)]
    ex = exact_percentiles(long, "x", probs, ["idx"]).groupBy("idx") \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("prob", "value"))), lambda s: s["value"]).alias("ex"))
    ys = long.select("idx", "y").where(F.col("idx") == 0)
    ey = exact_percentiles(ys, "y", probs).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("prob", "value"))), lambda s: s["value"]).alias("ey")).first()
    ey_vals = ey["ey"] or []
    by = sum((F.when(F.col("y") > F.lit(e), 1).otherwise(0) for e in ey_vals), F.lit(0))
    b = long.join(F.broadcast(ex), "idx") \
        .withColumn("bx", F.size(F.filter("ex", lambda e: F.col("x") > e))).withColumn("by", by)
    joint = b.groupBy("idx", "bx", "by").agg(F.count(F.lit(1)).alias("nxy"))
    w_idx = Window.partitionBy("idx")
    joint = joint.withColumn("n", F.sum("nxy").over(w_idx)) \
                 .withColumn("nx", F.sum("nxy").over(Window.partitionBy("idx", "bx"))) \
                 .withColumn("ny", F.sum("nxy").over(Window.partitionBy("idx", "by")))
    term = (F.col("nxy") / F.col("n")) * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return joint.groupBy("idx").agg(F.sum(term).alias("mi"))


def slice_vector(c: Column, indices: list[int] | None) -> Column:
    """SEL-3: keep saved indices (0-based); None -> identity."""
    if indices is None:
        return c
    return F.array(*[F.element_at(c, i + 1) for i in indices])


# --------------------------------------------------------------- ARR / FLT / SCH
def l2_normalize(c: Column, eps: float = 0.0) -> Column:
    """ARR-1: v / (||v|| + eps); a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm + eps == 0, F.transform(c, lambda x: x.cast("double") * 0.0)) \
            .otherwise(F.transform(c, lambda x: x.cast("double") / (norm + eps)))


def zero_fill(c: Column, width: int) -> Column:
    """ARR-2: a missing vector becomes zeros of the given width."""
    return F.coalesce(c, F.array_repeat(F.lit(0.0), width))


def l2_norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def is_zero_vector(c: Column, tol: float = 1e-12) -> Column:
    """FLT-7."""
    return l2_norm(c) <= tol


def is_finite(c: Column) -> Column:
    """FLT-5."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def concat_vectors(*cols: Column) -> Column:
    """SCH-8 / SCH-9 / SCH-10: blocks concatenated in a fixed order."""
    return F.concat(*[c.cast("array<double>") for c in cols])


def align_width(c: Column, width: int) -> Column:
    """SCH-11: truncate or zero-pad to the expected width."""
    padded = F.concat(c.cast("array<double>"), F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(c), F.lit(0))))
    return F.slice(padded, 1, width)


def token_hash_embedding(c: Column, dim: int = 16, seed: int = 0) -> Column:
    """ARR-3 (re-aimed): mean over tokens of a repeatable pseudo-random vector per
    (token, dimension), from md5; an empty text gives zeros."""
    toks = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")

    def vector(t: str) -> np.ndarray:
        words = b"".join(hashlib.md5(f"{t}:{d}:{seed}".encode()).digest()[:4] for d in range(dim))
        return np.frombuffer(words, ">u4") / 4294967296.0 * 2.0 - 1.0

    @F.pandas_udf("array<double>")
    def means(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place, vectors = {}, np.zeros((64, dim))            # a token's vector is made once for many rows
        for rows in batches:
            out = []
            for a in range(0, len(rows), _EMBED_ROWS):
                if len(place) > _EMBED_TOKENS:
                    place = {}
                part = rows.iloc[a:a + _EMBED_ROWS]
                size = np.array([len(r) for r in part])
                at = np.zeros(int(size.sum()), np.int64)
                for i, t in enumerate(chain.from_iterable(part)):
                    k = place.get(t)
                    if k is None:
                        k = place[t] = len(place)
                        if k >= len(vectors):
                            vectors = np.concatenate([vectors, np.zeros_like(vectors)])
                        vectors[k] = vector(t)
                    at[i] = k
                total, some = np.zeros((len(part), dim)), size > 0
                if len(at):
                    total[some] = np.add.reduceat(vectors[at], (np.cumsum(size) - size)[some])
                out.extend(total / np.maximum(size, 1)[:, None])
            yield pd.Series(out, dtype=object)
    return means(toks)


def content_fingerprint(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """HSH-1 (re-aimed, order-free): row count plus the sum and xor of per-row
    64-bit hashes of the rounded values; equal tables give equal fingerprints
    in any partitioning.  A fractional value enters as the whole number of ``10**-digits`` it rounds to, so
    its text form plays no part."""
    kinds = dict(df.dtypes)
    parts = [F.coalesce(F.round(F.col(c) * 10 ** digits).cast("long").cast("string") if kinds[c] in ("double", "float")
                        else F.col(c).cast("string"), F.lit("")) for c in cols]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")
    # summed as decimal: a long sum of 60-bit hashes would overflow (ANSI error)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))
