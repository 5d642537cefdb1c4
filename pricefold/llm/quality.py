"""Operator 10, quality classifier: random-indexing word vectors pooled per document, a two-layer network.

1. Random indexing over the whole corpus: every token bucket owns a fixed sparse ternary index vector; a
   token's context vector is the sum of the index vectors of its left and right neighbours.  Tasks add up
   their own table, and the tables are summed by block of buckets in one shuffle (``BUCKETS * DIM`` floats
   in all, whatever the corpus size), then broadcast.
2. A document is the mean of its tokens' unit context vectors, plus how alike neighbouring vectors are and the
   length of the mean (both show repetition).
3. A two-layer numpy network is fitted on at most ``TRAIN_BOUND`` labelled documents per class outside fold 0; its
   logits are divided by a temperature fitted on the rows of fold 1, which the network has not seen.

Tokens are runs of letters and digits or runs of other marks, case kept.

Defined results: a null or empty text pools to the zero vector and is scored like any other; without labels of
both classes every score is the share of label 1 (0.5 without labels); repeated documents each get a row; extra
columns are ignored, and labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .learning import fold, training_labels
from .registry import query

BUCKETS, DIM, BLOCK = 1 << 15, 32, 512
FEATURES = DIM + 4
TRAIN_BOUND = {0: 6000, 1: 6000}
POOL_BYTES = 1 << 19           # text pooled at once: one vector per token is held
KEEP_AT = 0.3

_CLASS = np.full(256, 2, np.uint8)             # 0 space, 1 letters and digits, 2 marks
_CLASS[C.WORD_FOLDED] = 1
_CLASS[:0x21] = 0
_CLASS[C.SPACE] = 0

_IDX = C.mix(np.arange(BUCKETS, dtype=C.U64) + C.U64(0x51ED27))
_POS = np.stack([(_IDX & C.U64(DIM - 1)).astype(np.int64), ((_IDX >> C.U64(8)) & C.U64(DIM - 1)).astype(np.int64)])
_SIGN = np.stack([np.where((_IDX >> C.U64(s)) & C.U64(1), 1.0, -1.0) for s in (20, 21)])


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, first token of each text plus the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _CLASS[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offs] = True
    edge = np.flatnonzero(change)
    start, end = edge[:-1], edge[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    h = C.ROLL_A.span(C.ROLL_A.prefix(C.BYTE_A[data]), start, end)
    return (h & C.U64(BUCKETS - 1)).astype(np.int64), np.searchsorted(start, offs)


def context_table(docs: DataFrame) -> np.ndarray:
    """Summed context vectors of all token buckets over all documents."""

    def count(batches):
        total = np.zeros(BUCKETS * DIM)
        for batch in C.small_batches(batches, limit=C.STAGE_BYTES):
            tok, first = tokens(*C.buffer_of(batch.column(0)))
            if len(tok) < 2:
                continue
            same = np.ones(len(tok) - 1, bool)
            inner = first[(first > 0) & (first < len(tok))]
            same[inner - 1] = False
            left, right = tok[:-1][same], tok[1:][same]
            for a, b in ((left, right), (right, left)):
                for k in (0, 1):
                    total += np.bincount(a * DIM + _POS[k][b], weights=_SIGN[k][b], minlength=BUCKETS * DIM)
        table = total.reshape(-1, BLOCK * DIM)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)),
                                          pa.array([table[i].tobytes() for i in used], pa.binary())], names=["block", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0.0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "sums"])

    schema = "block int, sums binary"
    # two steps: a block's tables of all tasks never meet in one task, only those of a share of the tasks do, then the shares' sums
    shares = max(1, C.shuffle_partitions(docs.sparkSession) // 8)
    parts = docs.select("_text").mapInArrow(count, schema).repartition("block", F.pmod(F.spark_partition_id(), F.lit(shares))) \
        .mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for row in parts.collect():                # BUCKETS * DIM doubles at most: bounded by the two parameters
        table[row.block] = np.frombuffer(row.sums)
    return table.reshape(BUCKETS, DIM)


def unit_vectors(table: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Feature rows, one per text."""
    tok, first = tokens(data, offs)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    v = vectors[tok]
    mean = np.add.reduceat(v, first[:-1][full], axis=0) / n[full, None]
    out[full, :DIM] = mean
    out[full, DIM] = np.linalg.norm(mean, axis=1)
    out[full, DIM + 1] = np.log1p(n[full])
    doc = np.repeat(np.arange(len(n)), n)
    for k, lag in enumerate((1, 2)):
        if len(tok) > lag:
            same = doc[lag:] == doc[:-lag]
            alike = np.where(same, np.einsum("ij,ij->i", v[lag:], v[:-lag]), 0.0)
            out[:, DIM + 2 + k] = np.bincount(doc[lag:], weights=alike, minlength=len(n)) / np.maximum(1, n - lag)
    return out


class Network:
    """tanh layer and logistic output; ``temperature`` divides the logit."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.w1, self.temperature = prior, None, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, steps: int = 600, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
             rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, steps + 1):
            a = np.tanh(z @ p[0] + p[1])
            err = (_sigmoid(a @ p[2] + p[3]) - y) / len(y)
            back = np.outer(err, p[2]) * (1 - a * a)
            grads = [z.T @ back + 1e-4 * p[0], back.sum(0), a.T @ err + 1e-4 * p[2], err.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
                p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = p
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Temperature that gives the least log loss on rows the network was not fitted on."""
        z = self.logits(x)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        self.temperature = float(min(grid, key=lambda t: np.mean(np.logaddexp(0, np.where(y == 1, -z, z) / t))))
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


class QualityModel:
    """Word vectors and the fitted network."""

    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.network.scores(pooled(*C.buffer_of(texts), self.vectors).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        bound: dict[int, int] | None = None) -> QualityModel:
    """Word vectors from all documents; the network from a bounded, hash-drawn set of labelled ones."""
    rows = C.keyed(docs, id_col, text_col)
    vectors = unit_vectors(context_table(rows))
    C.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    drawn = training_labels(labels, "quality", bound or TRAIN_BOUND, id_col)
    # the drawn labels are bounded by TRAIN_BOUND, so this side may be broadcast
    sample = rows.join(F.broadcast(drawn), "_id").select("_id", "_sub", "_text", "y", "fold")

    def features(batches):
        for batch in C.small_batches(batches, limit=POOL_BYTES):
            f = pooled(*C.buffer_of(batch.column(batch.schema.get_field_index("_text"))), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_sub", "y", "fold")]
                + [pa.array([r.tobytes() for r in f], pa.binary())], names=["_id", "_sub", "y", "fold", "x"])

    got = sorted(sample.mapInArrow(features, "_id long, _sub int, y int, fold long, x binary").collect())
    y = np.array([r.y for r in got], float)
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors, Network(float(y.mean()) if len(y) else 0.5))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(np.float64)
    check = np.array([r.fold == 1 for r in got])
    if len(set(y[~check].tolist())) < 2:
        check[:] = False
    net = Network().fit(x[~check], y[~check])
    return QualityModel(vectors, net.calibrate(x[check], y[check]) if check.any() else net)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _sub, score)`` of every document, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in C.small_batches(batches, limit=POOL_BYTES):
            s = shared.value.scores(batch.column(batch.schema.get_field_index("_text")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())],
                                             names=["_id", "_sub", "score"])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "_id long, _sub int, score double")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``at``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in C.small_batches(batches, text_col, POOL_BYTES):
            s = shared.value.scores(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array(s >= at))

    return docs.mapInArrow(run, docs.schema)


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels)).select(C.public_id(), "score")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score",
                      (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
