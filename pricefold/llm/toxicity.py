"""Operator 7, toxicity: a linear-chain conditional random field tags toxic spans; its marginals score documents.

1. Evidence: on a bounded, hash-drawn set of labelled documents outside fold 0, Spark counts in how many toxic
   and clean documents each word, word start and word end occurs; the log odds of those that lean to toxic
   documents form the evidence table (``TABLE_BOUND`` entries at most, largest toxic counts first).
2. Token labels: in a toxic document, a word with strong evidence is labelled toxic; all others are clean.
3. A two-state chain over the words of a line (features: bias, evidence of each kind, the largest) is fitted by
   gradient ascent on the labelled lines; forward-backward gives every word's marginal.
4. A document's score is a logistic function of its expected number of toxic words, its largest marginal and
   the expected share, fitted on fold 1 (which did not feed the evidence table).  Words with a marginal of one
   half or more are returned as byte spans.

Words are lower-cased (A-Z) runs of letters, digits and bytes from 0x80.  A line whose words carry no evidence at
all keeps the base marginal and adds nothing to the score.

Defined results: a null or empty text scores like a text without evidence; without labels of both classes all
scores are the share of label 1 (0.5 without labels); repeated documents each get a row; extra columns are ignored, and
labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .learning import fold, training_labels
from .registry import query

TRAIN_BOUND = {0: 6000, 1: 3000}
TABLE_BOUND = 50_000
LEAST_DOCS, STRONG, CAUTION = 4, 1.5, 1.3
CUTS = [None, 4, 5, 6, -4]          # whole word, word starts and a word end, in bytes
N_FEATURES = len(CUTS) + 2
TRAIN_LINES, TRAIN_WORDS = 4000, 64     # lines (about) and words of a line that the chain is fitted on


def words(data: np.ndarray, offs: np.ndarray):
    """Start, end, first word of each text, line number of each word, and the hash of each kind per word."""
    start, end, first = C.word_spans(data, offs, C.WORD_FOLDED)
    prefix = C.ROLL_A.prefix(C.BYTE_A[C.LOWER[data]])
    breaks = np.cumsum(data == 0x0A)
    line = breaks[start] if len(start) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kinds = []
    for k, cut in enumerate(CUTS):
        if cut is None:
            lo, hi = start, end
        elif cut > 0:
            lo, hi = start, np.minimum(end, start + cut)
        else:
            lo, hi = np.maximum(start, end + cut), end
        kinds.append(C.ROLL_A.span(prefix, lo, hi) ^ C.U64(0x9E3779B97F4A7C15 * (k + 1) & C.MASK))
    return start, end, first, doc, line, kinds


class Chain:
    """Two-state chain; all messages are log odds of the two states."""

    def __init__(self, n: int):
        self.emit, self.move, self.begin = np.zeros(n), np.zeros((2, 2)), 0.0

    def messages(self, e: np.ndarray):
        """Forward and backward log odds for padded scores ``e`` (steps x lines); pads must follow the words."""
        a, b = np.empty_like(e), np.zeros_like(e)
        t = self.move
        a[0] = self.begin + e[0]
        for i in range(1, len(e)):
            a[i] = e[i] + np.logaddexp(t[0, 1], a[i - 1] + t[1, 1]) - np.logaddexp(t[0, 0], a[i - 1] + t[1, 0])
        return a, b

    def backward(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        t, b = self.move, np.zeros_like(e)
        for i in range(len(e) - 2, -1, -1):
            x = e[i + 1] + b[i + 1]
            step = np.logaddexp(t[1, 0], t[1, 1] + x) - np.logaddexp(t[0, 0], t[0, 1] + x)
            b[i] = np.where(i + 1 < size, step, 0.0)
        return b

    def marginals(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, _ = self.messages(e)
        return _sigmoid(a + self.backward(e, size))

    def fit(self, x: np.ndarray, y: np.ndarray, size: np.ndarray, steps: int = 150) -> Chain:
        """``x`` steps x lines x features, ``y`` steps x lines, ``size`` words of each line."""
        here = np.arange(len(x))[:, None] < size[None, :]
        pair = here[1:]
        theta = np.zeros(N_FEATURES + 5)
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            self.emit, self.move, self.begin = theta[:N_FEATURES], theta[N_FEATURES:-1].reshape(2, 2), theta[-1]
            e = x @ self.emit
            a, _ = self.messages(e)
            b = self.backward(e, size)
            p = np.where(here, _sigmoid(a + b), 0.0)
            err = np.where(here, y - p, 0.0)
            g = np.zeros_like(theta)
            g[:N_FEATURES] = np.einsum("tlf,tl->f", x, err)
            g[-1] = err[0].sum()
            after = e[1:] + b[1:]
            joint = np.stack([np.full_like(after, self.move[0, 0]), self.move[0, 1] + after,
                              a[:-1] + self.move[1, 0], a[:-1] + self.move[1, 1] + after])
            joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0))
            seen = np.stack([(1 - y[:-1]) * (1 - y[1:]), (1 - y[:-1]) * y[1:], y[:-1] * (1 - y[1:]), y[:-1] * y[1:]])
            g[N_FEATURES:-1] = ((seen - joint) * pair).sum(axis=(1, 2))
            g = g / here.sum() - 1e-4 * theta
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-9)
        self.emit, self.move, self.begin = theta[:N_FEATURES], theta[N_FEATURES:-1].reshape(2, 2), float(theta[-1])
        return self


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


def _padded(values: np.ndarray, first: np.ndarray, size: np.ndarray, fill=0.0) -> np.ndarray:
    out = np.full((int(size.max()), len(size)) + values.shape[1:], fill)
    col = np.repeat(np.arange(len(size)), size)
    row = C.ranges(np.zeros(len(size), np.int64), size)
    out[row, col] = values[C.ranges(first, size)]
    return out


class ToxicityModel:
    """Evidence table, chain and document calibration."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.keys, self.weights, self.chain, self.scale = prior, np.zeros(0, C.U64), np.zeros(0), None, None

    def features(self, kinds: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(kinds[0]), N_FEATURES))
        x[:, 0] = 1.0
        if len(self.keys):
            for k, h in enumerate(kinds):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                x[:, k + 1] = np.where(self.keys[at] == h, self.weights[at], 0.0)
            x[:, -1] = x[:, 1:-1].max(axis=1)
        return x

    def tag(self, data: np.ndarray, offs: np.ndarray):
        """(document features, byte spans of toxic words per text)."""
        start, end, first, doc, line, kinds = words(data, offs)
        n = np.diff(first)
        feats, spans = np.zeros((len(n), 3)), [[] for _ in n]
        if not len(start) or self.chain is None:
            return feats, spans
        x = self.features(kinds)
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(doc) != 0)]))
        size = np.diff(np.append(edge, len(start)))
        use = np.add.reduceat((x[:, -1] > 0).astype(np.int64), edge) > 0
        edge, size = edge[use], size[use]
        order = np.argsort(-size, kind="stable")
        edge, size = edge[order], size[order]
        at = 0
        while at < len(size):                  # lines of like length together, so that pads stay few
            to = at + max(1, int(2_000_000 // (size[at] * N_FEATURES)))
            lines, sizes = edge[at:to], size[at:to]
            p = self.chain.marginals(_padded(x, lines, sizes) @ self.chain.emit, sizes)
            where = C.ranges(lines, sizes)
            p = p[C.ranges(np.zeros(len(sizes), np.int64), sizes), np.repeat(np.arange(len(sizes)), sizes)]
            d = doc[where]
            np.add.at(feats[:, 0], d, p)
            np.maximum.at(feats[:, 1], d, p)
            for i in where[p >= 0.5].tolist():
                o = offs[doc[i]]
                spans[doc[i]].append((int(start[i] - o), int(end[i] - o)))
            at = to
        feats[:, 2] = np.sqrt(feats[:, 0] / np.maximum(1, n))
        feats[:, 0] = np.log1p(feats[:, 0])
        return feats, [sorted(s) for s in spans]

    def scores(self, feats: np.ndarray) -> np.ndarray:
        if self.scale is None:
            return np.full(len(feats), self.prior)
        return _sigmoid(feats @ self.scale[:-1] + self.scale[-1])


def _evidence(sample: DataFrame) -> DataFrame:
    """``(h, toxic, clean)``: documents of either label that hold each word piece."""

    def count(batches):
        for batch in C.small_batches(batches):
            _, _, _, doc, _, kinds = words(*C.buffer_of(batch.column(batch.schema.get_field_index("_text"))))
            y = C.column(batch, "y").astype(np.int64)
            for h in kinds:
                if not len(h):
                    continue
                order = np.lexsort((doc, h))
                hs, ds = h[order], doc[order]
                new = np.concatenate([[True], (np.diff(ds) != 0) | (hs[1:] != hs[:-1])])
                hs, toxic = hs[new], y[ds[new]]
                edge = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
                t = np.add.reduceat(toxic, edge)
                n = np.diff(np.append(edge, len(hs)))
                yield pa.RecordBatch.from_arrays([pa.array(hs[edge].view(np.int64)), pa.array(t), pa.array(n - t)],
                                                 names=["h", "toxic", "clean"])

    pieces = sample.where("fold <> 1").mapInArrow(count, "h long, toxic long, clean long")
    return pieces.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        bound: dict[int, int] | None = None) -> ToxicityModel:
    drawn = training_labels(labels, "toxic", bound or TRAIN_BOUND, id_col)
    # the drawn labels are bounded by TRAIN_BOUND, so this side may be broadcast
    sample = C.stored(C.keyed(docs, id_col, text_col).join(F.broadcast(drawn), "_id")
                      .select("_id", "_sub", "_text", "y", "fold"), "toxicity-sample")
    sizes = {r.y: (r.n, r.m) for r in sample.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.expr("int(fold <> 1)")).alias("m")).collect()}
    total = sum(n for n, _ in sizes.values())
    model = ToxicityModel(sizes.get(1, (0, 0))[0] / total if total else 0.5)
    if len(sizes) < 2 or not all(m for _, m in sizes.values()):
        return model
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    # log odds less their own uncertainty, so that a few chance occurrences in a small sample weigh little
    odds = F.log(t / (sizes[1][1] + 1.0)) - F.log(c / (sizes[0][1] + 1.0)) - CAUTION * F.sqrt(1 / t + 1 / c)
    table = (_evidence(sample).withColumn("w", odds).where(F.col("toxic") >= LEAST_DOCS).where("w > 0.5")
             .orderBy(F.desc("toxic"), "h").limit(TABLE_BOUND).collect())
    keys = np.array([r.h for r in table], np.int64).view(C.U64)
    order = np.argsort(keys)
    model.keys, model.weights = keys[order], np.array([r.w for r in table])[order]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def lines(batches):
        """Lines (cut at TRAIN_WORDS words) with some evidence, and one line in 50 of the others."""
        for batch in C.small_batches(batches):
            start, _, _, doc, line, kinds = words(*C.buffer_of(batch.column(batch.schema.get_field_index("_text"))))
            if not len(start):
                continue
            y, ids = C.column(batch, "y").astype(np.int64), C.column(batch, "_id").astype(np.int64)
            x = shared.value.features(kinds)
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(doc) != 0)]))
            size = np.diff(np.append(edge, len(start)))
            parts = np.maximum(1, -(-size // TRAIN_WORDS))
            at = np.repeat(edge, parts) + C.ranges(np.zeros(len(edge), np.int64), parts) * TRAIN_WORDS
            size = np.minimum(TRAIN_WORDS, np.repeat(edge + size, parts) - at)
            draw = C.mix(ids[doc[at]].astype(C.U64) * C.U64(0x9E3779B97F4A7C15) + at.astype(C.U64))
            strong = np.concatenate([[0], np.cumsum(x[:, -1] > 0)])
            keep = (strong[at + size] > strong[at]) | (draw % C.U64(50) == 0)
            at, size, draw = at[keep], size[keep], draw[keep]
            tag = ((x[:, -1] >= STRONG) & (y[doc] == 1)).astype(np.uint8)
            small = x.astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(draw.view(np.int64)),
                 pa.array([small[a:a + n].tobytes() for a, n in zip(at.tolist(), size.tolist())], pa.binary()),
                 pa.array([tag[a:a + n].tobytes() for a, n in zip(at.tolist(), size.tolist())], pa.binary())],
                names=["r", "x", "y"])

    found = C.stored(sample.where("fold <> 1").mapInArrow(lines, "r long, x binary, y binary"), "toxicity-lines")
    share = min(1.0, TRAIN_LINES / max(1, found.count()))
    got = sorted(found.where(F.pmod("r", F.lit(1_000_000)) < int(1_000_000 * share)).collect())
    if not got:
        return model
    size = np.array([len(r.y) for r in got], np.int64)
    first = np.cumsum(size) - size
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got]).astype(float)
    y = np.concatenate([np.frombuffer(r.y, np.uint8) for r in got]).astype(float)
    model.chain = Chain(N_FEATURES).fit(_padded(x, first, size), _padded(y, first, size), size)
    tagger = docs.sparkSession.sparkContext.broadcast(model)

    def doc_features(batches):
        for batch in C.small_batches(batches):
            f, _ = tagger.value.tag(*C.buffer_of(batch.column(batch.schema.get_field_index("_text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_sub", "y", "fold")]
                + [pa.array(f[:, k]) for k in range(3)], names=["_id", "_sub", "y", "fold", "a", "b", "c"])

    rows = sorted(sample.mapInArrow(doc_features, "_id long, _sub int, y int, fold long, a double, b double, c double").collect())
    held = [r for r in rows if r.fold == 1]
    rows = held if len({r.y for r in held}) == 2 else rows
    f = np.array([[r.a, r.b, r.c] for r in rows])
    model.scale = _logistic(f, np.array([r.y for r in rows], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last entry is the constant."""
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
    return w


OUT = "_id long, _sub int, score double, spans array<struct<start:int,end:int>>"


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _sub, score, spans)`` of every document, whole texts; spans are byte offsets of toxic words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in C.small_batches(batches):
            m = shared.value
            f, spans = m.tag(*C.buffer_of(batch.column(batch.schema.get_field_index("_text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(m.scores(f)),
                 pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)],
                names=["_id", "_sub", "score", "spans"])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, OUT)


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels)).select(C.public_id(), "score", F.size("spans").alias("n_spans"))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans")
