"""Content-defined partitioning for exact repeat search, shared by the two substring operators.

All windows of W units (bytes or words) of a document are covered by *segments*: every window picks the smallest
hash among its k-unit grams (ties to the right), and neighbouring windows that pick the same gram form one segment.
The pick depends on the window's content only, so equal windows anywhere in the corpus pick equal grams: grouping
segments by the gram hash ``h`` brings all equal windows together, with about 2 / (W - k + 2) rows per unit.

``ctx`` is an independent 64-bit hash of the whole segment; equal ``(h, ctx)`` pairs (128 bits) are equal segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROWS = "h long, ctx long, _id long, _sub int, a int, nb int, gone boolean"


def segments(units_a: np.ndarray, units_b: np.ndarray, first: np.ndarray, window: int, gram: int):
    """(first window, window count, h, ctx) of all segments; positions count units from the buffer's start."""
    n = len(units_a)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.view(C.U64), none.view(C.U64)
    pa_, pb_ = C.ROLL_A.prefix(units_a), C.ROLL_B.prefix(units_b)
    at = np.arange(n - gram + 1)
    h = C.ROLL_A.span(pa_, at, at + gram)
    pick = C.rightmost_minimum(h, window - gram + 1)
    size = np.diff(first)
    full = size >= window
    j = C.ranges(first[:-1][full], size[full] - window + 1)     # windows inside one document
    if not len(j):
        return none, none, none.view(C.U64), none.view(C.U64)
    p = pick[j]
    head = np.concatenate([[True], (p[1:] != p[:-1]) | (j[1:] != j[:-1] + 1)])
    head = np.flatnonzero(head)
    a, nb = j[head], np.diff(np.append(head, len(j)))
    return a, nb, h[p[head]], C.ROLL_B.span(pb_, a, a + nb - 1 + window)


def segment_rows(batch: pa.RecordBatch, first: np.ndarray, found, across_documents: bool) -> pa.RecordBatch:
    """The segments of a batch.  Those that an earlier equal segment of the same batch already covers are marked
    ``gone``: they need not meet their anchor's other segments, which keeps a very common anchor's group small."""
    a, nb, h, ctx = found
    doc = np.searchsorted(first, a, side="right") - 1
    ids, subs = C.column(batch, "_id")[doc], C.column(batch, "_sub")[doc]
    a = (a - first[doc]).astype(np.int32)
    gone = np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((a, subs, ids, h ^ C.mix(ctx)))
        new = np.ones(len(h), bool)
        x, y = order[1:], order[:-1]
        new[1:] = (h[x] != h[y]) | (ctx[x] != ctx[y])
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        gone[order] = ((ids[order] != ids[head]) | (subs[order] != subs[head])) if across_documents else ~new
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids), pa.array(subs), pa.array(a),
         pa.array(nb.astype(np.int32)), pa.array(gone)], names=["h", "ctx", "_id", "_sub", "a", "nb", "gone"])


SEEN = "rep boolean, h long, _id long, _sub int, a int, nb int"


def first_seen(rows: DataFrame, across_documents: bool) -> DataFrame:
    """Stream the segments in (h, ctx, document, place) order and split them:

    * ``rep = false``: an equal segment occurs earlier, so all its windows do.  "Earlier" is any smaller place, or,
      with ``across_documents``, a smaller document;
    * ``rep = true``: the earliest one, kept only where other segments share its ``h`` (its windows may still occur
      in those); segments without any partner are not written.

    One group never has to fit into memory: only its first row (or the rows of its first document) is remembered.
    """

    def run(batches):
        carry, held = None, []       # last row's (h, ctx, first id, first sub, later class of its h); undecided rows
        for batch in batches:
            done = batch.column(batch.schema.get_field_index("gone"))
            if done.true_count:                      # sorted to the end
                yield _seen(batch, done.to_numpy(zero_copy_only=False), False)
                batch = batch.slice(0, batch.num_rows - done.true_count)
            if not batch.num_rows:
                continue
            h, c, i, s = (C.column(batch, x) for x in ("h", "ctx", "_id", "_sub"))
            n = len(h)
            new_h, new_c = np.ones(n, bool), np.ones(n, bool)
            new_h[1:] = h[1:] != h[:-1]
            new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
            if carry is not None:
                new_h[0] = h[0] != carry[0]
                new_c[0] = new_h[0] or c[0] != carry[1]
            place = np.arange(n)
            cls = np.maximum.accumulate(np.where(new_c, place, -1))
            grp = np.maximum.accumulate(np.where(new_h, place, -1))
            first_i = np.where(cls >= 0, i[cls], carry[2] if carry else 0)
            first_s = np.where(cls >= 0, s[cls], carry[3] if carry else 0)
            later = np.where(cls >= 0, cls > grp, carry[4] if carry else False)   # not the first class of its h
            gone = (i != first_i) | (s != first_s) if across_documents else ~new_c
            nxt = np.minimum.accumulate(np.where(new_c, place, n)[::-1])[::-1]
            nxt = np.append(nxt[1:], n)
            known = nxt < n
            followed = known & ~new_h[np.minimum(nxt, n - 1)]
            if held and new_c.any():
                if not new_h[int(np.argmax(new_c))]:
                    yield from held
                held = []
            keep = ~gone & (later | followed)
            for mask, rep in ((gone, False), (keep, True)):
                if mask.any():
                    yield _seen(batch, mask, rep)
            open_ = ~gone & ~later & ~known
            if open_.any():
                held.append(_seen(batch, open_, True))
            carry = (h[-1], c[-1], first_i[-1], first_s[-1], bool(later[-1]))

    # rows that are decided already go anywhere
    key = F.when(F.col("gone"), F.xxhash64("_id", "_sub", "a")).otherwise(F.col("h"))
    return rows.repartition(key).sortWithinPartitions("gone", "h", "ctx", "_id", "_sub", "a").mapInArrow(run, SEEN)


def _seen(batch: pa.RecordBatch, mask: np.ndarray, rep: bool) -> pa.RecordBatch:
    cols = [batch.column(batch.schema.get_field_index(x)).filter(pa.array(mask)) for x in ("h", "_id", "_sub", "a", "nb")]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), rep)), *cols],
                                      names=["rep", "h", "_id", "_sub", "a", "nb"])


def with_segments(docs: DataFrame, reps: DataFrame, *keys: str) -> DataFrame:
    """Documents that own representatives, with ``segs`` = their segments (at most as many as the text is long)."""
    owned = reps.groupBy("_id", "_sub").agg(F.collect_list(F.struct(*keys, "a", "nb")).alias("segs"))
    return C.sieved(docs, reps).join(owned, ["_id", "_sub"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """All documents with ``spans`` = array of (start, end), null where there are none."""
    owned = spans.groupBy("_id", "_sub").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.join(owned, ["_id", "_sub"], "left")


def lists(batch: pa.RecordBatch, name: str, *fields: str):
    """Flattened list column: (row of each entry, one array per field)."""
    col = batch.column(batch.schema.get_field_index(name))
    sizes = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, np.int64)
    sizes = np.where(np.asarray(col.is_valid()), sizes, 0)
    flat = col.flatten()
    row = np.repeat(np.arange(len(col)), sizes)
    return row, *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields)
