"""Operator 1, suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

1. Candidates: every 100-byte window belongs to one content-defined segment (``anchors``); equal windows share the
   segment's anchor.  Equal segments meet by key, the earliest keeps its bytes, the others lose all of theirs.
2. Shards: segments that share an anchor but differ around it are gathered by anchor (an anchor with more than
   ``HOT`` different segments is dealt by window content instead), and each task builds suffix arrays over shards of at
   most ``SHARD_BYTES``.  A window with more places than fit is dealt by place to sub-shards; each leaves the earliest
   place, and these meet again in rounds until one is left, so no group is bound to one task.
3. Suffix array by induced sorting, in numpy: suffixes are classified, leftmost-smaller (LMS) substrings are sorted by
   one induction and named; equal names recurse on the name string (whose alphabet is large, so its suffixes are
   ranked by pair doubling up to the window length); the sorted LMS suffixes then induce the whole array in two
   linear scans, bucket by bucket.
4. Permuted common prefixes: irreducible values are compared directly, all others follow from their predecessor.
   Neighbours in the array that agree on 100 bytes form a group; its earliest member stays, the others are removed.

Defined results: a null or empty text has 0 bytes; texts of under 100 bytes lose nothing; rows that repeat an id are
ordered by their text; a null id is the smallest id; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import common as C
from .registry import query

WINDOW, GRAM = 100, 32
HOT = 20_000
SHARD_BYTES = 2 << 20


# ---------------------------------------------------------------- suffix array

class _Buckets:
    """First places and sizes of the suffixes by first symbol."""

    def __init__(self, t: np.ndarray, sigma: int):
        self.size = np.bincount(t, minlength=sigma)
        self.start = np.cumsum(self.size) - self.size
        self.used = np.flatnonzero(self.size)


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last symbol is the unique smallest."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1].astype(np.int32))
    decided = np.where(step != 0, np.arange(n - 1), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    s = np.ones(n, bool)
    inner = decided < n
    s[:-1][inner] = step[decided[inner]] > 0
    s[:-1][~inner] = False
    return s


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array from LMS suffixes in order (within each bucket): one scan for L, one for S suffixes.

    The scans go bucket by bucket; what a bucket induces is appended to later buckets in scan order, and what it
    induces into itself is scanned next, as in the sequential algorithm."""
    b = _Buckets(t, sigma)
    n = len(t)
    sa = np.full(n, -1, np.int64)
    head = b.start.copy()

    def push_front(src):
        p = src[src > 0] - 1
        p = p[~s_type[p]]
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        c = c[order]
        edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.append(edge, len(c)))
        sym = c[edge]
        sa[np.repeat(head[sym] - edge, count) + np.arange(len(c))] = p[order]
        head[sym] += count

    lms_sym = t[lms]
    order = np.argsort(lms_sym, kind="stable")
    lms_in, at = lms[order], np.searchsorted(lms_sym[order], np.arange(sigma + 1))
    for c in b.used.tolist():
        lo = b.start[c]
        while lo < head[c]:
            hi = head[c]
            part, lo = sa[lo:hi], hi
            push_front(part)
        if at[c] < at[c + 1]:
            push_front(lms_in[at[c]: at[c + 1]])
    l_end = head
    tail = b.start + b.size

    def push_back(src):              # src in scan order: from the right
        p = src[src > 0] - 1
        p = p[s_type[p]]
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        c = c[order]
        edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        count = np.diff(np.append(edge, len(c)))
        sym = c[edge]
        sa[np.repeat(tail[sym] + edge, count) - 1 - np.arange(len(c))] = p[order]
        tail[sym] -= count

    for c in b.used[::-1].tolist():
        hi = b.start[c] + b.size[c]
        if c == t[n - 1] and b.size[c] == 1:
            sa[b.start[c]] = n - 1   # the sentinel
            tail[c] -= 1
        while hi > tail[c]:
            lo = tail[c]
            part, hi = sa[lo:hi][::-1], lo
            push_back(part)
        if b.start[c] < l_end[c]:
            push_back(sa[b.start[c]: l_end[c]][::-1])
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring, ``lms`` in text order, ``order`` the same places sorted by substring."""
    ends = np.append(lms[1:], len(t) - 1)
    length = np.zeros(len(t), np.int64)
    length[lms] = ends - lms + 1
    x, y = order[:-1], order[1:]
    differ = length[x] != length[y]
    todo = np.flatnonzero(~differ)
    step = 0
    while len(todo):
        other = t[x[todo] + step] != t[y[todo] + step]
        differ[todo[other]] = True
        todo = todo[~other]
        step += 1
        todo = todo[length[x[todo]] > step]
    rank = np.concatenate([[0], np.cumsum(differ)])
    name = np.empty(len(t), np.int64)
    name[order] = rank
    return name[lms]


def _rank_names(name: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of the name string, right for their first ``reach`` symbols."""
    rank, n, have = name, len(name), 1
    order = np.argsort(rank, kind="stable")
    while have < reach:
        nxt = np.zeros(n, np.int64)
        nxt[: n - have] = rank[have:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        have *= 2
        if new[-1] == n - 1:
            break
    return order


def suffix_array(t: np.ndarray, sigma: int, reach: int) -> np.ndarray:
    """Suffix array of ``t`` (symbols below ``sigma``, the last one the unique smallest), in the right order for
    at least the first ``reach`` symbols."""
    if len(t) < 2:
        return np.arange(len(t))
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    by_substring = induce(t, s, lms, sigma)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = by_substring[is_lms[by_substring]]
    name = _names(t, lms, order)
    if len(name) and name.max() + 1 < len(name):
        order = lms[_rank_names(name, max(2, reach // 2 + 1))]   # an LMS substring advances two symbols at least
    return induce(t, s, order, sigma)


def common_prefixes(t: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """Permuted common prefixes: for each place the agreement with its predecessor in the array, up to ``limit``."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    place = np.arange(n)
    prev = np.full(n, -2, np.int64)
    prev[1:] = phi[:-1]
    chained = (phi > 0) & (place > 0) & (prev == phi - 1)          # same neighbour, one symbol on
    chained[chained] = t[place[chained] - 1] == t[phi[chained] - 1]
    first = np.flatnonzero(~chained)
    x, y = first, phi[first]
    value = np.zeros(len(first), np.int64)
    todo = np.flatnonzero(y >= 0)
    # reducible values run down by one per place, so an irreducible one is needed up to limit + its run
    run = np.diff(np.append(first, n))
    most = limit + run
    step = 0
    while len(todo):
        a, b = x[todo] + step, y[todo] + step
        ok = (np.maximum(a, b) < n) & (step < most[todo])
        todo, a, b = todo[ok], a[ok], b[ok]
        same = t[a] == t[b]
        todo = todo[same]
        value[todo] += 1
        step += 1
    head = np.maximum.accumulate(np.where(chained, -1, place))
    full = np.zeros(n, np.int64)
    full[first] = value
    return np.minimum(limit, np.maximum(0, full[head] - (place - head)))


def repeated_windows(data: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """For a shard of byte segments in place order: True at each window start whose string also starts earlier."""
    n_seg = len(first) - 1
    t = np.zeros(len(data) + n_seg + 1, np.int16)                  # 1 ends a segment, 0 ends the shard
    at = np.arange(len(data)) + np.repeat(np.arange(n_seg), np.diff(first))
    t[at] = data.astype(np.int16) + 2
    t[first[1:] + np.arange(n_seg)] = 1
    sa = suffix_array(t, 258, window)
    alike = common_prefixes(t, sa, window) >= window
    start = np.zeros(len(t), bool)
    size = np.diff(first)
    fits = size >= window
    start[C.ranges((first[:-1] + np.arange(n_seg))[fits], (size - window + 1)[fits])] = True
    sa = sa[start[sa]]
    # group: neighbours in the array that agree on a whole window (places that are no window start never agree)
    head = np.flatnonzero(~alike[sa]) if len(sa) else np.zeros(0, np.int64)
    gone = np.zeros(len(t), bool)
    if len(sa):
        if not len(head) or head[0] != 0:
            head = np.concatenate([[0], head])
        earliest = np.minimum.reduceat(sa, head)
        gone[sa] = sa != np.repeat(earliest, np.diff(np.append(head, len(sa))))
    return gone[at]


# ---------------------------------------------------------------- operator

def byte_segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def run(batches):
        for batch in C.small_batches(batches):
            data, offs = C.buffer_of(batch.column(batch.schema.get_field_index("_text")))
            yield A.segment_rows(batch, offs, A.segments(C.BYTE_A[data], C.BYTE_B[data], offs, window, gram),
                                 across_documents=False)

    return docs.mapInArrow(run, A.ROWS)


SHARDED = "shard long, _id long, _sub int, a int, bytes binary"
SPANS = "_id long, _sub int, start int, end int"


def segment_bytes(docs: DataFrame, marked: DataFrame, window: int = WINDOW) -> DataFrame:
    """Bytes of the candidate segments with their shard key: the anchor, or for a ``hot`` anchor the window itself."""

    def run(batches):
        for batch in C.small_batches(batches):
            data, offs = C.buffer_of(batch.column(batch.schema.get_field_index("_text")))
            row, h, crowd, a, nb = A.lists(batch, "segs", "h", "hot", "a", "nb")
            crowd = crowd.astype(bool)
            parts = np.where(crowd, nb, 1).astype(np.int64)        # a hot segment goes window by window
            row, h, size = np.repeat(row, parts), np.repeat(h, parts), np.repeat(np.where(crowd, 1, nb), parts)
            a = C.ranges(a.astype(np.int64), parts)
            lo = offs[row] + a
            if crowd.any():
                prefix, split = C.ROLL_A.prefix(C.BYTE_A[data]), np.repeat(crowd, parts)
                h = np.where(split, C.ROLL_A.span(prefix, lo, lo + window).view(np.int64), h)
            size = size + window - 1
            ids, subs = C.column(batch, "_id")[row], C.column(batch, "_sub")[row]
            for at in range(0, len(lo), 20_000):
                cut = slice(at, at + 20_000)
                flat = data[C.ranges(lo[cut], size[cut])]
                ends = np.concatenate([[0], np.cumsum(size[cut])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[cut]), pa.array(ids[cut]), pa.array(subs[cut]), pa.array(a[cut].astype(np.int32)),
                     pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)])],
                    names=["shard", "_id", "_sub", "a", "bytes"])

    return A.with_segments(docs, marked, "h", "hot").mapInArrow(run, SHARDED)


PLACES = "_id long, _sub int, a int, gone boolean, bytes binary"


def shard_repeats(rows: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, places: bool = False) -> DataFrame:
    """Suffix arrays over shards; spans of the windows that start earlier too.  With ``places`` every row is one window:
    all rows come back, those that start earlier in the shard too as ``gone``, the others with their bytes."""

    def solve(parts):
        shard, i, s, a, data, first = parts
        order = np.lexsort((a, s, i))                              # places must ascend within the shard
        size = np.diff(first)[order]
        flat = data[C.ranges(first[:-1][order], size)]
        first = np.concatenate([[0], np.cumsum(size)])
        gone = repeated_windows(flat, first, window)
        if places:
            lost = gone[first[:-1]]
            ends = np.concatenate([[0], np.cumsum(np.where(lost, 0, size))]).astype(np.int32)
            left = pa.py_buffer(flat[~np.repeat(lost, size)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[order]), pa.array(s[order]), pa.array(a[order]), pa.array(lost),
                 pa.BinaryArray.from_buffers(pa.binary(), len(order), [None, pa.py_buffer(ends), left])],
                names=["_id", "_sub", "a", "gone", "bytes"])
            return
        edge = np.concatenate([[False], gone, [False]])
        edge = edge[1:].astype(np.int8) - edge[:-1].astype(np.int8)
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(lo):
            return
        seg = np.searchsorted(first, lo, side="right") - 1
        own = order[seg]
        start = a[own] + lo - first[seg]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i[own]), pa.array(s[own]), pa.array(start.astype(np.int32)),
             pa.array((start + (hi - lo) + window - 1).astype(np.int32))], names=["_id", "_sub", "start", "end"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data, first = C.buffer_of(batch.column(4))
            new = [C.column(batch, x) for x in ("shard", "_id", "_sub", "a")] + [data, first]
            if held is not None:
                new = [np.concatenate([x, y]) for x, y in zip(held[:5], new[:5])] + [
                    np.concatenate([held[5], new[5][1:] + held[5][-1]])]
            held = new
            while len(held[4]) > shard_bytes:
                shard, first = held[0], held[5]
                edge = np.flatnonzero(shard[1:] != shard[:-1]) + 1  # a shard ends between two anchors
                fit = edge[first[edge] <= shard_bytes]
                if not len(edge):
                    break
                cut = int(fit[-1]) if len(fit) else int(edge[0])
                yield from solve([x[:cut] for x in held[:4]] + [held[4][: first[cut]], first[: cut + 1]])
                held = [x[cut:] for x in held[:4]] + [held[4][first[cut]:], first[cut:] - first[cut]]
        if held is not None and len(held[0]):
            yield from solve(held)

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, PLACES if places else SPANS)


HEAVY_BITS = 20


def hot_repeats(rows: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Spans of the repeated windows of hot anchors (``rows``: stored, one window each).

    Windows with more places than half a shard holds are marked in a bitmap of a fixed size (others that it marks too only
    take the longer way) and dealt by place; a sub-shard leaves one place of each window for the next round."""
    most = max(2, shard_bytes // (2 * window))
    heavy = C.stored(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "heavy-windows")
    n = heavy.agg(F.max("n")).first()[0]
    if n is None:
        return shard_repeats(rows, window, shard_bytes)
    place = F.pmod("shard", F.lit(1 << HEAVY_BITS))
    cell, bit = F.shiftright(place, 6).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    cells = dict(heavy.select(cell.alias("c"), bit.alias("b")).select("c", F.expr("shiftleft(1L, b)").alias("w"))
                 .groupBy("c").agg(F.bit_or("w")).collect())            # 2**(HEAVY_BITS - 6) rows at most
    words = F.lit([cells.get(k, 0) for k in range(1 << (HEAVY_BITS - 6))]).cast("array<bigint>")
    marked = F.call_function("bit_get", F.get(words, cell), bit) == 1
    spans = shard_repeats(rows.where(~marked), window, shard_bytes)
    left, salts = rows.where(marked), -(-n // most)
    while salts > 1:
        salt = F.pmod(F.xxhash64("_id", "_sub", "a"), F.lit(salts))
        dealt = left.select(F.xxhash64("bytes", salt).alias("shard"), "_id", "_sub", "a", "bytes")
        solved = C.stored(shard_repeats(dealt, window, shard_bytes, places=True), "hot-round")
        spans = spans.unionByName(solved.where("gone").select(
            "_id", "_sub", F.col("a").alias("start"), (F.col("a") + window).cast("int").alias("end")))
        left = solved.where("NOT gone").select(F.xxhash64("bytes").alias("shard"), "_id", "_sub", "a", "bytes")
        salts = -(-salts // most)
    return spans.unionByName(shard_repeats(left, window, shard_bytes))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(_id, _sub, start, end)`` byte spans of keyed documents that strings starting earlier cover."""
    seen = C.stored(A.first_seen(byte_segments(docs, window, gram), across_documents=False), "suffix-segments")
    copies = seen.where("NOT rep").select("_id", "_sub", F.col("a").alias("start"),
                                          (F.col("a") + F.col("nb") + (window - 1)).cast("int").alias("end"))
    reps = seen.where("rep")
    crowded = C.stored(reps.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h"), "hot-anchors")
    cold = reps.withColumn("hot", F.lit(False))
    if not crowded.limit(1).count():
        return copies.unionByName(shard_repeats(segment_bytes(docs, cold, window), window, shard_bytes))
    windows = C.stored(segment_bytes(docs, reps.join(crowded, "h", "left_semi").withColumn("hot", F.lit(True)), window), "hot-windows")
    spans = copies.unionByName(hot_repeats(windows, window, shard_bytes))
    return spans.unionByName(shard_repeats(segment_bytes(docs, cold.join(crowded, "h", "left_anti"), window), window, shard_bytes))


OUT = "_id long, _sub int, n_bytes long, n_removed long, n_spans long, kept binary"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Per document its byte counts, removed runs and ``kept``, the remaining bytes."""
    rows = C.keyed(docs, id_col, text_col)

    def run(batches):
        for batch in C.small_batches(batches):
            data, offs = C.buffer_of(batch.column(batch.schema.get_field_index("_text")))
            row, s, e = A.lists(batch, "spans", "start", "end")
            gone = C.cover(len(data), offs[row] + s, offs[row] + e)
            n = np.diff(offs)
            total = np.concatenate([[0], np.cumsum(gone)])
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            heads = offs[:-1][n > 0]
            begin[heads] = gone[heads]
            runs = np.concatenate([[0], np.cumsum(begin)])
            removed = total[offs[1:]] - total[offs[:-1]]
            ends = np.concatenate([[0], np.cumsum(n - removed)]).astype(np.int32)
            kept = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data[~gone])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("_id")), batch.column(batch.schema.get_field_index("_sub")),
                 pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)),
                 pa.array((runs[offs[1:]] - runs[offs[:-1]]).astype(np.int64)), kept],
                names=["_id", "_sub", "n_bytes", "n_removed", "n_spans", "kept"])

    return A.with_spans(rows, repeated_spans(rows, window, **options)).mapInArrow(run, OUT)


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, sf_dir):
    out = dedup(C.table(spark, sf_dir, "documents"))
    return out.select(C.public_id(), "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
