"""Operator 4, n-gram Jaccard join by chosen paths.

A document's set holds the hashes of its five-word shingles (of all its words where it has fewer; words are
``[^\\x20\\x09-\\x0D]+``, unchanged).  Texts with a Jaccard similarity of ``SIMILARITY`` or more are linked.

1. Equal texts collapse to their first document (128-bit text hash); copies share its links.
2. Chosen paths: in each of ``RUNS`` runs a set picks every shingle whose run hash is below ``PICKS / size``; sets that
   pick the same shingle meet in a bucket.  Buckets over ``LIMIT`` whose members do not look alike split again: each
   member picks shingles by a hash of (path, shingle), up to ``DEPTH`` picks.  Picks depend on content only.
3. A document none of whose buckets was split follows the ``KEPT`` smallest of them, any other follows all of its final
   buckets (a split adds leaves that one side alone picks, so a cut would lose shared ones).  Two similar sets miss each
   other only if they share none of the followed: at the threshold itself, one set inside the other and every leaf with
   other members too, the computed chance is 5.4e-6 without splits, 3.0e-6 after one and 9.9e-6 after two (``DEPTH``),
   the sketch filter's part (1.8e-7) included.
4. Small buckets are compared by brute force; a large one is dealt to blocks of ``BLOCK`` documents (fewer, if they are long), and every pair of
   blocks is a task group of its own, so no bucket is bound to one task and none is cut.  A pair is handled
   only in the smallest bucket that both follow, and only if size and a 32-byte sketch allow the threshold.
5. The pairs left are verified on their whole shingle sets; each block pair returns link counts and a spanning forest,
   never the pairs.
6. Components of the forests come from large-star/small-star rounds (joins and groupings, stored each round).

Result: one row per document with ``text_id`` (first document of the same text), ``group_id`` (first document of the
connected group) and ``n_links`` (other texts linked to this text).

Defined results: null and empty texts are the empty text; texts without words link to nothing but their equals; rows
that repeat an id are documents of their own (``_sub``); a null id is the smallest; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import common as C
from .registry import query

SHINGLE, SIMILARITY = 5, 0.8
RUNS, PICKS, LIMIT, DEPTH, KEPT = 10, 2.0, 64, 3, 8
BLOCK_SHINGLES = 1 << 19                     # a block holds about so many shingles at most, however long its texts
SET_BYTES = 1 << 18                         # texts whose shingle sets are made at once
ATTACH_BYTES = 2 << 20                      # rows with their shingle sets go on in batches of this size
HOLD = 4096                                 # columns of a 0/1 matrix of documents that is held at once
BLOCK, SKETCH, ALIKE = 512, 32, 13          # ALIKE of 32 sketch bytes: a pair at 0.8 falls below with p < 1e-6


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, back to back, and where each text's begin."""
    start, end, first = C.word_spans(data, offs, C.WORD_PLAIN)
    n = np.diff(first)
    w = C.ROLL_A.span(C.ROLL_A.prefix(C.BYTE_A[data]), start, end)
    p = C.ROLL_A.prefix(w)
    count = np.where(n > 0, np.maximum(1, n - SHINGLE + 1), 0)
    at = C.ranges(first[:-1], count)
    doc = np.repeat(np.arange(len(n)), count)
    h = C.ROLL_A.span(p, at, np.minimum(at + SHINGLE, first[1:][doc]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def picked(h: np.ndarray, doc: np.ndarray, size: np.ndarray, seed: np.ndarray | C.U64) -> tuple[np.ndarray, np.ndarray]:
    """(owner, path) of the shingles whose seeded hash falls below PICKS / size."""
    x = C.mix(h ^ seed)
    with np.errstate(over="ignore"):
        bound = np.where(size <= PICKS, C.U64(C.MASK), (PICKS / np.maximum(1, size) * 2.0 ** 64).clip(0, 2.0 ** 64 - 4096).astype(C.U64))
    take = x <= bound[doc]
    return doc[take], C.mix(x[take] + C.U64(0x632BE59BD9B4E019))


_SEEDS = C.mix(np.arange(1, RUNS + 1, dtype=C.U64) * C.U64(0x9E6C63D0876A9A35))
_TURNS = C.mix(np.arange(1, SKETCH + 1, dtype=C.U64) * C.U64(0xC2B2AE3D27D4EB4F)) | C.U64(1)

SIGNED = "_id long, _sub int, t1 long, t2 long, n int, paths array<long>, sketch binary"


def signatures(docs: DataFrame) -> DataFrame:
    """Text hash, set size, first-level paths and sketch of every keyed document."""

    def run(batches):
        for batch in C.small_batches(batches, limit=SET_BYTES):
            data, offs = C.buffer_of(batch.column(batch.schema.get_field_index("_text")))
            t1 = C.ROLL_A.span(C.ROLL_A.prefix(C.BYTE_A[data]), offs[:-1], offs[1:])
            t2 = C.ROLL_B.span(C.ROLL_B.prefix(C.BYTE_B[data]), offs[:-1], offs[1:])
            h, first = shingles(data, offs)
            size = np.diff(first)
            doc = np.repeat(np.arange(len(size)), size)
            got = [picked(h, doc, size, s) for s in _SEEDS]
            owner, path = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(size) + 1)).astype(np.int32)
            sketch = np.zeros((len(size), SKETCH), np.uint8)
            full = size > 0
            if full.any():
                for k, turn in enumerate(_TURNS):
                    sketch[full, k] = np.minimum.reduceat(h * turn, first[:-1][full]) & C.U64(255)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("_id")), batch.column(batch.schema.get_field_index("_sub")),
                 pa.array(t1.view(np.int64)), pa.array(t2.view(np.int64)), pa.array(size.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(path[order].view(np.int64))),
                 pa.array([r.tobytes() for r in sketch], pa.binary())],
                names=["_id", "_sub", "t1", "t2", "n", "paths", "sketch"])

    return docs.mapInArrow(run, SIGNED)


MEMBER = "path long, _id long, _sub int"


def split_paths(docs: DataFrame, crowded: DataFrame) -> DataFrame:
    """One more pick below each crowded path: ``(path, _id, _sub)`` of the children."""
    owned = crowded.groupBy("_id", "_sub").agg(F.collect_list("path").alias("at"))

    def run(batches):
        for batch in C.small_batches(batches, limit=SET_BYTES):
            h, first = shingles(*C.buffer_of(batch.column(batch.schema.get_field_index("_text"))))
            size = np.diff(first)
            col = batch.column(batch.schema.get_field_index("at"))
            count = np.diff(col.offsets.to_numpy())
            path = col.flatten().to_numpy().astype(np.int64).view(C.U64)
            own = np.repeat(np.arange(len(size)), count)
            # every (document, path) pair sees the document's whole set
            for lo in range(0, len(path), 256):
                cut = slice(lo, lo + 256)
                per = size[own[cut]]
                where = C.ranges(first[own[cut]], per)
                which = np.repeat(np.arange(len(per)), per)
                o, child = picked(h[where], which, per, C.mix(path[cut])[which])
                d = own[cut][o]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), pa.array(C.column(batch, "_id")[d]), pa.array(C.column(batch, "_sub")[d])],
                    names=["path", "_id", "_sub"])

    return C.sieved(docs, crowded).join(owned, ["_id", "_sub"]).mapInArrow(run, MEMBER)


def final_buckets(docs: DataFrame, reps: DataFrame, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """``(path, _id, _sub, split)`` of all buckets that are small, alike, or at the last depth.  A crowded bucket leaves a
    row without a path; ``split`` marks it and its leaves."""
    look = reps.select("_id", "_sub", F.substring("sketch", 1, 1).alias("look"))
    rows = reps.select(F.explode("paths").alias("path"), "_id", "_sub", F.substring("sketch", 1, 1).alias("look"))
    done = None
    for level in range(1, depth + 1):
        sizes = (rows.groupBy("path", "look").agg(F.count(F.lit(1)).alias("m"))
                 .groupBy("path").agg(F.sum("m").alias("m"), F.max("m").alias("most")).where("m > 1"))
        now = C.stored(rows.join(sizes, "path").select(
            "path", "_id", "_sub", ((F.col("m") > limit) & (F.col("most") * 2 < F.col("m"))).alias("crowded")), f"paths-{level}")
        last = level == depth
        kept = F.col("path") if last else F.when(~F.col("crowded"), F.col("path"))
        small = now.select(kept.alias("path"), "_id", "_sub", (F.lit(level > 1) if last else F.col("crowded") | F.lit(level > 1)).alias("split"))
        done = small if done is None else done.unionByName(small)
        if last:
            break
        crowded = now.where("crowded").select("path", "_id", "_sub")
        if not crowded.limit(1).count():
            break
        rows = split_paths(docs, crowded).join(look, ["_id", "_sub"])
    return done


def _pairs_allowed(ids, subs, n, side, sketch, follows, bucket, same, similarity):
    """Mask over (left documents x right documents): pairs that this bucket owns and that may reach the similarity."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    small = np.minimum(n[left][:, None], n[right][None, :])
    ok = small >= similarity * np.maximum(n[left][:, None], n[right][None, :]) - 1e-9
    if same:
        ok &= left[:, None] < right[None, :]
    if ok.any():
        for lo in range(0, len(left), 128):
            cut = slice(lo, lo + 128)
            ok[cut] &= (sketch[left[cut]][:, None, :] == sketch[right][None, :, :]).sum(-1) >= ALIKE
    if ok.any():
        row = np.repeat(np.arange(len(n)), [len(f) for f in follows])
        flat = np.concatenate(follows) if len(follows) else np.zeros(0, np.int64)
        row, flat = row[flat < bucket], flat[flat < bucket]          # smaller buckets that either follows
        if len(flat):
            keys, col = np.unique(flat, return_inverse=True)
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            for lo in range(0, len(keys), HOLD):         # documents that were split follow many paths
                at = slice(*np.searchsorted(col, [lo, lo + HOLD]))
                hold = np.zeros((len(n), min(HOLD, len(keys) - lo)), np.float32)
                hold[row[at], col[at] - lo] = 1
                ok &= (hold[left] @ hold[right].T) == 0
    return left, right, ok


def _groups(batches, keys: list[str]):
    """Rows of each key of a key-sorted stream, as one table."""
    held: list[pa.RecordBatch] = []

    def key_of(b, i):
        return tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [C.column(batch, k) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]]).tolist()
        if held and key_of(held[-1], 0) != key_of(batch, 0):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip(edges, edges[1:]):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


GROUP = "path long, bi int, bj int, _id long, _sub int, n int, side int, sketch binary, follows array<long>"
VERIFY = GROUP + ", shingles binary"
FOUND = "_id long, _sub int, links long, root_id long, root_sub int"
_KEYS = ["path", "bi", "bj"]


def _unpack(t: pa.Table):
    ids, subs, n, side = (t[c].to_numpy() for c in ("_id", "_sub", "n", "side"))
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(ids), SKETCH)
    follows = [np.array(f, np.int64) for f in t["follows"].to_pylist()]
    key = [t[k][0].as_py() for k in _KEYS]
    return ids, subs, n, side, sketch, follows, key


def block_groups(buckets: DataFrame, reps: DataFrame, kept: int = KEPT, block: int = BLOCK,
                 similarity: float = SIMILARITY) -> DataFrame:
    """Deal the followed buckets to block pairs; only documents that take part in an allowed pair stay."""
    own = buckets.groupBy("_id", "_sub").agg(F.array_sort(F.collect_set("path")).alias("all"), F.max("split").alias("split")) \
        .select("_id", "_sub", F.when(F.col("split"), F.col("all")).otherwise(F.slice("all", 1, kept)).alias("follows"))
    rows = own.join(reps.select("_id", "_sub", "n", "sketch"), ["_id", "_sub"]) \
              .withColumn("path", F.explode("follows"))
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).where("m > 1")
    g = F.ceil(F.greatest(F.col("m") / block, F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = rows.join(sizes, "path").withColumn("g", g) \
               .withColumn("b", F.pmod(F.xxhash64("_id", "_sub"), F.col("g")).cast("int"))
    # block b meets each block o: as the left one of (b, o) if b < o, the right one of (o, b) if b > o, both if equal
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "path", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "_id", "_sub", "n",
        F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1).alias("side"), "sketch", "follows")

    def run(batches):
        for t in _groups(batches, _KEYS):
            if t.num_rows < 2:
                continue
            ids, subs, n, side, sketch, follows, (path, bi, bj) = _unpack(t)
            left, right, ok = _pairs_allowed(ids, subs, n, side, sketch, follows, path, bi == bj, similarity)
            use = np.zeros(len(ids), bool)
            use[left[ok.any(axis=1)]] = True
            use[right[ok.any(axis=0)]] = True
            if use.any():
                yield from t.filter(pa.array(use)).to_batches()

    return dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "_id", "_sub").mapInArrow(run, GROUP)


def verify(docs: DataFrame, groups: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Exact similarity of the allowed pairs: per document and block pair its links and its root in the forest."""
    fields = ["path", "bi", "bj", "n", "side", "sketch", "follows"]
    owned = groups.groupBy("_id", "_sub").agg(F.collect_list(F.struct(*fields)).alias("at"))

    def attach(batches):
        for batch in C.small_batches(batches, limit=SET_BYTES):
            h, first = shingles(*C.buffer_of(batch.column(batch.schema.get_field_index("_text"))))
            col = batch.column(batch.schema.get_field_index("at"))
            own = np.repeat(np.arange(batch.num_rows), np.diff(col.offsets.to_numpy()))
            flat = col.flatten()
            sets = [h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            held = np.cumsum(np.diff(first)[own] * 8 + 256)          # bytes of the rows so far
            lo = 0
            while lo < len(own):
                hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + ATTACH_BYTES, side="right")))
                d, took = own[lo:hi], slice(lo, hi)
                lo = hi
                part = {f: flat.field(f)[took.start:took.stop] for f in fields}
                part |= {"_id": pa.array(C.column(batch, "_id")[d]), "_sub": pa.array(C.column(batch, "_sub")[d]),
                         "shingles": pa.array([sets[x] for x in d.tolist()], pa.binary())}
                order = ["path", "bi", "bj", "_id", "_sub", "n", "side", "sketch", "follows", "shingles"]
                yield pa.RecordBatch.from_arrays([part[c] for c in order], names=order)

    def compare(batches):
        for t in _groups(batches, _KEYS):
            ids, subs, n, side, sketch, follows, (path, bi, bj) = _unpack(t)
            left, right, ok = _pairs_allowed(ids, subs, n, side, sketch, follows, path, bi == bj, similarity)
            if not ok.any():
                continue
            size = n.astype(np.int64)
            tokens = np.frombuffer(b"".join(t["shingles"].to_pylist()), C.U64)
            row = np.repeat(np.arange(len(ids)), size)
            order = np.argsort(tokens, kind="stable")
            tok, row = tokens[order], row[order]
            new = np.concatenate([[True], tok[1:] != tok[:-1]])
            col = np.cumsum(new) - 1
            shared = np.bincount(col) > 1                            # a token of one document meets nothing
            col, row = (np.cumsum(shared) - 1)[col][shared[col]], row[shared[col]]
            both = np.zeros((len(left), len(right)), np.float32)
            for lo in range(0, int(shared.sum()), HOLD):
                at = slice(*np.searchsorted(col, [lo, lo + HOLD]))
                x = np.zeros((len(ids), HOLD), np.float32)
                x[row[at], col[at] - lo] = 1
                both += x[left] @ x[right].T
            total = size[left][:, None] + size[right][None, :] - both
            ok &= both >= similarity * total - 1e-6
            if not ok.any():
                continue
            a, b = np.nonzero(ok)
            a, b = left[a], right[b]
            links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
            # ids ascend within a group, so the smallest row number of a component is its smallest document
            root = np.arange(len(ids))
            while True:
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            use = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[use]), pa.array(subs[use]), pa.array(links[use]), pa.array(ids[root[use]]), pa.array(subs[root[use]])],
                names=["_id", "_sub", "links", "root_id", "root_sub"])

    return C.sieved(docs, groups).join(owned, ["_id", "_sub"]).mapInArrow(attach, VERIFY) \
               .repartition(*_KEYS).sortWithinPartitions(*_KEYS, "_id", "_sub").mapInArrow(compare, FOUND)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(u, root)`` for all nodes of ``edges(u, v)``; large-star and small-star rounds until nothing moves."""
    edges = C.stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v")).where("u <> v").distinct()
        nxt = C.stored(small, name)
        check = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check(nxt) == check(edges):
            return nxt.select("u", F.col("v").alias("root"))
        edges = nxt


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                    block: int = BLOCK, similarity: float = SIMILARITY) -> DataFrame:
    """``(_id, _sub, text_id, text_sub, n_copies, group_id, group_sub, n_links)``, one row per document.

    The runs, picks and the sketch are set for ``SIMILARITY``; a lower ``similarity`` would lose pairs and is refused."""
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"similarity {similarity} is outside {SIMILARITY} to 1")
    C.bounded_batches(docs.sparkSession)
    rows = C.keyed(docs, id_col, text_col)
    signed = C.stored(signatures(rows), "signatures")
    key = F.struct("_id", "_sub")
    firsts = signed.groupBy("t1", "t2").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    member = C.stored(signed.join(firsts, ["t1", "t2"]).select("_id", "_sub", "rep", "n_copies", (key == F.col("rep")).alias("first")), "members")
    reps = C.stored(signed.join(member.where("first").select("_id", "_sub"), ["_id", "_sub"]).where("n > 0"), "representatives")
    groups = C.stored(block_groups(final_buckets(rows, reps, limit), reps, block=block, similarity=similarity), "block-groups")
    found = C.stored(verify(rows, groups, similarity), "links")
    links = found.groupBy("_id", "_sub").agg(F.sum("links").alias("n_links")).select(key.alias("rep"), "n_links")
    roots = components(found.select(key.alias("u"), F.struct(F.col("root_id").alias("_id"), F.col("root_sub").alias("_sub")).alias("v")))
    roots = roots.select(F.col("u").alias("rep"), "root")
    out = member.join(links, "rep", "left").join(roots, "rep", "left")
    root = F.coalesce("root", "rep")
    return out.select("_id", "_sub", F.col("rep._id").alias("text_id"), F.col("rep._sub").alias("text_sub"), "n_copies",
                      root["_id"].alias("group_id"), root["_sub"].alias("group_sub"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their group."""
    first = near_duplicates(docs, id_col, text_col).where("_id = group_id AND _sub = group_sub").select("_id", "_sub")
    return C.keyed(docs, id_col, text_col, row=True).join(first, ["_id", "_sub"], "left_semi").select("_row.*")


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark, sf_dir):
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    shown = lambda c: F.when(F.col(c) != F.lit(C.NULL_ID), F.col(c)).alias(c)                  # noqa: E731
    return out.select(C.public_id(), shown("text_id"), "n_copies", shown("group_id"), "n_links")
