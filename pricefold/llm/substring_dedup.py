"""Operator 6, substring dedup by a compacted de Bruijn graph of word k-mers.

Edges are the 13-word windows, nodes their 12-word ends.  A word is removed where a window over it also starts in a
document with a smaller id.

1. Candidates: runs of consecutive edges that share a content-defined anchor leave each document as one segment
   (``anchors``).  Equal segments meet by a 128-bit key and the smallest document keeps each one; all edges of every other
   copy are repeats, so exact copies never enter the graph.
2. Edges: only where different segments share an anchor can single windows repeat; those segments are opened.  An edge is
   known by the hashes of its two nodes and an independent hash of its words.  Edges that occur in two documents or more
   make the graph, each with its source coordinate, the smallest occurrence.
3. Compaction, by joins of the node table: a node with one edge in and one edge out whose source coordinates go on alike
   does not branch, and its edges join to one path; all other nodes end paths.
4. Every document's occurrences of edges are led to their paths by a join on the source coordinate; along a path they
   become spans ``(document, start, end, source document, source start)``.  A span stands only as far as its places and the
   path's source coordinates advance together.  Equality is that of the 128-bit keys; texts are not compared again.

Defined results: a null or empty text has no words (0 words, hash of the empty text); texts of under 13 words lose
nothing; rows that repeat an id count as documents in order of their text (so a repeated row is removed as a copy); a
null id is the smallest id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import anchors as A
from . import common as C
from .registry import query

WINDOW, GRAM = 13, 5


def _units(batch: pa.RecordBatch):
    data, offs = C.buffer_of(batch.column(batch.schema.get_field_index("_text")))
    start, end, first = C.word_spans(data, offs, C.WORD_PLAIN)
    ua = C.ROLL_A.span(C.ROLL_A.prefix(C.BYTE_A[data]), start, end)
    ub = C.ROLL_B.span(C.ROLL_B.prefix(C.BYTE_B[data]), start, end)
    return data, offs, start, end, first, ua, ub


def paths(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def run(batches):
        for batch in C.small_batches(batches):
            *_, first, ua, ub = _units(batch)
            yield A.segment_rows(batch, first, A.segments(ua, ub, first, window, gram), across_documents=True)

    return docs.mapInArrow(run, A.ROWS)


EDGES = "left long, right long, e long, _id long, _sub int, pos int"
SOURCED = "_id long, _sub int, pos int, left long, right long, src_id long, src_sub int, src_pos int"
SOURCE = ["src_id", "src_sub", "src_pos"]


def open_edges(docs: DataFrame, reps: DataFrame, window: int = WINDOW) -> DataFrame:
    """The single edges of segments that share an anchor with different ones, with their nodes."""

    def run(batches):
        for batch in C.small_batches(batches):
            *_, first, ua, ub = _units(batch)
            row, a, nb = A.lists(batch, "segs", "a", "nb")
            pos = C.ranges(a.astype(np.int64), nb.astype(np.int64))
            row = np.repeat(row, nb)
            at = first[row] + pos
            pa_ = C.ROLL_A.prefix(ua)
            left, right = (C.ROLL_A.span(pa_, x, x + window - 1) for x in (at, at + 1))
            e = C.ROLL_B.span(C.ROLL_B.prefix(ub), at, at + window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(e.view(np.int64)),
                 pa.array(C.column(batch, "_id")[row]), pa.array(C.column(batch, "_sub")[row]), pa.array(pos.astype(np.int32))],
                names=["left", "right", "e", "_id", "_sub", "pos"])

    return A.with_segments(docs, reps).mapInArrow(run, EDGES)


def sources(edges: DataFrame) -> DataFrame:
    """Occurrences of edges that occur in a smaller document, with the smallest occurrence (streamed in key order)."""

    def run(batches):
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [C.column(batch, x) for x in ("e", "left", "right")]
            i, s, p = (C.column(batch, x) for x in ("_id", "_sub", "pos"))
            n = len(i)
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
            if carry is not None:
                new[0] = tuple(k[0] for k in key) != carry[0]
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            src = [np.where(at >= 0, v[at], carry[1][k] if carry else 0) for k, v in enumerate((i, s, p))]
            hit = (i != src[0]) | (s != src[1])
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[hit]) for v in (i, s, p, key[1], key[2], *src)],
                                                 names=["_id", "_sub", "pos", "left", "right", *SOURCE])
            carry = tuple(k[-1] for k in key), tuple(v[-1] for v in src)

    return edges.repartition("e").sortWithinPartitions("e", "left", "right", "_id", "_sub", "pos").mapInArrow(run, SOURCED)


def compacted(hits: DataFrame) -> DataFrame:
    """``(src_id, src_sub, src_pos, path)`` of every edge of the graph: paths are maximal runs of edges through nonbranching
    nodes, named by the source place of their first edge."""
    graph = hits.groupBy(*SOURCE).agg(F.min("left").alias("left"), F.min("right").alias("right"))
    edge = F.min(F.struct(*SOURCE))
    into = graph.groupBy(F.col("right").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), edge.alias("a"))
    out = graph.groupBy(F.col("left").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), edge.alias("b"))
    alike = (F.col("a.src_id") == F.col("b.src_id")) & (F.col("a.src_sub") == F.col("b.src_sub")) & (F.col("a.src_pos") + 1 == F.col("b.src_pos"))
    inner = into.where("n_in = 1").join(out.where("n_out = 1"), "node").where(alike).select("b.*", F.lit(True).alias("goes_on"))
    # a document's own edges in order; the last place where a path begins names it
    line = Window.partitionBy("src_id", "src_sub").orderBy("src_pos").rowsBetween(Window.unboundedPreceding, 0)
    return graph.select(*SOURCE).join(inner, SOURCE, "left") \
        .select(*SOURCE, F.max(F.when(F.col("goes_on").isNull(), F.col("src_pos"))).over(line).alias("path"))


def spans_of(hits: DataFrame, paths_: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences along one path as spans of words with their source coordinates."""
    line = Window.partitionBy("_id", "_sub", "src_id", "src_sub", "path", "shift").orderBy("pos")
    runs = hits.join(paths_, SOURCE).withColumn("shift", F.col("src_pos") - F.col("pos")) \
               .withColumn("run", F.col("pos") - F.row_number().over(line))
    return (runs.groupBy("_id", "_sub", "src_id", "src_sub", "path", "shift", "run")
            .agg(F.min("pos").alias("start"), (F.max("pos") + window).cast("int").alias("end"), F.min("src_pos").alias("src_start"))
            .select("_id", "_sub", "start", "end", "src_id", "src_sub", "src_start"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(_id, _sub, start, end)`` word spans of keyed documents that windows of smaller documents cover."""
    seen = C.stored(A.first_seen(paths(docs, window, gram), across_documents=True), "debruijn-paths")
    copies = seen.where("NOT rep").select("_id", "_sub", F.col("a").alias("start"),
                                          (F.col("a") + F.col("nb") + (window - 1)).cast("int").alias("end"))
    hits = C.stored(sources(open_edges(docs, seen.where("rep"), window)), "debruijn-edges")
    spans = spans_of(hits, compacted(hits), window)
    return copies.unionByName(spans.select("_id", "_sub", "start", "end"))


OUT = "_id long, _sub int, n_words long, n_removed long, kept string"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document its word counts and ``kept``, the kept words joined by one space."""
    rows = C.keyed(docs, id_col, text_col)

    def run(batches):
        for batch in C.small_batches(batches):
            data, offs, start, end, first, _, _ = _units(batch)
            row, s, e = A.lists(batch, "spans", "start", "end")
            gone = C.cover(len(start), first[row] + s, first[row] + e)
            raw = data.tobytes()
            kept = []
            for d in range(len(first) - 1):
                w = np.flatnonzero(~gone[first[d]: first[d + 1]]) + first[d]
                kept.append(b" ".join([raw[x:y] for x, y in zip(start[w].tolist(), end[w].tolist())]))
            n = np.diff(first)
            left = np.add.reduceat(np.append(~gone, False).astype(np.int64), first[:-1]) * (n > 0) if len(n) else n
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("_id")), batch.column(batch.schema.get_field_index("_sub")),
                 pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["_id", "_sub", "n_words", "n_removed", "kept"])

    return A.with_spans(rows, repeated_spans(rows, window)).mapInArrow(run, OUT)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
src AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN src USING (s) WHERE m < doc_id)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS t FROM w),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY j) AS k FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op6_substring_dedup", ORACLE)
def op6_substring_dedup(spark, sf_dir):
    out = dedup(C.table(spark, sf_dir, "documents"))
    return out.select(C.public_id(), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
