"""Shared pieces of the text operators: keyed documents, byte buffers, word spans, rolling hashes.

Every operator works on ``keyed`` rows ``(_id, _sub, _text)``:

* ``_id``   the document id; a null id counts as the smallest id,
* ``_sub``  0, or the rank among rows that repeat an id (ordered by text, a null text as the empty one), so
  that repeated rows are documents of their own, in a defined order,
* ``_text`` the whole text, null as the empty text.

Extra columns of the input are never touched, so they may clash with any name used inside.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

NULL_ID = -(2 ** 63)
U64 = np.uint64
MASK = (1 << 64) - 1
BATCH_BYTES = 2 << 20  # text handled at once inside a task; one longer document is handled alone
STAGE_BYTES = 1 << 19  # the same in the pipeline's stages, whose Python workers live on from stage to stage and keep what they grew
ARROW_BYTES = 1 << 20  # rows given to a Python worker at once, unless the session says otherwise; one longer row comes alone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, which by default is bounded by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, name)}-{uuid.uuid4().hex[:6]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """``(_id, _sub, _text)``, with ``row`` also ``_row``, the whole input row; the rank of repeats is only computed
    where an id does repeat (one pass over ids)."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
                       *([F.struct(*docs.columns).alias("_row")] if row else []))
    repeats = base.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if repeats:
        sub = F.row_number().over(Window.partitionBy("_id").orderBy("_text")) - 1
    else:
        sub = F.lit(0)
    return base.select("_id", sub.cast("int").alias("_sub"), "_text", *(["_row"] if row else []))


def public_id(name: str = "doc_id"):
    """The caller's id again: the null id comes back as null."""
    return F.when(F.col("_id") != F.lit(NULL_ID), F.col("_id")).alias(name)


SIEVE_BITS = 20


def sieved(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` without most of the rows that a join with ``wanted`` on (_id, _sub) would drop, so that their texts are
    not shuffled.  A bitmap of ``2**SIEVE_BITS`` hashed keys (128 kB, whatever the table's size) is gathered and broadcast
    with the filter; where it fills up it lets more rows pass, never fewer."""
    place = F.pmod(F.xxhash64("_id", "_sub"), F.lit(1 << SIEVE_BITS))
    cell, bit = F.shiftright(place, 6).cast("int"), F.pmod(place, F.lit(64)).cast("int")
    rows = wanted.select(cell.alias("c"), bit.alias("b")).select("c", F.expr("shiftleft(1L, b)").alias("w"))
    cells = dict(rows.groupBy("c").agg(F.bit_or("w")).collect())        # 2**(SIEVE_BITS - 6) rows at most
    if not cells:
        return docs.limit(0)
    words = F.lit([cells.get(i, 0) for i in range(1 << (SIEVE_BITS - 6))]).cast("array<bigint>")
    return docs.where(F.call_function("bit_get", F.get(words, cell), bit) == 1)


# ---------------------------------------------------------------- byte buffers

def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts back to back, start offset of each text plus the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs - offs[0]


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "_text",
                  limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` text bytes (a longer single text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = buffer_of(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ---------------------------------------------------------------- rolling hashes

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial span hashes modulo 2**64: one prefix sum, then any span in two look-ups.

    The powers are kept per worker process and grow with the longest buffer seen.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) >= n:
            return
        size = 1 << (n - 1).bit_length()

        def powers(b):
            out = np.ones(1, U64)
            while len(out) < size:
                out = np.concatenate([out, out * U64(pow(b, len(out), 1 << 64))])
            return out

        self.up, self.down = powers(self.base), powers(self.inverse)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]``; the length is part of it."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


ROLL_A = Rolling(0x9E3779B97F4A7C15 | 1)
ROLL_B = Rolling(0xD1342543DE82EF95 | 1)
BYTE_A = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
BYTE_B = mix(np.arange(1, 257, dtype=U64) * U64(0x9FB21C651E98DF25))


def rightmost_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the last smallest value in each window of ``w`` values (ties go right, so equal windows
    choose the same offset)."""
    best, at, have = h, np.arange(len(h), dtype=np.int64), 1
    while have < w:
        step = min(have, w - have)
        right, left = best[step:], best[:-step]
        take = right <= left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        have += step
    return at


# ---------------------------------------------------------------- words

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_PLAIN = ~SPACE                               # [^\x20\x09-\x0D]+
WORD_FOLDED = np.zeros(256, bool)                 # after A-Z -> a-z: digits, a-z and every byte from 0x80
WORD_FOLDED[0x30:0x3A] = WORD_FOLDED[0x61:0x7B] = WORD_FOLDED[0x41:0x5B] = True
WORD_FOLDED[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text plus the end) of all words; no word crosses two texts."""
    inside = is_word[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    np.logical_not(inside[:-1], out=fresh[1:])
    heads = offs[:-1][offs[:-1] < len(data)]
    fresh[heads] = True
    start = np.flatnonzero(inside & fresh)
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = True
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(start, offs)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every range, back to back."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the places in any [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
