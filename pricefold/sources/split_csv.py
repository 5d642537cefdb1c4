"""Multi-line CSV read by many tasks (SRC-1).

Spark splits a file of lines by bytes, so every block starts at the start of a line, and there a reader is in one of two
states: between records, or inside a quoted value.  Three passes over the text, none of which shuffles it:

1. every block gives its effect on the state (two bits: the state after it, for either state before it);
2. the effects are composed in file order, one small row per block, which gives the true state before every block;
3. blocks are cut into records from the known state on.  A record that runs over the end of a block is put together from its
   parts, at most two of them per block.

The records are parsed by Spark's own CSV parser (``from_csv``), so values, nulls and quotes come out as from ``spark.read.csv``
with ``multiLine``.  Lines end in ``\\n`` or ``\\r\\n``; the text is UTF-8, and bytes that are not become replacement characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

#: one row per block is broadcast up to this many blocks (about 64 MB); beyond it the lines are shuffled to their block's row
BROADCAST_BLOCKS = 500_000
BATCH_BYTES = 4 << 20
OUT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("crlf", pa.bool_()),
                 ("record", pa.string())])
EFFECT = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_()),
                    ("crlf", pa.bool_())])

_CLOSE = re.compile(rb'(?:[^"]|"")*+"(?!")[^,]*+')
_FIELD = re.compile(rb'"(?:[^"]|"")*+"(?!")[^,]*+|(?!")[^,]*+')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the end of a line lies inside a quoted value.  A quote opens a value only at its start."""
    if b'"' not in line:
        return inside
    at = 0
    if inside:
        m = _CLOSE.match(line)
        if m is None:
            return True
        at = m.end()
        if at == len(line):
            return False
        at += 1
    while True:
        m = _FIELD.match(line, at)
        if m is None:
            return True
        at = m.end()
        if at == len(line):
            return False
        at += 1


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, block, state before it or None, whether the file's lines end in CR LF, line) in order."""
    for b in batches:
        cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        absent = [None] * b.num_rows
        yield from zip(cols["file"], cols["block"], cols.get("inside", absent), cols.get("crlf", absent), cols["line"])


def block_effects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The effect of every block; a file's first line says how its lines end."""
    def row():
        return pa.RecordBatch.from_pylist([dict(zip(EFFECT.names, (*key, out, inn, crlf)))], EFFECT)

    key = None
    for file, block, _, _, line in _blocks(batches):
        if (file, block) != key:
            if key:
                yield row()
            key, out, inn, crlf = (file, block), False, True, line.endswith(b"\r") if block == 0 else None
        if b'"' in line:
            same = out == inn
            out = ends_inside(line, out)
            inn = out if same else ends_inside(line, inn)
    if key:
        yield row()


def cut_records(parts_only: bool):
    """Records of every block: whole ones (``part`` 0), or the parts of those that pass a block's end (1: the start of a record,
    2: a middle or an end)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        key, begun, lines, first, ends = None, False, [], False, False

        def put(part: int):
            nonlocal size
            text = b"\n".join(lines)
            if part == 0 and ends:
                text = text.replace(b"\r\n", b"\n").removesuffix(b"\r")
            if (part > 0) == parts_only and (part > 0 or text):
                rows.append((*key, part, first, ends, text.decode("utf-8", "replace")))
                size += len(text)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT.types)], schema=OUT)

        for file, block, state, crlf, line in _blocks(batches):
            if (file, block) != key:
                if lines:
                    put(1 if begun else 2)
                if state is None:
                    raise ValueError(f"{file} was split otherwise in an earlier pass: no block starts at {block}")
                key, inside, lines, begun, first, ends = (file, block), state, [], not state, block == 0, crlf
            lines.append(line)
            inside = ends_inside(line, inside)
            if not inside:
                put(0 if begun else 2)
                first = first and not any(t.rstrip(b"\r") for t in lines)
                lines, begun = [], True
            if size > BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if lines:
            put(1 if begun else 2)
        if rows:
            yield batch()
    return run


def states_before(effects: DataFrame) -> DataFrame:
    """The state before every block.  An effect keeps the state, turns it, or sets it: the last one that sets it counts, and the
    turns since.  One row per block (128 MB of text by default) is ordered per file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    turn = (F.col("from_out") & ~F.col("from_in")).cast("int")
    turns = effects.withColumn("_turns", F.sum(turn).over(upto)).withColumn("_past", F.coalesce(F.sum(turn).over(before), F.lit(0)))
    sets = F.when(F.col("from_out") == F.col("from_in"), (F.col("from_out").cast("int") + F.col("_turns")) % 2)
    last = F.coalesce(F.last(sets, ignorenulls=True).over(before), F.lit(0))
    crlf = F.coalesce(F.max("crlf").over(Window.partitionBy("file")), F.lit(False))
    return turns.select("file", "block", ((last + F.col("_past")) % 2 == 1).alias("inside"), crlf.alias("crlf"))


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def read_records(spark: SparkSession, path: str, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(file, block, first, record): one row per record, quotes and line ends as they stand; ``first`` marks a file's first one."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))
    folder = scratch_dir(spark, "csv-blocks")
    states_before(lines.mapInArrow(block_effects, _ddl(EFFECT))).write.parquet(folder)
    states = spark.read.parquet(folder)
    if states.count() <= broadcast_blocks:
        known = lines.join(F.broadcast(states), ["file", "block"], "left")
    else:
        known = lines.withColumn("_n", F.monotonically_increasing_id()).join(states.hint("merge"), ["file", "block"], "left") \
            .repartition("file", "block").sortWithinPartitions("file", "block", "_n").drop("_n")
    known = known.select("file", "block", "inside", "crlf", "line")
    whole = known.mapInArrow(cut_records(False), _ddl(OUT))
    parts = known.mapInArrow(cut_records(True), _ddl(OUT))
    order = Window.partitionBy("file").orderBy("block", F.col("part") == 1).rowsBetween(Window.unboundedPreceding, 0)
    owned = parts.withColumn("_owner", F.last(F.when(F.col("part") == 1, F.col("block")), ignorenulls=True).over(order))
    texts = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda t: t["record"]))
    plain = F.regexp_replace(F.replace(F.col("raw"), F.lit("\r\n"), F.lit("\n")), "\r\\z", "")
    joined = owned.groupBy("file", "_owner", "crlf").agg(F.max(F.col("first") & (F.col("part") == 1)).alias("first"), texts.alias("raw")) \
        .select("file", F.col("_owner").alias("block"), "first", F.when(F.col("crlf"), plain).otherwise(F.col("raw")).alias("record"))
    return whole.select("file", "block", "first", "record").unionByName(joined)


def read_split_csv(spark: SparkSession, path: str, schema, options: dict, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Files with a header line as a table of ``schema`` (columns by position); ``options`` are those of the CSV parser."""
    records = read_records(spark, path, broadcast_blocks).where(~F.col("first"))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return records.select(F.from_csv("record", ddl, options).alias("_r")).select("_r.*")
