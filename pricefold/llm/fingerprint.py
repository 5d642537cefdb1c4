"""Operator 5, document fingerprints by order MinHash, in DataFrame functions only.

1. A text's tokens are runs of up to ``PIECE`` marks that are no white space; a k-mer is two neighbouring tokens (the last
   one stands alone), so even a text of one token has one.
2. Repeated k-mers are numbered by occurrence; the hash of (k-mer, number) ranks the k-mers and deals them to ``BINS``
   bins (one hash pass instead of one per bin).
3. Each bin keeps its two smallest k-mers *in text order* and hashes them as a tuple: swapping passages changes the
   tuples although the k-mers stay, which plain MinHash cannot see.
4. The fingerprint is the list of (bin, tuple hash), six hex digits each.  Two fingerprints' likeness is the share of
   equal entries among the bins that either uses, an estimate that follows the edit distance.

All arrays are per document and linear in its length (three primitive sorts); nothing is exploded.  The next document by
id comes from a window inside blocks of neighbouring ids; block edges are quantiles, and the first document of a block
is copied into the block before it (at most ``MAX_BLOCKS`` rows).

Defined results: null and empty texts and texts of white space have the empty fingerprint, and two empty ones are
alike (1.0); equal texts have equal fingerprints; rows that repeat an id follow each other in order of their text; a
null id is the smallest id; a table of one document has itself as the next; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .registry import query

PIECE, BINS = 8, 64                 # marks of a token at most; a power of two
POS_BITS, BIN_BITS = 24, 6          # a text may have 2**24 tokens
MAX_BLOCKS, BLOCK_ROWS = 4096, 5000


def _same_run(s: Column, shift: int):
    return lambda x, i: (i == 0) | (F.shiftrightunsigned(F.get(s, i - 1), shift) != F.shiftrightunsigned(x, shift))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of (bin << 16 | tuple hash), one entry per used bin, in bin order."""
    t = f"_{out}"
    low = (1 << POS_BITS) - 1
    df = df.withColumn(t, F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"\S{{1,{PIECE}}}"), F.lit(0)), lambda x: F.xxhash64(x)))
    # k-mer hash above, place below: one long per k-mer
    df = df.withColumn(t, F.transform(t, lambda x, i: F.xxhash64(x, F.get(F.col(t), i + 1)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    df = df.withColumn(t, F.sort_array(t))
    # occurrence numbers: count inside runs of equal k-mers
    s = F.col(t)
    df = df.withColumn(f"{t}_runs", F.filter(F.transform(s, lambda x, i: F.when(_same_run(s, POS_BITS)(x, i), i)), lambda x: x.isNotNull()))
    runs = F.col(f"{t}_runs")

    def number(first, r):
        after = F.coalesce(F.get(runs, r + 1), F.size(s))
        def one(i):
            x = F.get(s, i)
            h = F.xxhash64(F.shiftrightunsigned(x, POS_BITS), i - first)
            # bin, rank and place in one positive long
            return F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(~low)).bitwiseOR(x.bitwiseAND(F.lit(low)))
        return F.transform(F.sequence(first, after - 1), one)

    df = df.withColumn(t, F.sort_array(F.flatten(F.transform(runs, number)))).drop(f"{t}_runs")
    top = 63 - BIN_BITS
    u = F.col(t)
    bin_of = lambda x: F.shiftrightunsigned(x, top)                                          # noqa: E731
    # the two smallest of each bin
    df = df.withColumn(t, F.filter(u, lambda x, i: (i < 2) | (bin_of(F.get(u, i - 2)) != bin_of(x))))
    two = F.col(t)

    def entry(x, i):
        y = F.get(two, i + 1)
        y = F.when(bin_of(y) == bin_of(x), y)
        swap = x.bitwiseAND(F.lit(low)) > y.bitwiseAND(F.lit(low))
        hx, hy = F.shiftrightunsigned(x, POS_BITS), F.shiftrightunsigned(y, POS_BITS)
        tuple_hash = F.when(F.coalesce(swap, F.lit(False)), F.xxhash64(hy, hx)).otherwise(F.xxhash64(hx, hy))
        first = (i == 0) | (bin_of(F.get(two, i - 1)) != bin_of(x))
        return F.when(first, F.shiftleft(bin_of(x), 16).bitwiseOR(tuple_hash.bitwiseAND(F.lit(0xFFFF))))

    return df.withColumn(out, F.filter(F.transform(two, entry), lambda x: x.isNotNull())).drop(t)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda fp: F.transform(fp, lambda x: F.shiftrightunsigned(x, 16))                  # noqa: E731
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _sub, _text, fp)``."""
    return with_fingerprint(C.keyed(docs, id_col, text_col), "_text", "fp")


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _sub, _text, fp, next__text, next_fp)``: the next row by (_id, _sub), the first one after the last."""
    rows = C.keyed(docs, id_col, text_col)
    n = rows.agg(F.count(F.lit(1))).first()[0]
    blocks = int(min(MAX_BLOCKS, max(1, -(-n // BLOCK_ROWS))))
    cuts = sorted({int(x) for x in rows.approxQuantile("_id", [i / blocks for i in range(1, blocks)], 0.25 / blocks)}) if blocks > 1 else []
    steps = max(1, len(cuts).bit_length())
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # binary search by halving steps: the number of cuts that are not above the id
    block = F.lit(0)
    for k in reversed(range(steps)):
        reach = block + (1 << k)
        block = F.when((reach <= len(cuts)) & (F.get(edges, reach - 1) <= F.col("_id")), reach).otherwise(block)
        rows = rows.withColumn("_block", block)
        block = F.col("_block")
    heads = rows.groupBy("_block").agg(F.min(F.struct("_id", "_sub")).alias("k")).select("_block", "k.*").collect()   # <= MAX_BLOCKS rows
    heads = sorted((r._block, r._id, r._sub) for r in heads)
    moved = [(heads[i][1], heads[i][2], heads[i - 1][0], int(i == 0)) for i in range(len(heads))]
    spark = rows.sparkSession
    to = F.broadcast(spark.createDataFrame(moved, "_id long, _sub int, _to int, _wrap int"))
    own = ["_id", "_sub", "_text"]
    copies = rows.join(to, ["_id", "_sub"]).select(*own, F.col("_to").alias("_block"), "_wrap", F.lit(True).alias("_copy"))
    every = rows.select(*own, "_block", F.lit(0).alias("_wrap"), F.lit(False).alias("_copy")).unionByName(copies)
    every = with_fingerprint(every, "_text", "fp")
    line = Window.partitionBy("_block").orderBy("_wrap", "_id", "_sub")
    after = F.lead(F.struct("_text", "fp")).over(line)
    return every.withColumn("_after", after).where("NOT _copy").select(
        *own, "fp", F.col("_after._text").alias("next__text"), F.col("_after.fp").alias("next_fp"))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (the last quarter replaced by the head of the next document), and
    their likeness."""
    rows = fingerprints_with_next(docs, id_col, text_col)
    n = F.char_length("_text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_cut", F.floor(n / 4).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(_text, 1, int(n_chars) - _cut)"), F.expr("substring(next__text, 1, _cut)")))
    rows = with_fingerprint(rows.drop("_text", "next__text"), "edited", "edited_fp")
    return rows.withColumn("near_edited", likeness(F.col("fp"), F.col("edited_fp"))) \
               .withColumn("near_next", likeness(F.col("fp"), F.col("next_fp")))


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark, sf_dir):
    out = with_edited(C.table(spark, sf_dir, "documents"))
    return out.select(C.public_id(), "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
                      as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
                      "near_edited", "near_next")
