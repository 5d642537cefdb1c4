"""Catalog readers and writers (SRC-1..7, SNK-1..5, SCH-1..3, SCH-5..7, JSN-1/2, DAT-2).

Readers never infer a schema: CSV columns are read as text (the header names
them) and cast explicitly after alias normalisation; JSON readers take a
declared schema.  Writers are plain DataFrame writers to shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split_csv import read_split_csv

# Canonical column name -> accepted aliases
ALIASES = {
    "sample_id": ["sample_id", "unique_identifier"],
    "catalog_content": ["catalog_content", "Description"],
    "image_link": ["image_link", "image_path"],
    "price": ["price", "Price"],
}
TRAIN_REQUIRED = ["sample_id", "catalog_content", "image_link", "price"]
TEST_REQUIRED = ["sample_id", "catalog_content", "image_link"]
CANONICAL_TYPES = {"sample_id": "long", "catalog_content": "string", "image_link": "string", "price": "double"}

LATENCY_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("rows", T.IntegerType()),
    T.StructField("total_seconds", T.DoubleType()), T.StructField("predict_seconds", T.DoubleType()),
    T.StructField("seconds_per_row", T.DoubleType()), T.StructField("output_path", T.StringType()),
    T.StructField("ts_utc", T.TimestampType()),
])
RECORD_SCHEMA = "array<struct<sample_id:long,catalog_content:string,image_link:string>>"
MAX_PREDICT_RECORDS = 200


# ----------------------------------------------------------------- SCH-1/2/3
#: name -> (canonical name, preference: the canonical spelling first)
ALIAS_INDEX = {name: (canonical, rank) for canonical, names in ALIASES.items() for rank, name in enumerate(names)}


def present_names(columns: list[str]) -> dict[str, str]:
    """canonical name -> the most preferred spelling of it among ``columns``.  Exact, case-sensitive matching
    (Spark itself would not tell ``price`` from ``Price``)."""
    known = sorted((ALIAS_INDEX[c][1], c) for c in columns if c in ALIAS_INDEX)
    return {ALIAS_INDEX[c][0]: c for _, c in reversed(known)}


def normalize_to_train_schema(df: DataFrame) -> tuple[DataFrame, dict]:
    """SCH-1: columns known under another spelling take their canonical name, unless that is there too."""
    renames = {have: name for name, have in present_names(df.columns).items() if have != name}
    return df.withColumnsRenamed(renames), renames


def resolve_column_name(columns: list[str], requested: str) -> str:
    """SCH-2: the requested name if present, else another spelling of it, else a derived column (a spelling plus
    the same suffix, ``Description_clean_len``), else the request itself."""
    if requested in columns:
        return requested
    heads = [n for n in ALIAS_INDEX if requested == n or requested.startswith(n + "_")]
    for head in sorted(heads, key=len, reverse=True):
        suffix = requested[len(head):]
        for other in ALIASES[ALIAS_INDEX[head][0]]:
            if other + suffix in columns:
                return other + suffix
    return requested


def missing_required_columns(columns: list[str], required: list[str]) -> list[str]:
    """SCH-3: required columns that are present under no spelling."""
    return [c for c in required if c not in columns and c not in present_names(columns)]


# ------------------------------------------------------------------- SRC-1..4
CSV_OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"'}


def read_catalog_csv_whole(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line quoted CSV by Spark's own reader, every column read as text (no inference): one task a file."""
    return spark.read.options(header="true", inferSchema="false", **CSV_OPTIONS).csv(path)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same rows, read by as many tasks as the files have blocks.  The column names come from the first record."""
    return read_split_csv(spark, path, read_catalog_csv_whole(spark, path).schema, CSV_OPTIONS)


def load_catalog(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """SRC-1: read, normalise aliases, check required columns, cast types."""
    df, _ = normalize_to_train_schema(read_catalog_csv(spark, path))
    missing = missing_required_columns(df.columns, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[F.col(c).try_cast(CANONICAL_TYPES.get(c, "string")).alias(c) if c in CANONICAL_TYPES
                       else F.col(c) for c in df.columns])


def load_train_df(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2 (train contract: price required)."""
    return load_catalog(spark, path, TRAIN_REQUIRED)


def load_test_df(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2 (test contract: no price)."""
    return load_catalog(spark, path, TEST_REQUIRED)


def prepare_training_data(df: DataFrame) -> DataFrame:
    """SRC-3: the four columns; text and image null -> "", price as double."""
    return df.select(F.col("sample_id").try_cast("long").alias("sample_id"),
                     F.coalesce(F.col("catalog_content").cast("string"), F.lit("")).alias("catalog_content"),
                     F.coalesce(F.col("image_link").cast("string"), F.lit("")).alias("image_link"),
                     F.col("price").cast("string").try_cast("double").alias("price"))


def write_csv(df: DataFrame, path: str) -> None:
    """SRC-4 / SNK-1 / SNK-5: header CSV, quoted multi-line text."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str) -> None:
    """SRC-4: the columnar copy that later jobs read."""
    df.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------------- SRC-5
def load_latency_events(spark: SparkSession, path: str) -> DataFrame:
    """JSONL with a declared schema; a missing path gives an empty table with
    the same columns; blank lines are skipped by the reader."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return spark.createDataFrame([], LATENCY_SCHEMA)
    return spark.read.schema(LATENCY_SCHEMA).json(path)


# ---------------------------------------------------------------------- SRC-6
def payload_status(payload: DataFrame, col: str = "body", max_records: int = MAX_PREDICT_RECORDS) -> DataFrame:
    """Every request payload with its parsed ``records`` and ``status``: ``accepted``,
    ``too_many_records:<n>><limit>`` (as a whole, like the service's 413 answer) or ``malformed``."""
    text = F.get_json_object(F.col(col), "$.records")
    n = F.coalesce(F.json_array_length(text), F.lit(-1))
    return (payload.withColumn("n_records", n)
            .withColumn("status", F.when(n < 0, "malformed").when(n > max_records, F.concat(
                F.lit("too_many_records:"), n.cast("string"), F.lit(f">{max_records}"))).otherwise("accepted"))
            .withColumn("records", F.when(n.between(0, max_records), F.from_json(text, RECORD_SCHEMA))))


def records_to_table(payload: DataFrame, col: str = "body", max_records: int = MAX_PREDICT_RECORDS) -> DataFrame:
    """One row per record of the accepted payloads; ``payload_status`` says what became of the others."""
    ok = payload_status(payload, col, max_records).where("status = 'accepted'")
    return ok.select(*[c for c in payload.columns if c != col], F.inline("records"))


# ---------------------------------------------------------------------- SRC-7
def pending_downloads(links: DataFrame, fetched_names: DataFrame, link_col: str = "image_link") -> DataFrame:
    """Image files still to fetch: URL basenames without a fetched file of the same name."""
    wanted = links.where(F.col(link_col).isNotNull() & (F.col(link_col) != "")) \
                  .select(F.element_at(F.split(F.col(link_col), "/"), -1).alias("file_name"),
                          F.col(link_col).alias("url")).dropDuplicates(["file_name"])
    return wanted.join(fetched_names.select("file_name"), "file_name", "left_anti")


# ----------------------------------------------------------------- SNK-2 / SNK-3
def append_jsonl(df: DataFrame, path: str) -> None:
    """SNK-2: append records with a ``ts_utc`` column."""
    df.withColumn("ts_utc", F.current_timestamp()).write.mode("append").json(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """SNK-3: nested report rows as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


# ------------------------------------------------------------------- JSN / DAT
def json_field(c: Column, *paths: str) -> Column:
    """JSN-1: the first non-null of several JSON paths."""
    return F.coalesce(*[F.get_json_object(c, p) for p in paths])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """JSN-2: nested struct fields -> dotted top-level columns; arrays of
    scalars joined by ','."""
    out = []

    def walk(prefix: str, dtype, col: Column):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f"{prefix}{sep}{f.name}" if prefix else f.name, f.dataType, col[f.name])
        elif isinstance(dtype, T.ArrayType) and not isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
            out.append(F.array_join(col.cast("array<string>"), ",").alias(prefix))
        else:
            out.append(col.alias(prefix))

    for f in df.schema.fields:
        walk(f.name, f.dataType, F.col(f"`{f.name}`"))
    return df.select(*out)


def run_id_from_ts(prefix: str, ts: Column) -> Column:
    """DAT-2: ``prefix_YYYYMMDDTHHMMSSZ`` from a UTC timestamp."""
    return F.concat(F.lit(prefix + "_"), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))
