"""Reading and writing records: JSON of both shapes, ledgers, CSV matrices and manifests of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quorate.functions.scalars import scrub
from quorate.operators.validators import strict_json

ATTEMPT = "job_id string, attempt_number int, event_type string, status string, started_at timestamp, finished_at timestamp, duration_ms long, request_sha256 string, usage struct<input_tokens: long, output_tokens: long>"


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool | None = None) -> DataFrame:
    """One document or array per file, or one record per line; lines is told by the name if it is not given."""
    if lines is None:
        lines = path.rstrip("/").endswith((".jsonl", ".ndjson"))
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_ledger(spark: SparkSession, path: str, schema: StructType | str = ATTEMPT) -> DataFrame:
    """Attempts, one JSON record per line; the order of attempts is in the records, not in the file."""
    return spark.read.schema(schema).json(path)


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, text) per line: value is null where a line is not strict JSON."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return lines.withColumn("value", strict_json(F.col("text")))


def decode_events(spark: SparkSession, path: str, forbidden: Sequence[str]) -> DataFrame:
    """Per file how many lines there are, how many are no JSON, and whether an event of a forbidden type occurs."""
    v = read_strict(spark, path)
    kind = F.try_variant_get("value", "$.type", "string")
    return v.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("value").isNull()).alias("broken"), F.coalesce(F.bool_or(kind.isin(*forbidden)), F.lit(False)).alias("forbidden"))


def read_matrix(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A wide CSV of cases as long rows (keys, method, metric, value); other columns are named method.metric."""
    wide = spark.read.option("header", True).csv(path)
    rest = [c for c in wide.columns if c not in keys]
    long = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in rest])).alias("x"))
    return long.select(*keys, F.substring_index("x.name", ".", 1).alias("method"), F.substring_index("x.name", ".", -1).alias("metric"), F.col("x.value").alias("value"))


def write_matrix(scored: DataFrame, path: str, keys: Sequence[str], metrics: Sequence[str]) -> None:
    """The wide CSV that read_matrix reads: a column per method and metric."""
    methods = sorted(r[0] for r in scored.select("method").distinct().collect())  # the methods' number
    long = scored.select(*keys, "method", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x"))
    wide = long.select(*keys, F.concat_ws(".", "method", "x.metric").alias("name"), "x.value").groupBy(*keys).pivot("name", [f"{a}.{m}" for a in methods for m in metrics]).agg(F.max("value"))
    wide.write.mode("overwrite").option("header", True).csv(path)


def append(records: DataFrame, path: str) -> None:
    """Adds records to a ledger; its checks are the ledger operators' problems()."""
    records.write.mode("append").json(path)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, bytes) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def normalise(documents: DataFrame, container: str, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Rows of a variant column's container array; each field is the first alias that is present, even if its value is null."""
    items = documents.withColumn("item", F.explode(F.try_variant_get("value", f"$.{container}", "array<variant>")))
    keys = F.map_keys(F.try_variant_get("item", "$", "map<string, variant>"))

    def field(names: Sequence[str]):
        out = F.lit(None).cast("string")
        for n in reversed(names):
            out = F.when(F.array_contains("__keys", n), F.try_variant_get("item", f"$.{n}", "string")).otherwise(out)
        return out

    return items.withColumn("__keys", keys).select(*[field(names).alias(n) for n, names in aliases.items()])


def scrubbed(events: DataFrame, keep: Sequence[str] = ("text", "message", "content")) -> DataFrame:
    """String columns without personal data, but for those that are to be kept as they are."""
    return events.select(*[scrub(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" and f.name not in keep else F.col(f.name) for f in events.schema.fields])
