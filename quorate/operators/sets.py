"""Set operations: overlaps, checked unions, merges of retries, differences and balance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key how many distinct values both sides have, and how many rows repeat a value on each side."""
    long = lambda df, side: df.select(F.lit(side).alias("side"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys])).alias("x")).select("side", "x.*")
    each = long(left, "l").union(long(right, "r")).where("v is not null").groupBy("key", "v").agg(F.count_if(F.col("side") == "l").alias("l"), F.count_if(F.col("side") == "r").alias("r"))
    more = lambda c: F.sum(F.greatest(F.col(c) - 1, F.lit(0)))
    out = each.groupBy("key").agg(F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("shared"), more("l").alias("left_repeats"), more("r").alias("right_repeats"))
    return out.withColumn("passed", (F.col("shared") == 0) & (F.col("left_repeats") == 0) & (F.col("right_repeats") == 0))


def checked_union(frames: Sequence[DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(union by name, keys that occur more than once)."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union, union.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_valid(waves: Sequence[DataFrame], key: str, valid: str) -> DataFrame:
    """Per key the first wave's valid record, else the first wave's record."""
    union = reduce(lambda a, b: a.unionByName(b), [w.withColumn("wave", F.lit(i)) for i, w in enumerate(waves)])
    rest = [c for c in union.columns if c != key]
    best = union.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((~F.coalesce(F.col(valid), F.lit(False))).cast("int"), F.col("wave"))).alias("x"))
    return best.select(key, "x.*")


def difference(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, kind) of ids that are missing or extra."""
    missing = expected.select(key).distinct().join(found, key, "left_anti").withColumn("kind", F.lit("missing"))
    return missing.union(found.select(key).distinct().join(expected, key, "left_anti").withColumn("kind", F.lit("extra")))


def balance(rows: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Rows per cell, and whether all cells have as many."""
    n = rows.groupBy(*cells).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row per cell
    return n.withColumn("even", F.min("n").over(w) == F.max("n").over(w))


def panels(rows: DataFrame, cells: Sequence[str], id: str, per_cell: int) -> DataFrame:
    """The first per_cell rows of each cell by a hash of the id; the hash's parity tells the panel."""
    digest = F.sha2(F.col(id).cast("string").cast("binary"), 256)
    placed = rows.withColumn("r", F.row_number().over(Window.partitionBy(*cells).orderBy(digest, id)))
    parity = F.conv(F.substring(digest, 64, 1), 16, 10).cast("int") % 2
    return placed.where(F.col("r") <= per_cell).withColumn("panel", F.when(parity == 0, "even").otherwise("odd")).drop("r")
