"""Ranking, routing and ordering: explicit keys, so that equal rows never swap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions import draws


def contiguity(attempts: DataFrame, key: str, number: str, order: Sequence[str]) -> DataFrame:
    """Rows whose attempt number is not their place in order."""
    placed = attempts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed.where(F.col(number) != F.col("place"))


def best_of(entries: DataFrame, by: Sequence[str], key: Sequence[Column], id: str, hash_tie: str) -> DataFrame:
    """The entry with the smallest key of each group; equal keys go to the smallest or largest SHA-256 of the id."""
    digest = F.sha2(F.col(id).cast("string").cast("binary"), 256)
    pick = {"min": F.min_by, "max": F.max_by}[hash_tie]
    low = entries.groupBy(*by).agg(F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])).alias("low"))
    tied = entries.join(low, list(by)).where(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]) == F.col("low"))
    return tied.groupBy(*by).agg(pick(id, digest).alias(id))


def peak(intervals: DataFrame, start: str, end: str, by: Sequence[str] = (), bucket: str = "1 day") -> DataFrame:
    """The most intervals [start, end) that hold at once; an end at the time of a start comes first.

    Times are cut into buckets: a bucket's count at its start is the sum of all changes before it, and only a bucket's own
    changes are sorted together, so that no task sorts them all.
    """
    ends = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("delta")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("delta")))).alias("x")
    marks = intervals.where(F.col(start) < F.col(end)).select(*by, ends).select(*by, "x.*").withColumn("bucket", F.window(F.col("t").cast("timestamp"), bucket)["start"])
    carried = marks.groupBy(*by, "bucket").agg(F.sum("delta").alias("net"))
    w = Window.partitionBy(*by, F.lit(1)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = carried.select(*by, "bucket", F.coalesce(F.sum("net").over(w), F.lit(0)).alias("held"))
    own = Window.partitionBy(*by, "bucket").orderBy("t", "delta").rowsBetween(Window.unboundedPreceding, 0)
    run = marks.join(before, [*by, "bucket"]).withColumn("n", F.col("held") + F.sum("delta").over(own))
    return run.groupBy(*by).agg(F.max("n").alias("peak"))


def panel_support(votes: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case the plurality's support, unique answers, mean confidence and number of votes."""
    t = votes.where(F.col("answer").isNotNull()).groupBy(case, "answer").agg(F.count("*").alias("c"), F.sum("confidence").alias("s"))
    return t.groupBy(case).agg(F.max("c").alias("support"), F.count("*").alias("unique_answers"), (F.sum("s").cast("double") / F.sum("c")).alias("mean_confidence"), F.sum("c").alias("votes"))


def top_two(votes: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case the two largest supports, 0 for a second that is not there."""
    t = votes.where(F.col("answer").isNotNull()).groupBy(case, "answer").agg(F.count("*").alias("c"))
    ranked = t.withColumn("r", F.row_number().over(Window.partitionBy(case).orderBy(F.desc("c"), "answer")))
    return ranked.groupBy(case).agg(F.coalesce(F.max(F.when(F.col("r") == 1, F.col("c"))), F.lit(0)).alias("first"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("c"))), F.lit(0)).alias("second"), F.count("*").alias("unique_answers"))


def in_scope(two: DataFrame, scope: str, margin: int = 1) -> Column:
    """Whether a case is targeted; a case without a valid answer always is."""
    none = F.coalesce(F.col("first"), F.lit(0)) == 0
    return none | {"all": F.lit(True), "disputed": F.col("unique_answers") > 1, "low_margin": F.col("first") - F.col("second") <= margin, "no_consensus": F.col("first") * 2 <= F.col("votes")}[scope]


def anonymous_order(rows: DataFrame, case: str, parts: Sequence[Column], prefix: str, cap: int | None = None) -> DataFrame:
    """Rows of a case in the order of a hash of their parts, named prefix01, prefix02 and so on; a cap keeps the first."""
    digest = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy(digest)))
    named = placed.withColumn("anonymous_id", F.concat(F.lit(prefix), F.lpad(F.col("place").cast("string"), 2, "0")))
    return named.where(F.col("place") <= cap) if cap else named


def race(entries: DataFrame, key: Sequence[Column], signature: str, keep: int) -> DataFrame:
    """The first of each signature by key, then the first `keep` of these."""
    own = F.row_number().over(Window.partitionBy(signature).orderBy(*key))
    return entries.withColumn("own", own).where("own = 1").drop("own").orderBy(*key).limit(keep)


def split_blocks(rows: DataFrame, block: str, order: Sequence[str], size: int) -> DataFrame:
    """Blocks of at most `size` rows from larger blocks, in order."""
    return rows.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(block).orderBy(*order)) - 1) / size).cast("int"))


def pick_and_pop(ids: list[str], seed: str) -> list[str]:
    """A seeded order of a short list: each step takes the place that a SHA-256 of seed and step names. For the driver."""
    import hashlib

    left, out = sorted(ids), []
    while left:
        at = int(hashlib.sha256(f"{seed}|{len(out)}".encode()).hexdigest(), 16) % len(left)
        out.append(left.pop(at))
    return out


def digest_modulo(digest: Column, n: Column) -> Column:
    """The whole number that 64 hex digits write, modulo n below 2 to the power 31: eight digits at a time."""

    def rest(hex_: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(8):
            out = (out * F.lit(1 << 32) + F.conv(F.substring(hex_, 8 * i + 1, 8), 16, 10).cast("long")) % n
        return out

    return draws.let(digest, rest)


def popped(ids: Column, seed: Column) -> Column:
    """pick_and_pop() of a column of lists, in order of their values; a row's list is short, as each step copies what is left."""
    none = F.filter(ids, lambda x: F.lit(False))
    start = F.struct(F.array_sort(ids).alias("left"), none.alias("out"))

    def step(s: Column, k: Column) -> Column:
        at = digest_modulo(F.sha2(F.concat_ws("|", seed, k).cast("binary"), 256), F.size(s["left"]).cast("long")).cast("int")
        return draws.let(at, lambda i: F.struct(F.filter(s["left"], lambda x, j: j != i).alias("left"), F.array_append(s["out"], F.get(s["left"], i)).alias("out")))

    return F.when(F.size(ids) > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(ids), F.lit(1)) - 1), start, step, lambda s: s["out"])).otherwise(ids)
