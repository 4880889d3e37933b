"""Audits: named checks and violation rows, empty when all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_manifests(frozen: DataFrame, found: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, status): same, changed, missing or extra; malformed for digests that are not 64 hex digits, escape for paths that leave the folder."""
    a, b = frozen.select(key, F.col(digest).alias("a")), found.select(F.col(key).alias("k"), F.col(digest).alias("b"))
    both = a.join(b, F.col(key) == F.col("k"), "full_outer").withColumn("path", F.coalesce(key, "k"))
    status = F.when(F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))"), "escape").when(F.col("a").isNull(), "extra").when(~F.col("a").rlike(r"^[0-9a-f]{64}\z"), "malformed").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def recompute(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; repeated rows count."""
    return published.exceptAll(recomputed).withColumn("side", F.lit("published")).union(recomputed.exceptAll(published).withColumn("side", F.lit("recomputed")))


def chain_breaks(rounds: DataFrame, number: str = "round") -> DataFrame:
    """Rounds whose parent digest is not the digest of the round before; one row per round."""
    w = Window.orderBy(number)
    before = rounds.withColumn("expected", F.lag("digest").over(w))
    return before.where(~F.col("parent").eqNullSafe(F.col("expected"))).select(number, "parent", "expected")


def history_breaks(rounds: DataFrame, number: str = "round") -> DataFrame:
    """Rounds whose set of members is not the earlier set and the new children."""
    w = Window.orderBy(number)
    x = rounds.withColumn("before", F.coalesce(F.lag("members").over(w), F.expr("filter(members, x -> false)")))
    return x.where(F.array_sort(F.array_union("before", "children")) != F.array_sort("members")).select(number)


def cumulative(stages: DataFrame, final: DataFrame, stage: str, key: str) -> DataFrame:
    """(stage, key) of rows that are in the final manifest's first stages but not in the stage's own, or the other way round.

    `stages` holds manifests as they were after each stage: (as_of, stage, key).
    """
    want = stages.select("as_of").distinct().join(final.select(F.col(stage).alias("s"), F.col(key).alias("k")), F.col("s") <= F.col("as_of")).select("as_of", "k")
    have = stages.select("as_of", F.col(key).alias("k"))
    return want.exceptAll(have).withColumn("side", F.lit("final")).union(have.exceptAll(want).withColumn("side", F.lit("stage")))


def role_counts(jobs: DataFrame, by: Sequence[str], roles: dict[str, int]) -> DataFrame:
    """Groups whose jobs do not have exactly these roles."""
    counts = [F.count_if(F.col("role") == r).alias(r) for r in roles]
    wrong = F.col("jobs") != sum(roles.values())
    for r, n in roles.items():
        wrong |= F.col(r) != n
    return jobs.groupBy(*by).agg(F.count("*").alias("jobs"), *counts).where(wrong)


def reconcile(ledger: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, problem): results without a valid attempt, valid attempts without a result, digests that differ."""
    a = ledger.groupBy(key).agg(F.count_if(F.col("status") == "valid_output").alias("valid"), F.max("digest").alias("ledger_digest"))
    b = results.select(F.col(key).alias("k"), F.col("digest").alias("result_digest"))
    both = a.join(b, F.col(key) == F.col("k"), "full_outer").withColumn(key, F.coalesce(key, "k"))
    none = F.coalesce(F.col("valid"), F.lit(0)) == 0
    checks = F.array_compact(F.array(F.when(F.col("k").isNotNull() & none, "result_without_attempt"), F.when(F.col("k").isNull() & ~none, "attempt_without_result"), F.when(F.col("k").isNotNull() & ~none & (F.col("ledger_digest") != F.col("result_digest")), "digest_differs")))
    return both.select(key, checks.alias("c")).select(key, F.explode("c").alias("problem"))


def completeness(predictions: DataFrame, job: str, case: str, size: int) -> DataFrame:
    """Jobs that do not have `size` rows with as many different cases."""
    n = predictions.groupBy(job).agg(F.count("*").alias("n_rows"), F.count_distinct(case).alias("cases"))
    return n.where((F.col("n_rows") != size) | (F.col("cases") != size))


def file_class(path: Column) -> Column:
    """Why a file is left out of a release, or `kept`."""
    return F.when(path.rlike(r"(^|/)__pycache__/|\.pyc$"), "cache").when(path.rlike(r"(^|/)\."), "hidden").when(path.rlike(r"\.(tmp|lock)$"), "temporary").otherwise("kept")


def named_checks(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, violations, passed) from violation frames."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("violations"))
        out = one if out is None else out.union(one)
    return out.withColumn("passed", F.col("violations") == 0)
