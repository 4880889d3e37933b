"""Scores of answers against truths, and what methods, blocks and calls come to.

Records stay long (case, method, measures); pivots are for output. A null answer is wrong, never dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_right(answer: Column, truth: Column) -> Column:
    """Whether an answer equals the truth; a null answer is not."""
    return F.coalesce(answer == truth, F.lit(False))


def right_terms(answer: Column, truth: Column) -> Column:
    """Per term of the truth 1 if the answer has it in its place, else 0."""
    return F.transform(truth, lambda t, i: F.when(F.get(answer, i) == t, 1).otherwise(0))


def score_records(records: DataFrame, truth: DataFrame, key: str = "case_id") -> DataFrame:
    """Records of cases that have a truth, with exact, per_term, terms and format_valid."""
    both = records.join(truth, key)
    per = right_terms(F.col("answer"), F.col("truth"))
    return both.withColumns({"exact": is_right(F.col("answer"), F.col("truth")), "per_term": per, "terms": F.aggregate(per, F.lit(0), lambda s, x: s + x), "format_valid": F.col("answer").isNotNull() & (F.size("answer") == F.size("truth"))})


def unknown_cases(records: DataFrame, truth: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that are answered but have no truth; scoring should stop if there are any."""
    return records.join(truth, key, "left_anti").select(key).distinct()


def grid(planned: DataFrame, records: DataFrame, key: str = "case_id") -> DataFrame:
    """Every planned case with its records; a case without one appears once, as invalid."""
    return planned.join(records, key, "left").withColumn("present", F.col("slot").isNotNull())


def calibration(scored: DataFrame) -> Column:
    """One minus the squared distance of confidence and outcome."""
    return 1 - F.pow(F.col("confidence").cast("double") - F.col("exact").cast("int"), F.lit(2.0))


def summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and means by group, from integer sums."""
    n = F.count("*")
    return scored.groupBy(*by).agg(n.alias("n"), F.count_if("exact").alias("exact"), (F.count_if("exact") / n).alias("exact_rate"), F.sum("terms").alias("terms"), F.count_if("format_valid").alias("format_valid"))


def breakdown(scored: DataFrame, method: str, levels: Sequence[str]) -> DataFrame:
    """Exact answers by method alone and by method with each level, in one pass: (method, level, value, n, exact)."""
    pairs = F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("value")), *[F.struct(F.lit(x).alias("level"), F.col(x).cast("string").alias("value")) for x in levels])
    long = scored.select(method, "exact", F.explode(pairs).alias("p"))
    return long.groupBy(method, F.col("p.level").alias("level"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"))


def leave_one_out(scored: DataFrame, block: str) -> DataFrame:
    """Per block the exact rate of all other blocks."""
    sums = scored.groupBy(block).agg(F.count("*").alias("n"), F.count_if("exact").alias("x"))
    every = Window.partitionBy(F.lit(1))  # one row per block
    return sums.select(block, ((F.sum("x").over(every) - F.col("x")) / (F.sum("n").over(every) - F.col("n"))).alias("exact_rate_without"))


def fitness(scored: DataFrame, by: str, block: str) -> DataFrame:
    """(exact, weakest block's exact, harmful, terms, format): what protocols are ranked by, and the scalar form of it."""
    blocks = scored.groupBy(by, block).agg(F.count_if("exact").alias("x"), F.count_if("harmful").alias("h"), F.sum("terms").alias("t"), F.count_if("format_valid").alias("f"), F.count("*").alias("n"))
    out = blocks.groupBy(by).agg(F.sum("x").alias("exact"), F.min("x").alias("weakest_block"), F.sum("h").alias("harmful"), F.sum("t").alias("terms"), F.sum("f").alias("format_valid"), F.sum("n").alias("n"))
    return out.withColumn("fitness", (6 * F.col("exact") + F.col("terms") - F.col("harmful")) / (11 * F.col("n")))


def dedupe_calls(records: DataFrame, call: str, values: Sequence[str]) -> DataFrame:
    """One row per call from records that repeat it, and whether the repeats disagree."""
    agree = [F.count_distinct(F.col(v)) for v in values]
    conflict = F.lit(False)
    for a in agree:
        conflict |= a > 1
    return records.groupBy(call).agg(*[F.max(v).alias(v) for v in values], F.count("*").alias("repeats"), conflict.alias("conflict"))


def critical_path(calls: DataFrame, by: str, batch: str, latency: str) -> DataFrame:
    """Summed cost, and the sum over batches of each batch's longest latency; null if a call with a latency has no batch."""
    batches = calls.groupBy(by, batch).agg(F.sum(latency).alias("s"), F.max(latency).alias("m"), F.count("*").alias("n"), F.count_if(F.col(batch).isNull() & F.col(latency).isNotNull()).alias("loose"))
    return batches.groupBy(by).agg(F.sum("n").alias("calls"), F.sum("s").alias("total"), F.when(F.sum("loose") == 0, F.sum("m")).alias("critical_path"), F.count("*").alias("batches"))


def per_correct(total: Column, exact: Column) -> Column:
    """Cost per exact answer; null without one."""
    return F.when(exact > 0, total / exact)


def token_proxy(usage: Column, text: Column) -> Column:
    """Reported tokens, or a quarter of the characters rounded up where none were reported."""
    return F.coalesce(usage, F.ceil(F.length(text) / 4)).cast("long")


def clusters(records: DataFrame, by: Sequence[str], member: str) -> DataFrame:
    """Per answer its support, mean confidence, most confident member and sorted members."""
    return records.groupBy(*by, "answer").agg(
        F.count("*").alias("support"), F.round(F.sum("confidence").cast("double") / F.count("*"), 6).alias("confidence"),
        F.min_by(member, F.struct(-F.col("confidence"), F.col(member))).alias("representative"), F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))


def archive(records: DataFrame, case: str, job: str, strategy: str, lens: str) -> DataFrame:
    """Per case and answer its distinct jobs, strategies and lenses, role counts and confidences.

    A job, strategy or lens counts where it comes first, so that records which are dealt out by the case, or some of the columns that
    tell cases apart, stay where they are; counts of distinct ones would deal each record out four times.
    """
    roles = [F.count_if(F.col("role") == r).alias(f"{r}_support") for r in ("proposer", "critic", "verifier", "judge")]
    own = {"job": job, "strategy": strategy, "lens": lens}
    first = {f"first_{n}": F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy(case, "answer", c).orderBy(F.lit(0))) == 1) for n, c in own.items()}
    return records.withColumns(first).groupBy(case, "answer").agg(
        *[F.count_if(f"first_{n}").alias(f"{n}_support") for n in own], *roles,
        (F.sum("confidence").cast("double") / F.count("*")).alias("mean_confidence"), F.max("confidence").cast("double").alias("max_confidence"), F.array_join(F.array_sort(F.collect_set(lens)), ",").alias("lenses"))


def shares(candidates: DataFrame, case: str, columns: Sequence[str]) -> DataFrame:
    """Each column as its share of the case's sum; 0 where the sum is 0."""
    w = Window.partitionBy(case)
    return candidates.select(case, "answer", *[F.when(F.sum(c).over(w) > 0, F.col(c) / F.sum(c).over(w)).otherwise(0.0).alias(f"{c}_share") for c in columns])


def diagnostics(scored: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Per case how many answers differ, how many are right, the plurality's support, and whether any is right."""
    tallies = scored.groupBy(*by, "answer").agg(F.count("*").alias("c"), F.count_if("exact").alias("x"))
    return tallies.groupBy(*by).agg(F.count("*").alias("unique_answers"), F.sum("x").alias("correct_support"), F.max("c").alias("plurality_support"), (F.sum("x") > 0).alias("reachable"))


def violations(summaries: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule) for each row that breaks a rule; null counts as broken."""
    checks = F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()])
    return summaries.select(key, F.explode(F.array_compact(checks)).alias("rule"))
