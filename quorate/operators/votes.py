"""Deterministic plurality votes: one answer per group, with tie-breaks that no run can change.

Every vote groups records by case and answer, then takes the best tally by a sort key. Both steps are partial aggregates, so
nothing is sorted and no group is collected: what is shuffled twice is tallies, where dealing out the records by case once would
put all of a large case's records in one task. Records with a null answer do not vote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(records: DataFrame, by: Sequence[str], measures: dict[str, Column], answer: str = "answer") -> DataFrame:
    """One row per group and answer with `votes` and further measures."""
    cast = records.where(F.col(answer).isNotNull())
    return cast.groupBy(*by, answer).agg(F.count("*").alias("votes"), *[m.alias(n) for n, m in measures.items()])


def elect(tallies: DataFrame, by: Sequence[str], key: Sequence[Column], answer: str = "answer") -> DataFrame:
    """The tally with the smallest key of each group; the last part of a key should tell answers apart."""
    rest = [c for c in tallies.columns if c not in by]
    best = tallies.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)])).alias("best"), F.sum("votes").alias("votes_cast"), F.count("*").alias("unique_answers"))
    return best.select(*by, *[F.col(f"best.{c}").alias(c) for c in rest], "votes_cast", "unique_answers")


def mean(total: Column, n: Column) -> Column:
    """A mean from an exact sum, so that the order of rows cannot change it."""
    return total.cast("double") / n


def numeric(answer: Column) -> Column:
    """An answer's terms as numbers, for ties that are broken by value."""
    return F.transform(answer, lambda x: x.cast("decimal(38,0)"))


def natural(answer: Column) -> Column:
    """A key that sorts terms by text, but runs of digits by value."""
    return F.transform(answer, lambda x: F.concat(F.lpad(F.length(F.regexp_extract(x, r"^([0-9]+)\z", 1)).cast("string"), 3, "0"), x))


def by_total_confidence(records: DataFrame, by: Sequence[str] = ("case_id",), slot: str = "slot") -> DataFrame:
    """Most votes, then largest sum of confidences, then answer in natural order; confidence is the winners' mean.

    lead_slot is the slot of the winner's most confident voter, the smaller slot of equal ones.
    """
    by = list(by)
    t = tally(records, by, {"conf_sum": F.sum("confidence"), "lead_slot": F.min_by(slot, F.struct(-F.col("confidence"), F.col(slot)))})
    out = elect(t, by, [-F.col("votes"), -F.col("conf_sum"), natural(F.col("answer"))])
    return out.withColumn("confidence", mean(F.col("conf_sum"), F.col("votes")))


def by_total_and_median(records: DataFrame, by: Sequence[str] = ("case_id",), exact: bool = False) -> DataFrame:
    """Most votes, largest sum, largest median of confidences, then answer by value; exact keeps the median decimal."""
    by = list(by)
    middle = F.percentile("confidence", F.lit(0.5))
    if exact:
        kept = F.sort_array(F.collect_list("confidence"))  # a case's voters, whose number is the panel's
        n = F.size(kept)
        middle = ((F.element_at(kept, ((n + 1) / 2).cast("int")) + F.element_at(kept, ((n + 2) / 2).cast("int"))) / 2).cast("decimal(12,6)")
    t = tally(records, by, {"conf_sum": F.sum("confidence"), "conf_median": middle})
    return elect(t, by, [-F.col("votes"), -F.col("conf_sum"), -F.col("conf_median"), numeric(F.col("answer"))])


def by_mean_confidence(records: DataFrame, by: Sequence[str] = ("case_id",), answer: str = "answer") -> DataFrame:
    """Most votes, largest mean confidence, then answer by text."""
    by = list(by)
    t = tally(records, by, {"conf_sum": F.sum("confidence")}, answer).withColumn("conf_mean", mean(F.col("conf_sum"), F.col("votes"))).drop("conf_sum")
    return elect(t, by, [-F.col("votes"), -F.col("conf_mean"), F.col(answer)], answer)


def by_weight(records: DataFrame, weight: Column, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Largest sum of weights, most votes, largest mean confidence clamped to 0..1, then answer by text."""
    by = list(by)
    clamped = F.least(F.greatest(F.col("confidence"), F.lit(0).cast("decimal(12,4)")), F.lit(1).cast("decimal(12,4)"))
    t = tally(records, by, {"weight": F.sum(weight), "conf_sum": F.sum(clamped)}).withColumn("conf_mean", mean(F.col("conf_sum"), F.col("votes"))).drop("conf_sum")
    return elect(t, by, [-F.col("weight"), -F.col("votes"), -F.col("conf_mean"), F.col("answer")])


def role_weight(weights: dict[str, int], role: str = "role") -> Column:
    """A role's weight, 1 for roles that are not listed."""
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(role)), F.lit(1)).cast("long")


def by_depth(records: DataFrame, by: Sequence[str] = ("case_id",), depth: str = "holdout_terms", stage: str = "stage") -> DataFrame:
    """Largest sum of verified depths, deepest, most distinct depths, most distinct stages, most votes, then answer; confidence plays no part."""
    by = list(by)
    t = tally(records, by, {"depth_sum": F.sum(depth), "depth_max": F.max(depth), "depths": F.count_distinct(F.col(depth)), "stages": F.count_distinct(F.col(stage))})
    return elect(t, by, [-F.col("depth_sum"), -F.col("depth_max"), -F.col("depths"), -F.col("stages"), -F.col("votes"), F.col("answer")])


def by_support(records: DataFrame, support: str, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Most distinct supporters, largest mean confidence, then answer by text."""
    by = list(by)
    t = tally(records, by, {"support": F.count_distinct(F.col(support)), "conf_sum": F.sum("confidence")}).withColumn("conf_mean", mean(F.col("conf_sum"), F.col("votes"))).drop("conf_sum")
    return elect(t, by, [-F.col("support"), -F.col("conf_mean"), F.col("answer")])


def fixed_slots(records: DataFrame, slots: int, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """The vote by mean confidence of slots 1 to `slots`; null where they are not all there exactly once."""
    by = list(by)
    own = records.where(F.col("slot").between(1, slots))
    complete = own.groupBy(*by).agg(((F.count("*") == slots) & (F.count_distinct("slot") == slots)).alias("complete"))
    won = by_mean_confidence(own, by).select(*by, "answer", "votes")
    return complete.join(won, by, "left").select(*by, "complete", F.when(F.col("complete"), F.col("answer")).alias("answer"), F.when(F.col("complete"), F.col("votes")).alias("votes"))


def expected(scored: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """What one answer drawn from a case's slots is expected to score: means of exactness, term accuracy and format."""
    return scored.groupBy(*by).agg(*[(F.sum(F.col(c).cast("long")) / F.count("*")).alias(f"{c}_mean") for c in ("exact", "format_valid")], (F.sum("terms") / (F.count("*") * 2)).alias("term_accuracy"))
