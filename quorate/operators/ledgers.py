"""Append-only attempt ledgers: states, checks, selections and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALID, SCHEMA, INFRA, PROTOCOL = "valid_output", "schema_invalid", "infrastructure_failure", "protocol_violation"
MOST_SCHEMA, MOST_INFRA, MOST_ATTEMPTS = 2, 3, 3


def state_of(valid: Column, protocol: Column, schema: Column, infra: Column) -> Column:
    """A job's state from how often each status has occurred; precedence, not time, decides."""
    return F.when(valid > 0, "closed:" + VALID).when(protocol > 0, "closed:" + PROTOCOL).when(schema >= MOST_SCHEMA, "closed:" + SCHEMA).when(infra >= MOST_INFRA, "closed:" + INFRA).otherwise("open")


def job_states(ledger: DataFrame) -> DataFrame:
    """Per job its attempts and state."""
    n = {s: F.count_if(F.col("status") == s) for s in (VALID, PROTOCOL, SCHEMA, INFRA)}
    return ledger.groupBy("job_id").agg(F.count("*").alias("attempts"), state_of(n[VALID], n[PROTOCOL], n[SCHEMA], n[INFRA]).alias("state"))


def lineage_states(ledger: DataFrame) -> DataFrame:
    """Per call: closed by its first attempt with substance, exhausted after MOST_ATTEMPTS without one, else open with the next number."""
    substance = F.col("status").isin(VALID, SCHEMA)
    first = F.min_by(F.when(substance, F.col("status")), F.when(substance, F.col("attempt_number")))
    at = F.min(F.when(substance, F.col("attempt_number")))
    n = F.count("*")
    state = F.when(at.isNotNull() & (at <= MOST_ATTEMPTS), "closed").when(n >= MOST_ATTEMPTS, "exhausted").otherwise("open")
    return ledger.groupBy("job_id").agg(state.alias("state"), F.when(state == "closed", first).alias("outcome"), F.when(state == "closed", at).alias("selected_attempt"), F.when(state == "open", n + 1).alias("next_attempt"))


def replay(ledger: DataFrame) -> DataFrame:
    """The state after each event, in order of attempts."""
    w = Window.partitionBy("job_id").orderBy("attempt_number").rowsBetween(Window.unboundedPreceding, 0)
    n = {s: F.sum((F.col("status") == s).cast("int")).over(w) for s in (VALID, PROTOCOL, SCHEMA, INFRA)}
    return ledger.select("job_id", "attempt_number", state_of(n[VALID], n[PROTOCOL], n[SCHEMA], n[INFRA]).alias("state"))


def problems(ledger: DataFrame) -> DataFrame:
    """(job_id, attempt_number, problem): attempts after the job closed, numbers that are not in sequence, changed request hashes, repeated closes."""
    w = Window.partitionBy("job_id").orderBy("attempt_number", "event_id")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    checks = F.array_compact(F.array(
        F.when(F.coalesce(F.max((F.col("status") == VALID).cast("int")).over(earlier), F.lit(0)) == 1, "after_close"),
        F.when(F.row_number().over(w) != F.col("attempt_number"), "not_contiguous"),
        F.when(~F.col("request_sha256").eqNullSafe(F.first("request_sha256").over(w)), "request_changed")))
    return ledger.select("job_id", "attempt_number", checks.alias("problems")).select("job_id", "attempt_number", F.explode("problems").alias("problem"))


def selected(ledger: DataFrame) -> DataFrame:
    """One attempt per job: the first valid one, else the last; with the number of failures before it."""
    w = Window.partitionBy("job_id")
    first_valid = F.min(F.when(F.col("status") == VALID, F.col("attempt_number"))).over(w)
    at = F.coalesce(first_valid, F.max("attempt_number").over(w))
    marked = ledger.withColumn("at", at).withColumn("failures", F.count_if((F.col("status") != VALID) & (F.col("attempt_number") < F.col("at"))).over(w))
    return marked.where("attempt_number = at").select("job_id", "attempt_number", "status", "failures")


def closed_gate(planned: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: planned jobs, closed ones, open ones, and whether truth may be read."""
    both = planned.select("job_id").distinct().join(job_states(ledger), "job_id", "left")
    is_open = F.coalesce(F.col("state") == "open", F.lit(True))
    return both.agg(F.count("*").alias("planned"), F.count_if(~is_open).alias("closed"), F.count_if(is_open).alias("open"), (F.count_if(is_open) == 0).alias("may_read_truth"))


def last_event(ledger: DataFrame, prefer_valid: bool = False) -> DataFrame:
    """Per job the last attempt, or the last valid one where that is preferred and there is one."""
    key = F.struct((F.col("status") == VALID).cast("int") if prefer_valid else F.lit(0), F.col("attempt_number"))
    return ledger.groupBy("job_id").agg(F.max_by(F.struct("attempt_number", "status", "event_id"), key).alias("x")).select("job_id", "x.*")


def reliability(ledger: DataFrame, by: str) -> DataFrame:
    """Attempts, retries, statuses, tokens and nearest-rank percentiles of `value` by a column."""
    return ledger.groupBy(by).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("attempt_number") > 1).alias("retries"), *[F.count_if(F.col("status") == s).alias(s) for s in (VALID, SCHEMA, INFRA, PROTOCOL)],
        F.sum("tokens").alias("tokens"), (F.sum("value").cast("double") / F.count("*")).alias("mean_value"), F.max("value").cast("double").alias("max_value"), F.count_if(F.col("value") >= 100).alias("slow"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").cast("double").alias("p95_value"))


def call_rollup(ledger: DataFrame) -> DataFrame:
    """Per job whether any and all attempts were valid, its longest value and summed tokens."""
    ok = F.col("status") == VALID
    return ledger.groupBy("job_id").agg(F.bool_or(ok).alias("any_valid"), F.bool_and(ok).alias("all_valid"), F.max("value").cast("double").alias("longest"), F.sum("tokens").alias("tokens"), F.count("*").alias("attempts"))
