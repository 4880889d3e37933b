"""Ledger states and event windows over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.operators import ledgers


def job_states(attempts: DataFrame) -> DataFrame:
    """A stream of (job_id, attempts, state) whenever a job has new attempts, in update mode: the batch operator as it is.

    State is a few counts per job, kept in the JVM. The same attempt must not arrive twice; drop duplicates within a watermark before, if it can.
    """
    return ledgers.job_states(attempts)


def windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """An extension: events and their summed value by type in tumbling or sliding windows; events later than `late` are dropped.

    In append mode a window is given once the watermark has passed its end.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: a user's events in sessions that end after a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
