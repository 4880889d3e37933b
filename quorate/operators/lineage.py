"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a part that a task sorts or groups.
TASK_ROWS = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset (tests) a local folder is set first."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quorate-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame in parts by the keys of about TASK_ROWS of its `rows` rows each, where spark.sql.shuffle.partitions parts would be larger.

    Steps that group or join by these keys, or by more than these, stay in the parts, so that what a task holds doesn't grow with the table.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def spread(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """The frame in parts by the keys of about `size` rows each, for steps that take long a row: files and coalesced shuffles have parts by bytes."""
    return df.repartition(max(1, -(-df.count() // size)), *keys)
