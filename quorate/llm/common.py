"""What several operators share: the shared folder, written tables, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests) a new local one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quorate-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)  # with its scheme, so that it means the same to Spark and Arrow
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def fresh(*names: str) -> list[str]:
    """Column names that no table has: each name with a random end, for columns that a step adds beside a caller's own."""
    end = uuid.uuid4().hex
    return [f"__{name}_{end}" for name in names]


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs meanwhile goes to Python in batches of at most so many rows: texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def at_most(spark: SparkSession, rows: int) -> None:
    """From now on the session sends rows to Python in batches of at most so many: for frames that a caller runs later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    if before <= 0 or before > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """At a task's end in a Python worker: memory that it freed goes back to the system, as workers live on and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


class Workspace:
    """Tables written in a folder of their own below the shared one; what is read back has no lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later read needs."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _at(spark: SparkSession, path: str):
    """The path for the file system, and the file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def dir_files(spark: SparkSession, path: str) -> bool:
    p, files = _at(spark, path)
    return files.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it isn't there."""
    p, files = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(p)) if files.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, files = _at(spark, path)
    files.delete(p, True)


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder with files to a name that nothing has, in one step; False, and nothing moves, if something has it.

    On a local disk this is rename(2), which fails on a folder with files; elsewhere the file system's rename without
    overwriting, which HDFS does in one step. An object store without a rename of folders isn't a place for this.
    """
    jvm = spark.sparkContext._jvm
    (a, files), (b, _) = _at(spark, source), _at(spark, target)
    files.mkdirs(b.getParent())
    try:
        if files.getUri().getScheme() == "file":
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            options[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            one = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.move(one(a), one(b), options)
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
            options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, options)
    except Py4JJavaError:
        if not files.exists(b):
            raise
        return False
    return True


def components(edges: DataFrame, ws: Workspace, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of undirected links: (node, component), component being the smallest node that is reachable.

    Alternates large-star and small-star steps until nothing changes, a written table after each. Smallest neighbours
    come from partial aggregates and go back to the links by a join, so that a hub's links are never in one group.
    Links of a node with itself and links with a null end are left out; nodes without links have no row.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = ws.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark, step = tuple(row), step + 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.save(large.where("u <> v").distinct(), f"{name}-{step}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = ws.save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}", f"{name}-{step}l")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
