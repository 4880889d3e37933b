"""Token counts kept as delta-maintained rollups.

A store is a folder of committed batches and of snapshots of their totals. A batch holds signed changes per document and tokenizer
version: an insert adds a document's count, a delete takes it away, a revision takes the old count away and adds the new one. All
are additive, so totals by source, language and tokenizer version are those of a snapshot and the sums of later batches. A
batch is known by its id and counts once, however often, and by however many writers at a time, it is committed.

Null sources, languages and ids are groups and rows like all others, null and empty texts have no tokens, a text of any length is
read whole, repeated rows count as often as they occur, an empty table commits a batch without rows, and columns that aren't
named are not read.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import token_files
from quorate.llm.common import Workspace, children, delete, dir_files, move_new, small_batches

KEYS = ["source", "lang", "tokenizer"]
#: The version whose tokens are the ids of a byte-level BPE tokenizer.
BPE = "bpe_50k"
#: Batches beyond the last snapshot that make a commit write a new one.
EVERY = 16
#: Other tokenizer versions by name: the patterns whose matches are tokens.
VERSIONS = {"words_v1": r"[^\x20\x09-\x0D]+", "words_v2": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^\x20\x09-\x0D0-9A-Za-z\x{80}-\x{10FFFF}]"}


def _name(batch: str) -> str:
    """The batch's folder: its id, quoted so that any id is one name."""
    return quote(batch, safe="").replace(".", "%2E").replace("_", "%5F")


def count_tokens(text: Column, version: str) -> Column:
    """Number of tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def deltas(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Signed changes from one state of counted documents to another; both have key, source, lang, tokenizer and n_tokens.

    Each row of `before` is taken away and each row of `after` added; what is in both cancels out. No join is needed, so a
    null or repeated key is a row like all others.
    """
    signed = lambda df, sign: df.select(key, *KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("n_tokens") * sign).alias("tokens"))
    both = signed(after, 1).union(signed(before, -1))
    return both.groupBy(key, *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors and writers share.

    batches/<id> has a batch's sums, snapshots/<n> the totals of all batches up to some time and their ids. Either is written in
    a folder of the attempt's own and published by one rename that fails where its target is, so that of several writers
    of a batch exactly one wins, and what an interrupted one has left is never read.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = EVERY):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def committed(self, batch: str) -> bool:
        return dir_files(self.spark, f"{self.path}/batches/{_name(batch)}")

    def batches(self) -> list[str]:
        """Ids of all committed batches."""
        return sorted(unquote(x) for x in children(self.spark, f"{self.path}/batches"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch of signed changes (source, lang, tokenizer, docs, tokens), summed; False if it was or gets committed by another writer.

        After `every` batches beyond the last snapshot a new one is made.
        """
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        won = self._publish(lambda attempt: sums.write.parquet(attempt), f"batches/{_name(batch)}")
        if won and len(self._later()[1]) >= self.every:
            self.compact()
        return won

    def _publish(self, write, name: str) -> bool:
        attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
        write(attempt)
        won = move_new(self.spark, attempt, f"{self.path}/{name}")
        if not won:
            delete(self.spark, attempt)
        return won

    def _later(self) -> tuple[str | None, list[str]]:
        """The last snapshot's folder, and the ids of the batches that it doesn't have."""
        last = max(children(self.spark, f"{self.path}/snapshots"), default=None)
        if last is None:
            return None, self.batches()
        folder = f"{self.path}/snapshots/{last}"
        held = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{folder}/batches").collect()}  # ids, one a batch
        return folder, [b for b in self.batches() if b not in held]

    def _sums(self, folder: str | None, later: list[str]) -> DataFrame:
        kind = "source string, lang string, tokenizer string, docs long, tokens long"
        paths = [f"{folder}/totals"] * bool(folder) + [f"{self.path}/batches/{_name(b)}" for b in later]
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Makes a snapshot of all batches committed so far; False if there's nothing new, or another writer has made one meanwhile."""
        folder, later = self._later()
        if not later:
            return False

        def write(attempt: str) -> None:
            held = self.spark.createDataFrame([(b,) for b in later], "batch string")
            if folder:
                held = held.union(self.spark.read.schema("batch string").parquet(f"{folder}/batches"))
            held.coalesce(1).write.parquet(f"{attempt}/batches")
            self._sums(folder, later).write.parquet(f"{attempt}/totals")

        last = int(folder.rpartition("/")[2]) if folder else 0
        return self._publish(write, f"snapshots/{last + 1:012d}")

    def totals(self) -> DataFrame:
        """The present totals: those of the last snapshot and what was committed since; groups in which nothing is left aren't listed."""
        sums = self._sums(*self._later())
        return sums.select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def counted(docs: DataFrame, version: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(key, source, lang, tokenizer, n_tokens) of documents by a version; null texts have 0 tokens, texts are read whole, extra columns not at all.

    BPE counts the ids that the tokenizer file gives, without special tokens.
    """
    rows = docs.select(F.col(key), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer"), F.col(text).alias("n_tokens"))
    if version != BPE:
        return rows.withColumn("n_tokens", count_tokens(F.col("n_tokens"), version))
    path = tokenizer or token_files.default_tokenizer()

    def count(batches):
        enc = token_files.encoder(path)
        width = enc.kind().itemsize
        for batch in batches:
            numbers, texts = pa.array(range(batch.num_rows), pa.int64()), pc.fill_null(batch.column(4), "")
            n = [len(ids) // width for _, part in token_files.chunks(iter([pa.RecordBatch.from_arrays([numbers, texts], ["k", "t"])])) for ids in enc.encode(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], batch.schema.names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:4]]
    return rows.mapInArrow(count, ", ".join([*kinds, "n_tokens long"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those whose id is 0 mod 10 are deleted; those of 1 to 4 mod 10 are counted anew by a tokenizer.

    The batch of deletes is committed twice, by two writers at once, and the batch of inserts again at the end, which changes
    nothing; a snapshot is made on the way.
    """
    ws = Workspace(spark, "op3")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    words = ws.save(counted(docs, "words_v1"), "words")
    left, revised = F.col("doc_id") % 10 == 0, (F.col("doc_id") % 10).between(1, 4)
    nothing = words.limit(0)
    inserts, deletes = deltas(nothing, words), deltas(words.where(left), nothing)
    rollup = Rollup(spark, f"{ws.path}/rollup", every=2)
    rollup.commit("1-insert", inserts)
    with ThreadPoolExecutor(2) as writers:
        list(writers.map(lambda _: Rollup(spark, rollup.path, every=2).commit("2-delete", deletes), range(2)))
    with small_batches(spark):
        rollup.commit("3-revise", deltas(words.where(revised), counted(docs.where(revised), BPE)))
    rollup.commit("1-insert", inserts)
    return rollup.totals()
