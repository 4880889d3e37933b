"""Importance resampling to a target distribution: hashed word features, weights from an array of gains, Gumbel scores, and ranks by radix sort.

Each text is read once, into the bucket numbers of its features. Counts of the buckets over all documents and over the target's
texts make one gain a bucket; a document's weight is the sum of its features' gains, its score the weight and a Gumbel number
drawn from its id, and those with the highest scores are a sample without replacement in proportion to the weights' exponentials.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm.common import Workspace
from quorate.llm.decontamination import words
from quorate.llm.radix_sort import ranked

BUCKETS, MOST_RUN, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Features whose bucket a task remembers.
REMEMBERED = 500_000


class _Buckets(dict):
    """Bucket numbers of features, the latest ones remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(text: str | None, longest: int = MOST_RUN) -> list[bytes]:
    """All runs of 1 to `longest` consecutive words, joined by one space."""
    w = words(text) if text else []
    return w + [b" ".join(w[i : i + k]) for k in range(2, longest + 1) for i in range(len(w) - k + 1)]


def hashed(texts: DataFrame, text: str = "text", key: str | None = None, buckets: int = BUCKETS, longest: int = MOST_RUN) -> DataFrame:
    """(id, n_words, buckets): of each row the bucket number of each of its features; id is the key as a long, or null."""

    def scan(batches):
        known = _Buckets(buckets)
        for batch in batches:
            n_words, ends, parts = [], [0], []
            for t in batch.column(1):
                found = features(t.as_py(), longest)
                codes = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                # f features are w words and w - k + 1 runs of each longer length that fits
                n_words.append(len(found) if longest == 1 else len(words(t.as_py() or "")))
                ends.append(ends[-1] + len(found))
                parts.append(codes)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), lists], ["id", "n_words", "buckets"])

    rows = texts.select((F.col(key) if key else F.lit(None)).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "id long, n_words long, buckets array<int>")


def counted(hashes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: sums of each task, then of all; as many rows as there are buckets come to the driver."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in hashes.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A gain a bucket: 1000 times the logarithm of its share of the target over its share of the corpus, one added to each count."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(hashes: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of hashed rows."""

    def weigh(batches):
        for batch in batches:
            lists = batch.column(2)
            n = np.asarray(lists.value_lengths(), np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])]).astype(np.int64)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(sums[ends] - sums[ends - n])], ["id", "n_words", "n_features", "weight"])

    return hashes.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, ws: Workspace, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = MOST_RUN, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: (key, n_features, weight, score, rank), rank being null where the row isn't drawn.

    Null and empty texts have no words, no features and weight 0; they get a score, but only rows with `least_words` words or more are
    drawn. Of these, `percent` in a hundred, rounded down, are drawn: those with the highest scores, ties to the smaller key, then to
    fewer features. A null key counts as empty text where numbers are drawn from it, and is the largest. Rows with the
    same key and text have the same score, so both are drawn or they are neighbours at the end. Texts are read whole; one of any
    length is one row of one task. An empty target gives each bucket the gain that the corpus alone has; empty docs give no row.
    Other columns of docs aren't read.
    """
    hashes = ws.save(hashed(docs, text, key, buckets, longest), "hashes")
    gain = gains(counted(hashes, buckets), counted(hashed(target, target_text, None, buckets, longest), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = ws.save(weighed(hashes, gain).withColumn("score", F.col("weight") + gumbel), "scored")
    ws.drop("hashes")
    fit = F.col("n_words") >= least_words
    columns = ["id", "n_features", "weight", "score"]
    n = scored.where(fit).count()
    places = ranked(scored.where(fit).select(*columns), [("score", True), ("id", False), ("n_features", False)], ws)
    drawn = places.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.union(rest).withColumnRenamed("id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target, Workspace(spark, "op13"))


#: CRC-32 of a word: a byte at a time; the table's 256 entries come from the rule (eight shifts with the reversed polynomial).
SQL = r"""
WITH RECURSIVE shifts(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifts WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM shifts WHERE k = 8),
w AS (
  SELECT 'd' AS o, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT 'b', item_id, NULL, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
e AS (SELECT o, id, r, unnest(ws) AS word FROM w),
v AS (SELECT DISTINCT word FROM e),
vb AS (
  SELECT word, list_transform(range(1, CAST(length(hex(encode(word))) // 2 + 1 AS BIGINT)), lambda j: 16 * (strpos('0123456789ABCDEF', hex(encode(word))[2 * j - 1]) - 1) + strpos('0123456789ABCDEF', hex(encode(word))[2 * j]) - 1) AS bytes FROM v),
crc(word, bytes, k, c) AS (
  SELECT word, bytes, 1, CAST(4294967295 AS BIGINT) FROM vb
  UNION ALL SELECT word, bytes, k + 1, xor(c >> 8, t[CAST(xor(c, bytes[k]) & 255 AS BIGINT) + 1]) FROM crc, tab WHERE k <= len(bytes)),
b AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE k = len(bytes) + 1),
n AS (SELECT bucket, count(*) FILTER (o = 'd') AS s, count(*) FILTER (o = 'b') AS t FROM e JOIN b USING (word) GROUP BY bucket),
al AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM n, al),
x AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM e JOIN b USING (word) JOIN g USING (bucket) WHERE o = 'd' GROUP BY r),
f AS (
  SELECT id AS doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST(('0x' || sha256('2024:' || coalesce(CAST(id AS VARCHAR), ''))[1:8]) AS BIGINT)::DOUBLE AS h
  FROM w LEFT JOIN x USING (r) WHERE o = 'd'),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS p, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= (10 * n) // 100 THEN p END AS rank FROM k
"""
