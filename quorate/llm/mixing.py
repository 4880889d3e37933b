"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every row has a fixed 36-bit hash of its id and text. A source that is to give a fraction of its words takes the rows whose hash
is below a threshold, and the threshold comes from nested histograms: words are summed by source and the hash's first
12 bits, the bucket in which the running sum crosses the budget is found, and only the rows of that boundary bucket are
summed again by the next 12 bits, then by the last 12. No row is ever sorted, and what a histogram holds is bounded by
4096 buckets a source and level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm.common import Workspace

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
CAP = 2
BITS, LEVELS = 12, 3
MIX_COLUMNS = ("mix_size", "mix_hash", "mix_source", "mix_source_size", "mix_target", "mix_whole", "mix_limit", "mix_copies")
#: Tables with a row per source are broadcast up to so many sources; beyond, Spark joins them by shuffles.
MOST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of runs of anything but space and \\t to \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column) -> Column:
    """The first 36 bits of the MD5 of id and text, so that rows without an id or with the same one are told apart by their texts."""
    both = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 9), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """From (source, source_size): adds weight and target.

    Sources in code point order, null last, take the weights in turn. total times all words are shared by weight; no
    target goes above cap times its source's size, and the excess is shared again by weight among the others until none is
    above. In closed form: in ascending order of cap x size / weight, ties by code point, the first sources reach their caps,
    and all from the first that need not reach its own on get one common amount per unit of weight. The windows are over one
    row per source, which is what one task sorts (and spills).
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(total)) - before) / after)
    s = s.withColumn("place", F.row_number().over(order))
    s = s.withColumn("common", F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)["level"])
    capped = F.coalesce(F.least("most", F.col("common") * F.col("weight")), F.col("most"))
    return s.select("source", "source_size", "weight", capped.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, small=F.broadcast) -> DataFrame:
    """From rows (source, size, h) and budgets (source, budget): per source the hash limit below which rows are taken.

    Rows of one hash go together. The unit that crosses the budget is taken if at least half of it fits, so that the words
    taken differ from the budget by at most half of one unit.
    """
    found = budgets.select("source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inner = rows if level == 0 else rows.withColumn("prefix", F.shiftright("h", shift + BITS))
        on = ["source"] if level == 0 else ["source", "prefix"]
        edge = found.select(*[F.col(c).alias(f"f_{c}") for c in found.columns])
        hit = F.col("source").eqNullSafe(F.col("f_source"))
        for c in on[1:]:
            hit &= F.col(c) == F.col(f"f_{c}")
        last = level == LEVELS - 1
        own = inner if level == 0 else inner.join(small(edge.select(*[f"f_{c}" for c in on])), hit, "left_semi")
        hist = own.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("b"))
        hist = hist.withColumn("upto", run).join(small(edge), F.col("source").eqNullSafe(F.col("f_source")))
        crosses = (F.col("upto") - F.col("size") / 2 > F.col("f_left")) if last else (F.col("upto") > F.col("f_left"))
        first = hist.where(crosses).groupBy("source").agg(F.min_by(F.struct("b", (F.col("f_left") - (F.col("upto") - F.col("size"))).alias("left")), "b").alias("x"))
        first = first.select(F.col("source").alias("g_source"), F.col("x.b").alias("g_b"), F.col("x.left").alias("g_left"))
        # a source whose boundary bucket has nothing that crosses is taken up to the bucket's end
        end = ((F.col("f_prefix") + 1) * (1 << BITS)) if level else F.lit(1 << BITS)
        found = edge.join(small(first), F.col("f_source").eqNullSafe(F.col("g_source")), "left").select(
            F.col("f_source").alias("source"), F.coalesce("g_left", F.lit(0.0)).alias("left"), F.coalesce("g_b", end.cast("long")).alias("prefix"))
    return found.select("source", F.col("prefix").alias("limit"))


def mix(docs: DataFrame, ws, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """All rows of docs with mix_size, mix_source_size, mix_target and mix_copies: how often the mix holds the row.

    Each source repeats all its rows floor(target / size) times and once more those below its hash threshold. The result
    depends on ids, texts and sources alone, so reruns agree. Null texts have no words; they and empty ones are taken or
    left by their hash like others. A null source is a source. Rows of the same id and text go together. Columns of
    docs that are named like MIX_COLUMNS are replaced. Source statistics are as many rows as there are sources, broadcast after a check of their number.
    """
    docs = docs.drop(*MIX_COLUMNS)
    named = docs.select("*", words(F.col(text)).alias("mix_size"), row_hash(F.col(key), F.col(text)).alias("mix_hash"))
    narrow = ws.save(named.select(F.col(source).alias("source"), F.col("mix_size").alias("size"), F.col("mix_hash").alias("h")), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = ws.save(targets(sizes, weights, total, cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(ratio).cast("long"))
    budgets = goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    few = goal.count() <= MOST_SOURCES
    small = F.broadcast if few else (lambda df: df)
    limits = ws.save(thresholds(narrow, budgets, small), "limits")
    limits = limits.select(F.col("source").alias("l_source"), "limit")
    plan = goal.join(limits, F.col("source").eqNullSafe(F.col("l_source")), "left").select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), F.coalesce("limit", F.lit(0).cast("long")).alias("mix_limit"))
    both = named.join(small(plan), F.col(source).eqNullSafe(F.col("mix_source")))
    copies = (F.col("mix_whole") + (F.col("mix_hash") < F.col("mix_limit")).cast("long")).cast("int")
    return both.select(*[F.col(c) for c in docs.columns], "mix_size", "mix_source_size", "mix_target", F.least(copies, F.lit(int(cap))).alias("mix_copies"))


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed rows themselves: each as often as the mix holds it, those of 0 copies left out."""
    kept = mixed.where("mix_copies > 0").select(*[F.col(c) for c in columns], F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy"))
    return kept.drop("mix_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, Workspace(spark, "op7"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 9) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight
  FROM d GROUP BY source),
-- share what is left among the open sources, cap those above their most, and share again until none is above
g(step, source, source_size, weight, target, open, more) AS (
  SELECT 0, source, source_size, weight, 0.0::DOUBLE, true, true FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         CASE WHEN NOT open THEN target WHEN share > 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE share END,
         open AND share <= 2.0::DOUBLE * source_size, bool_or(open AND share > 2.0::DOUBLE * source_size) OVER ()
  FROM (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(CASE WHEN NOT open THEN target END) OVER (), 0))
              / sum(CASE WHEN open THEN weight END) OVER () * weight AS share
    FROM g WHERE more)),
t AS (SELECT source, source_size, target FROM g WHERE step = (SELECT max(step) FROM g)),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
u AS (SELECT source, h, sum(size) AS unit FROM d GROUP BY source, h),
r AS (SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY h) AS upto FROM u),
k AS (
  SELECT r.source, r.h, r.upto - r.unit / 2.0 <= b.target - b.whole * b.source_size AS more
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * least(2, b.whole + CASE WHEN k.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.h = d.h
"""
