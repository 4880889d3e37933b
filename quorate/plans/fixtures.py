"""Panels, truths, ledgers and other inputs made from the star-schema tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.operators.lineage import dealt

LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def read_dealt(spark: SparkSession, d: str, table: str, *keys: str) -> DataFrame:
    """The table in parts by the keys that don't grow with it; its rows are counted from the file's own metadata."""
    rows = read(spark, d, table)
    return dealt(rows, rows.count(), *keys)


def role(slot) -> F.Column:
    return F.when(slot <= 4, "proposer").when(slot == 5, "critic").when(slot == 6, "verifier").otherwise("judge")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Votes: an order is a case, each of its lines a slot that answers (return flag, line status)."""
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    q = F.col("l_quantity").cast("int")
    return read_dealt(spark, d, "lineitem", "l_orderkey").select(
        F.col("l_orderkey").alias("case_id"), slot.alias("slot"), F.array("l_returnflag", "l_linestatus").alias("answer"),
        F.array((q % 4 * 5).cast("string"), (F.col("l_linenumber") % 3 * 10).cast("string")).alias("digits"),
        F.col("l_discount").cast("decimal(12,4)").alias("confidence"), role(slot).alias("role"), "l_partkey", "l_suppkey", (q % 3 + 1).alias("holdout_terms"), (F.col("l_linenumber") % 3).alias("stage"))


def small_panel(spark: SparkSession, d: str) -> DataFrame:
    """As panel, with roles by slot modulo 5: 0 and 1 propose, 2 criticises, 3 verifies, 4 judges; more gates open."""
    m = F.col("slot") % 5
    return panel(spark, d).withColumn("role", F.when(m <= 1, "proposer").when(m == 2, "critic").when(m == 3, "verifier").otherwise("judge"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Per order the right answer, its block, family and tier."""
    places = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    customers = read(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "c_mktsegment")
    orders = read_dealt(spark, d, "orders", "o_custkey")
    right = F.array(F.when(F.col("o_orderpriority") < "3", "R").otherwise("N"), F.col("o_orderstatus"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("case_id"), right.alias("truth"), F.col("o_orderpriority").alias("block"), F.col("r_name").alias("family"), F.col("c_mktsegment").alias("tier"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Attempts: a user is a job, each event an attempt in order of time."""
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("purchase", "valid_output", "signup", "schema_invalid", "click", "schema_invalid", "error", "infrastructure_failure", "view", "protocol_violation")]), F.col("event_type"))
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").alias("job_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt_number"), "ts", "event_id", "event_type", status.alias("status"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.to_date("ts").alias("batch"), F.col("value").cast("decimal(18,4)").alias("value"))


PANEL = """panel AS (
  SELECT case_id, slot, [l_returnflag, l_linestatus] AS answer, [CAST(q % 4 * 5 AS VARCHAR), CAST(l_linenumber % 3 * 10 AS VARCHAR)] AS digits,
         CAST(l_discount AS DECIMAL(12,4)) AS confidence, CASE WHEN slot <= 4 THEN 'proposer' WHEN slot = 5 THEN 'critic' WHEN slot = 6 THEN 'verifier' ELSE 'judge' END AS role,
         l_partkey, l_suppkey, q % 3 + 1 AS holdout_terms, l_linenumber % 3 AS stage
  FROM (SELECT *, l_orderkey AS case_id, CAST(floor(l_quantity) AS INTEGER) AS q,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS slot FROM lineitem))"""
SMALL = PANEL + """,
small AS (
  SELECT * REPLACE (CASE slot % 5 WHEN 0 THEN 'proposer' WHEN 1 THEN 'proposer' WHEN 2 THEN 'critic' WHEN 3 THEN 'verifier' ELSE 'judge' END AS role) FROM panel)"""
TRUTH = """truth AS (
  SELECT o_orderkey AS case_id, [CASE WHEN o_orderpriority < '3' THEN 'R' ELSE 'N' END, o_orderstatus] AS truth, o_orderpriority AS block, r_name AS family, c_mktsegment AS tier
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LEDGER = """ledger AS (
  SELECT user_id AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS attempt_number, ts, event_id, event_type,
         CASE event_type WHEN 'purchase' THEN 'valid_output' WHEN 'signup' THEN 'schema_invalid' WHEN 'click' THEN 'schema_invalid' WHEN 'error' THEN 'infrastructure_failure' WHEN 'view' THEN 'protocol_violation' END AS status,
         CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, CAST(ts AS DATE) AS batch, CAST(value AS DECIMAL(18,4)) AS value
  FROM events)"""


def plurality_sql(source: str, name: str, where: str = "true", answer: str = "answer") -> str:
    """The vote by count, mean confidence and answer, as a common table expression."""
    return f"""{name} AS (
  SELECT case_id, {answer}, votes, conf_mean, votes_cast, unique_answers FROM (
    SELECT *, sum(votes) OVER (PARTITION BY case_id) AS votes_cast, count(*) OVER (PARTITION BY case_id) AS unique_answers,
           row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, conf_mean DESC, {answer}) AS r
    FROM (SELECT case_id, {answer}, count(*) AS votes, CAST(sum(confidence) AS DOUBLE) / count(*) AS conf_mean FROM {source} WHERE {answer} IS NOT NULL AND ({where}) GROUP BY case_id, {answer})) WHERE r = 1)"""
