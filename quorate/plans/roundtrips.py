"""Sources and sinks: records written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators import ledgers
from quorate.operators.lineage import new_path
from quorate.plans.fixtures import LEDGER, ledger, read
from quorate.plans.scores import SYSTEMS_SQL, decided
from quorate.sources import records


def src01(s, d):
    """Benchmark items as one JSON array per file, found out by the name."""
    path = new_path(s, "items") + ".json"
    one = read(s, d, "benchmark").groupBy((F.col("item_id") % 4).alias("part")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("item_id", F.length("text").alias("n"))))).alias("value"))
    one.select("value").repartition(4).write.text(path)
    return records.read_json(s, path, "item_id long, n int", lines=False)


SRC01 = "SELECT item_id, CAST(length(text) AS INTEGER) AS n FROM benchmark"


def src02(s, d):
    path = new_path(s, "ledger") + ".jsonl"
    ledger(s, d).select("job_id", "attempt_number", "status", "tokens").write.json(path)
    return ledgers.job_states(records.read_ledger(s, path, "job_id long, attempt_number int, status string, tokens long"))


def _state(x):
    return f"count(*) FILTER (status = '{x}')"


SRC02 = f"""WITH {LEDGER} SELECT job_id, count(*) AS attempts, CASE WHEN {_state('valid_output')} > 0 THEN 'closed:valid_output' WHEN {_state('protocol_violation')} > 0 THEN 'closed:protocol_violation'
WHEN {_state('schema_invalid')} >= 2 THEN 'closed:schema_invalid' WHEN {_state('infrastructure_failure')} >= 3 THEN 'closed:infrastructure_failure' ELSE 'open' END AS state FROM ledger GROUP BY job_id"""


def src04(s, d):
    """The wide case matrix written as CSV and read as long rows."""
    path = new_path(s, "matrix")
    x = decided(s, d).select("case_id", "method", F.col("exact").cast("int").alias("exact"))
    records.write_matrix(x, path, ["case_id"], ["exact"])
    return records.read_matrix(s, path, ["case_id"]).groupBy("method", "metric").agg(F.count("*").alias("cases"), F.sum("value").cast("long").alias("total"))


SRC04 = f"WITH {SYSTEMS_SQL} SELECT method, 'exact' AS metric, count(*) AS cases, count(*) FILTER (exact) AS total FROM sys GROUP BY method"


def src05(s, d):
    """Files below a folder with their digests: one per region's text."""
    path = new_path(s, "files")
    names = read(s, d, "region").select("r_name", F.col("r_regionkey").alias("key"))
    names.repartition(1).write.partitionBy("key").text(path)
    got = records.file_manifest(s, path, "*.txt")
    return got.select(F.regexp_extract("path", r"key=([0-9]+)/", 1).cast("int").alias("key"), "sha256", "bytes")


SRC05 = "SELECT r_regionkey AS key, sha256(r_name || chr(10)) AS sha256, CAST(length(r_name) + 1 AS BIGINT) AS bytes FROM region"


def src06(s, d):
    """Documents with a container of items whose fields have other names by part; a name that is there counts even if its value is null."""
    item = lambda k, v: F.concat(F.lit('{"'), k, F.lit('": "'), F.col("p_partkey").cast("string"), F.lit('", '), v, F.lit("}"))
    odd = F.col("p_partkey") % 2 == 1
    body = item(F.when(odd, "case_id").otherwise("id"), F.when(F.col("p_partkey") % 3 == 0, F.lit('"answer": null, "prediction": "x"')).otherwise(F.lit('"prediction": "y"')))
    docs = read(s, d, "part").select(F.try_parse_json(F.concat(F.lit('{"results": ['), body, F.lit("]}"))).alias("value"))
    return records.normalise(docs, "results", {"case_id": ["case_id", "id"], "answer": ["answer", "prediction"]})


SRC06 = "SELECT CAST(p_partkey AS VARCHAR) AS case_id, CASE WHEN p_partkey % 3 <> 0 THEN 'y' END AS answer FROM part"


def src07(s, d):
    """Event lines, some of them broken, decoded and counted per user's file."""
    path = new_path(s, "events")
    n = F.col("event_id") % 10
    line = F.when(n == 0, F.concat(F.to_json(F.struct(F.col("event_type").alias("type"))), F.lit(" x"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("type"))))
    read(s, d, "events").select(line.alias("value"), (F.col("user_id") % 5).alias("part")).write.partitionBy("part").text(path)
    v = records.decode_events(s, path, ["error"])
    return v.agg(F.sum("lines").alias("lines"), F.sum("broken").alias("broken"), F.bool_or("forbidden").alias("forbidden"))


SRC07 = "SELECT count(*) AS lines, count(*) FILTER (event_id % 10 = 0) AS broken, bool_or(event_type = 'error' AND event_id % 10 <> 0) AS forbidden FROM events"


def src10(s, d):
    e = read(s, d, "customer").select("c_custkey", F.concat(F.lit("by "), F.lower("c_name"), F.lit("@x.org in /home/"), F.col("c_mktsegment")).alias("note"), F.lit("me@x.org").alias("text"))
    return records.scrubbed(e)


SRC10 = "SELECT c_custkey, regexp_replace(regexp_replace('by ' || lower(c_name) || '@x.org in /home/' || c_mktsegment, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g'), '/(home|Users)/[A-Za-z0-9._-]+', '/\\1/<user>', 'g') AS note, 'me@x.org' AS text FROM customer"


def snk02(s, d):
    """A ledger that two appends made."""
    path = new_path(s, "append")
    l = ledger(s, d).select("job_id", "attempt_number", "status")
    records.append(l.where("attempt_number <= 3"), path)
    records.append(l.where("attempt_number > 3"), path)
    return records.read_ledger(s, path, "job_id long, attempt_number int, status string").groupBy("status").agg(F.count("*").alias("n"), F.max("attempt_number").alias("last"))


SNK02 = f"WITH {LEDGER} SELECT status, count(*) AS n, max(attempt_number) AS last FROM ledger GROUP BY status"

QUERIES = {
    "SRC01_json": (src01, SRC01), "SRC02_ledger": (src02, SRC02), "SRC04_matrix": (src04, SRC04), "SRC05_files": (src05, SRC05), "SRC06_normaliser": (src06, SRC06), "SRC07_event_lines": (src07, SRC07), "SRC10_scrub": (src10, SRC10), "SNK02_append": (snk02, SNK02),
}
