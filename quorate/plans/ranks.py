"""Ranks, routes, sets and ledgers over order panels, event ledgers and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorate.operators import ledgers, ranks, sets
from quorate.plans.fixtures import LEDGER, PANEL, TRUTH, ledger, panel, read, read_dealt, truth

VOTES, INTS = "count(*)", "CAST({} AS INTEGER)"


def win01(s, d):
    bad = ledger(s, d).withColumn("claimed", F.when(F.col("event_id") % 17 == 0, F.col("attempt_number") + 1).otherwise(F.col("attempt_number")))
    return ranks.contiguity(bad, "job_id", "claimed", ["ts", "event_id"]).select("job_id", "event_id", "claimed", "place")


WIN01 = f"WITH {LEDGER} SELECT job_id, event_id, attempt_number + 1 AS claimed, attempt_number AS place FROM ledger WHERE event_id % 17 = 0"


def _entries(s, d):
    return panel(s, d).groupBy("l_suppkey", "role").agg(F.count_if(F.expr("holdout_terms = 3")).alias("x"))


def win02(s, d):
    e = _entries(s, d)
    low = ranks.best_of(e, ["role"], [-F.col("x")], "l_suppkey", "min").withColumnRenamed("l_suppkey", "min_hash")
    return low.join(ranks.best_of(e, ["role"], [-F.col("x")], "l_suppkey", "max").withColumnRenamed("l_suppkey", "max_hash"), "role")


WIN02 = f"""WITH {PANEL}, e AS (SELECT l_suppkey, role, count(*) FILTER (holdout_terms = 3) AS x, sha256(CAST(l_suppkey AS VARCHAR)) AS h FROM panel GROUP BY l_suppkey, role),
r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY x DESC, h) AS a, row_number() OVER (PARTITION BY role ORDER BY x DESC, h DESC) AS b FROM e)
SELECT role, max(l_suppkey) FILTER (a = 1) AS min_hash, max(l_suppkey) FILTER (b = 1) AS max_hash FROM r GROUP BY role"""


def win03(s, d):
    e = read(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("t0"), (F.unix_micros(F.col("ts").cast("timestamp")) + (F.round("value").cast("long") * 60_000_000)).alias("us"))
    return ranks.peak(e.select("event_type", "t0", F.timestamp_micros("us").alias("t1")), "t0", "t1", ["event_type"])


WIN03 = """WITH e AS (SELECT event_type, epoch_us(ts) AS a, epoch_us(ts) + CAST(round(value) AS BIGINT) * 60000000 AS b FROM events),
m AS (SELECT event_type, a AS t, 1 AS d FROM e WHERE a < b UNION ALL SELECT event_type, b, -1 FROM e WHERE a < b),
r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT event_type, CAST(max(n) AS BIGINT) AS peak FROM r GROUP BY event_type"""

SUPPORT = """ct AS (SELECT case_id, answer, count(*) AS c, sum(confidence) AS s FROM panel GROUP BY case_id, answer),
su AS (SELECT case_id, max(c) AS support, count(*) AS unique_answers, CAST(sum(s) AS DOUBLE) / sum(c) AS mean_confidence, CAST(sum(c) AS BIGINT) AS votes FROM ct GROUP BY case_id)"""


def win04(s, d):
    return ranks.panel_support(panel(s, d)).where("support = 1").orderBy(F.desc("unique_answers"), "mean_confidence", "case_id").limit(50)


WIN04 = f"WITH {PANEL}, {SUPPORT} SELECT * FROM su WHERE support = 1 ORDER BY unique_answers DESC, mean_confidence, case_id LIMIT 50"


def win05(s, d):
    return ranks.panel_support(panel(s, d)).where("support <= 2").orderBy("support", F.desc("unique_answers"), "mean_confidence", "case_id").limit(60)


WIN05 = f"WITH {PANEL}, {SUPPORT} SELECT * FROM su WHERE support <= 2 ORDER BY support, unique_answers DESC, mean_confidence, case_id LIMIT 60"


def _alive(s, d):
    p = panel(s, d)
    alive = p.where("holdout_terms = 3").groupBy("case_id").agg(F.count("*").alias("survivors"), F.max("slot").alias("verified"))
    return ranks.panel_support(p).join(alive, "case_id", "left").withColumns({"survivors": F.coalesce("survivors", F.lit(0)), "verified": F.coalesce("verified", F.lit(0))})


ALIVE = f"""WITH {PANEL}, {SUPPORT}, al AS (SELECT case_id, count(*) AS s, max(slot) AS v FROM panel WHERE holdout_terms = 3 GROUP BY case_id),
x AS (SELECT su.*, coalesce(s, 0) AS survivors, coalesce(v, 0) AS verified FROM su LEFT JOIN al ON su.case_id = al.case_id)"""


def win06(s, d):
    return _alive(s, d).where("survivors <= 1").orderBy("survivors", F.desc("unique_answers"), "case_id").limit(40).select("case_id", "survivors", "unique_answers")


WIN06 = f"{ALIVE} SELECT case_id, survivors, unique_answers FROM x WHERE survivors <= 1 ORDER BY survivors, unique_answers DESC, case_id LIMIT 40"


def win07(s, d):
    return _alive(s, d).where("verified <= 2").orderBy("verified", "survivors", F.desc("unique_answers"), "case_id").limit(40).select("case_id", "verified", "survivors", "unique_answers")


WIN07 = f"{ALIVE} SELECT case_id, verified, survivors, unique_answers FROM x WHERE verified <= 2 ORDER BY verified, survivors, unique_answers DESC, case_id LIMIT 40"


def win08(s, d):
    two = ranks.top_two(panel(s, d)).join(ranks.panel_support(panel(s, d)).select("case_id", "votes"), "case_id")
    return two.select("case_id", *[ranks.in_scope(two, x).alias(x) for x in ("all", "disputed", "low_margin", "no_consensus")])


WIN08 = f"""WITH {PANEL}, {SUPPORT}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, answer) AS k FROM ct),
t AS (SELECT case_id, coalesce(max(c) FILTER (k = 1), 0) AS a, coalesce(max(c) FILTER (k = 2), 0) AS b, count(*) AS u FROM r GROUP BY case_id)
SELECT t.case_id, true AS "all", u > 1 AS disputed, a - b <= 1 AS low_margin, a * 2 <= votes AS no_consensus FROM t JOIN su ON t.case_id = su.case_id"""


def _finalists(s, d):
    from quorate.operators import scores

    x = scores.score_records(panel(s, d), truth(s, d))
    return x.groupBy("l_suppkey").agg(F.count_if("exact").alias("exact"), F.count("*").alias("calls"), F.sum("terms").alias("terms"), F.count_if(F.col("exact") & (F.col("stage") == 0)).alias("weakest")).withColumn("h", F.sha2(F.col("l_suppkey").cast("string").cast("binary"), 256))


FINALISTS = f"""WITH {PANEL}, {TRUTH}, e AS (
  SELECT l_suppkey, count(*) FILTER (answer = truth) AS exact, count(*) AS calls, CAST(sum(CASE WHEN answer[1] = truth[1] THEN 1 ELSE 0 END + CASE WHEN answer[2] = truth[2] THEN 1 ELSE 0 END) AS BIGINT) AS terms,
         count(*) FILTER (answer = truth AND stage = 0) AS weakest, sha256(CAST(l_suppkey AS VARCHAR)) AS h FROM panel JOIN truth USING (case_id) GROUP BY l_suppkey)"""


def win09(s, d):
    """The registered order (fewer calls before terms) and the legacy order (terms first), three finalists each."""
    e = _finalists(s, d)
    keys = {"registered": [F.desc("exact"), F.desc("weakest"), "calls", F.desc("terms"), F.desc("h")], "legacy": [F.desc("exact"), F.desc("weakest"), F.desc("terms"), "calls", F.desc("h")]}
    a, b = (e.orderBy(*k).limit(3).select(F.lit(n).alias("ranking"), "l_suppkey", "exact", "weakest", "calls", "terms") for n, k in keys.items())
    return a.union(b)


WIN09 = f"""{FINALISTS} SELECT * FROM (SELECT 'registered' AS ranking, l_suppkey, exact, weakest, calls, terms FROM e ORDER BY exact DESC, weakest DESC, calls, terms DESC, h DESC LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'legacy', l_suppkey, exact, weakest, calls, terms FROM e ORDER BY exact DESC, weakest DESC, terms DESC, calls, h DESC LIMIT 3)"""


def win10(s, d):
    got = ranks.anonymous_order(panel(s, d), "case_id", [F.lit("judge"), F.col("case_id"), F.col("slot")], "C", 5)
    return got.select("case_id", "slot", "anonymous_id")


WIN10 = f"WITH {PANEL}, r AS (SELECT case_id, slot, row_number() OVER (PARTITION BY case_id ORDER BY sha256('judge|' || case_id || '|' || slot)) AS k FROM panel) SELECT case_id, slot, 'C' || lpad(CAST(k AS VARCHAR), 2, '0') AS anonymous_id FROM r WHERE k <= 5"


def win11(s, d):
    got = ranks.anonymous_order(read(s, d, "part").select("p_brand", "p_partkey"), "p_brand", [F.lit("shuffle"), F.col("p_partkey")], "E")
    return got.select("p_brand", "p_partkey", "place")


WIN11 = "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY sha256('shuffle|' || p_partkey)) AS INTEGER) AS place FROM part"


def win12(s, d):
    return ranks.race(_finalists(s, d), [F.desc("exact"), F.desc("terms"), F.col("h")], "calls", 10).select("l_suppkey", "exact", "terms", "calls")


WIN12 = f"{FINALISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY calls ORDER BY exact DESC, terms DESC, h) AS k FROM e) SELECT l_suppkey, exact, terms, calls FROM r WHERE k = 1 ORDER BY exact DESC, terms DESC, h LIMIT 10"


def win14(s, d):
    return ranks.split_blocks(read(s, d, "customer"), "c_mktsegment", ["c_custkey"], 6).select("c_mktsegment", "c_custkey", "part")


WIN14 = "SELECT c_mktsegment, c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 6 AS INTEGER) AS part FROM customer"


def win15(s, d):
    """Each order's suppliers in the order in which digests of the order's key pick them."""
    c = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("ids"))  # an order's lines are few
    return c.select("l_orderkey", F.array_join(ranks.popped(F.col("ids"), F.concat_ws("|", F.lit("quorate"), "l_orderkey")), ",").alias("picked"))


def _win15() -> str:
    at = "CAST(0 AS BIGINT)"
    for i in range(8):
        at = f"(({at} * {1 << 32} + CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) % len(rest))"
    return f"""WITH RECURSIVE r(l_orderkey, rest, got, k) AS (
  SELECT l_orderkey, list_sort(list(l_suppkey)), CAST([] AS BIGINT[]), 0 FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT l_orderkey, list_slice(rest, 1, pos) || list_slice(rest, pos + 2, len(rest)), list_append(got, rest[pos + 1]), k + 1
  FROM (SELECT *, {at} AS pos FROM (SELECT *, sha256('quorate|' || l_orderkey || '|' || k) AS h FROM r WHERE len(rest) > 0)))
SELECT l_orderkey, array_to_string(got, ',') AS picked FROM r WHERE len(rest) = 0"""


WIN15 = _win15()


def set01(s, d):
    docs = read(s, d, "documents").select(F.lower(F.trim("text")).alias("text_hash"), F.substring("text", 1, 40).alias("prefix"))
    items = read(s, d, "benchmark").select(F.lower(F.trim("text")).alias("text_hash"), F.substring("text", 1, 40).alias("prefix"))
    return sets.overlap(docs, items, ["text_hash", "prefix"])


SET01 = """WITH l AS (SELECT 'text_hash' AS key, lower(trim(text)) AS v FROM documents UNION ALL SELECT 'prefix', substr(text, 1, 40) FROM documents),
r AS (SELECT 'text_hash' AS key, lower(trim(text)) AS v FROM benchmark UNION ALL SELECT 'prefix', substr(text, 1, 40) FROM benchmark),
e AS (SELECT key, v, count(*) FILTER (s = 'l') AS l, count(*) FILTER (s = 'r') AS r FROM (SELECT 'l' AS s, * FROM l UNION ALL SELECT 'r', * FROM r) GROUP BY key, v)
SELECT key, count(*) FILTER (l > 0 AND r > 0) AS shared, CAST(sum(greatest(l - 1, 0)) AS BIGINT) AS left_repeats, CAST(sum(greatest(r - 1, 0)) AS BIGINT) AS right_repeats,
       count(*) FILTER (l > 0 AND r > 0) = 0 AND sum(greatest(l - 1, 0)) = 0 AND sum(greatest(r - 1, 0)) = 0 AS passed FROM e GROUP BY key"""


def set02(s, d):
    p = panel(s, d).select("case_id", "slot", "role")
    _, repeated = sets.checked_union([p.where("slot <= 3"), p.where("slot between 3 and 5")], ["case_id", "slot"])
    return repeated


SET02 = f"WITH {PANEL} SELECT case_id, slot, count(*) AS n FROM (SELECT * FROM panel WHERE slot <= 3 UNION ALL SELECT * FROM panel WHERE slot BETWEEN 3 AND 5) GROUP BY case_id, slot HAVING count(*) > 1"


def set03(s, d):
    l = ledger(s, d).select("job_id", "event_id", (F.col("status") == "valid_output").alias("ok"), "attempt_number")
    return sets.first_valid([l.where(f"attempt_number = {i}").drop("attempt_number") for i in (1, 2, 3)], "job_id", "ok")


SET03 = f"WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN status = 'valid_output' THEN 0 ELSE 1 END, attempt_number) AS k FROM ledger WHERE attempt_number <= 3) SELECT job_id, event_id, status = 'valid_output' AS ok, attempt_number - 1 AS wave FROM r WHERE k = 1"


def set04(s, d):
    o = read_dealt(s, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id")).where("id % 11 <> 0")
    return sets.difference(o, read_dealt(s, d, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("id")), "id")


SET04 = "SELECT DISTINCT o_orderkey AS id, 'missing' AS kind FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_orderkey % 11 = 0"


def set05(s, d):
    return sets.balance(truth(s, d), ["family", "tier"])


SET05 = f"WITH {TRUTH}, n AS (SELECT family, tier, count(*) AS n FROM truth GROUP BY family, tier) SELECT *, min(n) OVER () = max(n) OVER () AS even FROM n"


def set06(s, d):
    return sets.panels(truth(s, d), ["family", "tier"], "case_id", 4).select("case_id", "family", "tier", "panel")


SET06 = f"""WITH {TRUTH}, r AS (SELECT *, sha256(CAST(case_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY family, tier ORDER BY sha256(CAST(case_id AS VARCHAR)), case_id) AS k FROM truth)
SELECT case_id, family, tier, CASE WHEN substr(h, 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'even' ELSE 'odd' END AS panel FROM r WHERE k <= 4"""

STATE = """CASE WHEN {v} > 0 THEN 'closed:valid_output' WHEN {p} > 0 THEN 'closed:protocol_violation' WHEN {s} >= 2 THEN 'closed:schema_invalid' WHEN {i} >= 3 THEN 'closed:infrastructure_failure' ELSE 'open' END"""


def _state(f):
    return STATE.format(v=f("valid_output"), p=f("protocol_violation"), s=f("schema_invalid"), i=f("infrastructure_failure"))


def daily(s, d):
    """The ledger with a job for each user and day, whose few attempts leave jobs in all states."""
    w = Window.partitionBy("job_id", "batch").orderBy("ts", "event_id")
    return ledger(s, d).withColumn("attempt_number", F.row_number().over(w)).withColumn("job_id", F.concat_ws(" ", "job_id", "batch"))


DAILY = LEDGER + """, daily AS (
  SELECT * REPLACE (job_id || ' ' || batch AS job_id, CAST(row_number() OVER (PARTITION BY job_id, batch ORDER BY ts, event_id) AS INTEGER) AS attempt_number) FROM ledger)"""


def ledg01(s, d):
    return ledgers.lineage_states(daily(s, d))


LEDG01 = f"""WITH {DAILY}, x AS (SELECT job_id, count(*) AS n, min(attempt_number) FILTER (status IN ('valid_output', 'schema_invalid')) AS a, arg_min(status, attempt_number) FILTER (status IN ('valid_output', 'schema_invalid')) AS o FROM daily GROUP BY job_id),
y AS (SELECT *, CASE WHEN a IS NOT NULL AND a <= 3 THEN 'closed' WHEN n >= 3 THEN 'exhausted' ELSE 'open' END AS state FROM x)
SELECT job_id, state, CASE WHEN state = 'closed' THEN o END AS outcome, CASE WHEN state = 'closed' THEN a END AS selected_attempt, CASE WHEN state = 'open' THEN n + 1 END AS next_attempt FROM y"""


def ledg02(s, d):
    return ledgers.job_states(daily(s, d))


LEDG02 = f"WITH {DAILY} SELECT job_id, count(*) AS attempts, {_state(lambda x: f'count(*) FILTER (status = {chr(39)}{x}{chr(39)})')} AS state FROM daily GROUP BY job_id"


def ledg03(s, d):
    l = daily(s, d).withColumn("request_sha256", F.when(F.col("event_id") % 29 == 0, "changed").otherwise("same"))
    l = l.withColumn("attempt_number", F.when(F.col("event_id") % 31 == 0, F.col("attempt_number") + 10).otherwise(F.col("attempt_number")))
    return ledgers.problems(l)


LEDG03 = f"""WITH {DAILY}, a AS (SELECT job_id, event_id, status, CASE WHEN event_id % 29 = 0 THEN 'changed' ELSE 'same' END AS rq, CASE WHEN event_id % 31 = 0 THEN attempt_number + 10 ELSE attempt_number END AS attempt_number FROM daily),
b AS (SELECT *, coalesce(bool_or(status = 'valid_output') OVER (PARTITION BY job_id ORDER BY attempt_number, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late,
      row_number() OVER (PARTITION BY job_id ORDER BY attempt_number, event_id) AS k, first_value(rq) OVER (PARTITION BY job_id ORDER BY attempt_number, event_id) AS f FROM a)
SELECT job_id, attempt_number, 'after_close' AS problem FROM b WHERE late UNION ALL SELECT job_id, attempt_number, 'not_contiguous' FROM b WHERE k <> attempt_number UNION ALL SELECT job_id, attempt_number, 'request_changed' FROM b WHERE rq <> f"""


def ledg04(s, d):
    return ledgers.selected(daily(s, d))


LEDG04 = f"""WITH {DAILY}, a AS (SELECT *, coalesce(min(attempt_number) FILTER (status = 'valid_output') OVER (PARTITION BY job_id), max(attempt_number) OVER (PARTITION BY job_id)) AS att FROM daily),
b AS (SELECT *, count(*) FILTER (status <> 'valid_output' AND attempt_number < att) OVER (PARTITION BY job_id) AS failures FROM a) SELECT job_id, attempt_number, status, failures FROM b WHERE attempt_number = att"""


def ledg05(s, d):
    """Planned are all jobs of the ledger and one of New Year's Day for each customer."""
    planned = daily(s, d).select("job_id").union(read(s, d, "customer").select(F.concat_ws(" ", "c_custkey", F.lit("2024-01-01"))))
    return ledgers.closed_gate(planned, daily(s, d))


LEDG05 = f"""WITH {DAILY}, st AS (SELECT job_id, {_state(lambda x: f'count(*) FILTER (status = {chr(39)}{x}{chr(39)})')} AS state FROM daily GROUP BY job_id),
p AS (SELECT job_id FROM daily UNION SELECT c_custkey || ' 2024-01-01' FROM customer), x AS (SELECT coalesce(state = 'open', true) AS o FROM p LEFT JOIN st USING (job_id))
SELECT count(*) AS planned, count(*) FILTER (NOT o) AS closed, count(*) FILTER (o) AS open, count(*) FILTER (o) = 0 AS may_read_truth FROM x"""


def ledg06(s, d):
    last = ledgers.last_event(daily(s, d)).select("job_id", F.col("event_id").alias("last"))
    return last.join(ledgers.last_event(daily(s, d), True).select("job_id", F.col("event_id").alias("last_valid")), "job_id")


LEDG06 = f"WITH {DAILY} SELECT job_id, arg_max(event_id, attempt_number) AS last, arg_max(event_id, attempt_number + CASE WHEN status = 'valid_output' THEN 1000 ELSE 0 END) AS last_valid FROM daily GROUP BY job_id"


def ledg08(s, d):
    return ledgers.replay(daily(s, d))


LEDG08 = f"WITH {DAILY} SELECT job_id, attempt_number, {_state(lambda x: f'count(*) FILTER (status = {chr(39)}{x}{chr(39)}) OVER w')} AS state FROM daily WINDOW w AS (PARTITION BY job_id ORDER BY attempt_number ROWS UNBOUNDED PRECEDING)"

RELIABLE = """count(*) AS attempts, count(*) FILTER (attempt_number > 1) AS retries, count(*) FILTER (status = 'valid_output') AS valid_output, count(*) FILTER (status = 'schema_invalid') AS schema_invalid,
count(*) FILTER (status = 'infrastructure_failure') AS infrastructure_failure, count(*) FILTER (status = 'protocol_violation') AS protocol_violation, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(value) AS DOUBLE) / count(*) AS mean_value,
CAST(max(value) AS DOUBLE) AS max_value, count(*) FILTER (value >= 100) AS slow, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95_value"""


def agg13(s, d):
    return ledgers.reliability(ledger(s, d), "batch").withColumn("batch", F.col("batch").cast("string"))


AGG13 = f"WITH {LEDGER} SELECT CAST(batch AS VARCHAR) AS batch, {RELIABLE} FROM ledger GROUP BY batch"


def agg14(s, d):
    return ledgers.call_rollup(ledger(s, d))


AGG14 = f"WITH {LEDGER} SELECT job_id, bool_or(status = 'valid_output') AS any_valid, bool_and(status = 'valid_output') AS all_valid, CAST(max(value) AS DOUBLE) AS longest, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS attempts FROM ledger GROUP BY job_id"


def agg15(s, d):
    return ledgers.reliability(ledger(s, d), "event_type")


AGG15 = f"WITH {LEDGER} SELECT event_type, {RELIABLE} FROM ledger GROUP BY event_type"

QUERIES = {
    "WIN01_contiguity": (win01, WIN01), "WIN02_hash_ties": (win02, WIN02), "WIN03_peak_concurrency": (win03, WIN03), "WIN04_route_disagreement": (win04, WIN04), "WIN05_route_support": (win05, WIN05), "WIN06_route_recovery": (win06, WIN06),
    "WIN07_route_refinement": (win07, WIN07), "WIN08_scopes": (win08, WIN08), "WIN09_finalists": (win09, WIN09), "WIN10_anonymous_order": (win10, WIN10), "WIN11_seeded_shuffle": (win11, WIN11), "WIN12_race": (win12, WIN12),
    "WIN14_split_blocks": (win14, WIN14), "WIN15_pick_and_pop": (win15, WIN15),
    "SET01_overlap": (set01, SET01), "SET02_checked_union": (set02, SET02), "SET03_retry_merge": (set03, SET03), "SET04_difference": (set04, SET04), "SET05_balance": (set05, SET05), "SET06_panels": (set06, SET06),
    "LEDG01_lineage": (ledg01, LEDG01), "LEDG02_job_state": (ledg02, LEDG02), "LEDG03_problems": (ledg03, LEDG03), "LEDG04_selected": (ledg04, LEDG04), "LEDG05_closed_gate": (ledg05, LEDG05), "LEDG06_last_event": (ledg06, LEDG06), "LEDG08_replay": (ledg08, LEDG08),
    "AGG13_reliability": (agg13, AGG13), "AGG14_call_rollup": (agg14, AGG14), "AGG15_ledger_totals": (agg15, AGG15),
}
