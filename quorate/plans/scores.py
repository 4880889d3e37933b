"""Holdouts, joins, scores and costs over the order panels, users' event ledgers and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorate.operators import decisions, scores, votes
from quorate.operators.lineage import TASK_ROWS
from quorate.plans.fixtures import LEDGER, PANEL, SMALL, TRUTH, ledger, panel, plurality_sql, read, small_panel, truth


def text(c="answer"):
    return F.array_join(c, "|").alias(c)


def predictions(s, d):
    """Per user the last `holdout_terms` rounded values are hidden; three predictors extend what comes before."""
    e = read(s, d, "events").select("user_id", F.round("value").cast("long").cast("string").alias("v"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("k"))
    last = e.where("k <= 6").groupBy(F.col("user_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("k"), "v"))), lambda x: x["v"]).alias("seq")).where("size(seq) = 6")
    h = (F.col("case_id") % 3 + 1).cast("int")
    lens = F.explode(F.array(F.lit("lag1"), F.lit("lag2"), F.lit("true"))).alias("lens_id")
    p = last.select("case_id", "seq", h.alias("holdout_terms"), lens)
    first = F.element_at("seq", F.lit(6) - F.col("holdout_terms"))
    before = F.element_at("seq", F.greatest(F.lit(1), F.lit(5) - F.col("holdout_terms")))
    guess = F.when(F.col("lens_id") == "lag1", F.transform("seq", lambda x: first)).when(F.col("lens_id") == "lag2", F.transform("seq", lambda x: before)).otherwise(F.slice("seq", F.lit(7) - F.col("holdout_terms"), F.lit(6)))
    answer = F.concat(F.slice(guess, F.lit(1), F.col("holdout_terms")), F.array(first))
    return p.select("case_id", "lens_id", "holdout_terms", answer.alias("answer"), F.slice("seq", F.lit(7) - F.col("holdout_terms"), F.col("holdout_terms")).alias("visible_holdout"), F.lit(0.5).cast("decimal(12,4)").alias("confidence"))


HOLDOUT = """last6 AS (
  SELECT user_id AS case_id, list(v ORDER BY k DESC) AS seq FROM (
    SELECT user_id, CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 6 GROUP BY user_id HAVING count(*) = 6),
pr AS (
  SELECT case_id, lens_id, h AS holdout_terms, seq[7 - h : 6] AS visible_holdout, CAST(0.5 AS DECIMAL(12,4)) AS confidence,
         list_concat(CASE lens_id WHEN 'lag1' THEN list_transform(range(h), lambda x: seq[6 - h]) WHEN 'lag2' THEN list_transform(range(h), lambda x: seq[greatest(1, 5 - h)]) ELSE seq[7 - h : 6] END, [seq[6 - h]]) AS answer
  FROM (SELECT case_id, seq, CAST(case_id % 3 + 1 AS INTEGER) AS h, unnest(['lag1', 'lag2', 'true']) AS lens_id FROM last6)),
alive AS (SELECT case_id, lens_id, holdout_terms, answer[holdout_terms + 1 :] AS answer, confidence FROM pr WHERE answer[1 : holdout_terms] = visible_holdout)"""


def dec11(s, d):
    return decisions.survivors(predictions(s, d)).select("case_id", "lens_id", "holdout_terms", text())


DEC11 = f"WITH {HOLDOUT} SELECT case_id, lens_id, holdout_terms, array_to_string(answer, '|') AS answer FROM alive"


def horizons(s, d):
    p = panel(s, d)
    return p, votes.by_mean_confidence(p.where("slot <= 2")).select("case_id", "answer")


def _dec10(policy):
    def query(s, d):
        p, base = horizons(s, d)
        return decisions.holdout_policy(p.where("slot > 2"), base, policy).select("case_id", text(), "verified")

    return query


_base = plurality_sql("panel", "b", "slot <= 2")
_end = " SELECT b.case_id, array_to_string(coalesce(w.answer, b.answer), '|') AS answer, w.answer IS NOT NULL AS verified FROM b LEFT JOIN w ON b.case_id = w.case_id"
DEC10 = {
    "any": f"WITH {PANEL}, {_base}, {plurality_sql('panel', 'w', 'slot > 2')}{_end}",
    "longest": f"WITH {PANEL}, {_base}, m AS (SELECT case_id, max(holdout_terms) AS mx FROM panel WHERE slot > 2 GROUP BY case_id), pm AS (SELECT panel.* FROM panel JOIN m ON panel.case_id = m.case_id AND holdout_terms = mx WHERE slot > 2), {plurality_sql('pm', 'w')}{_end}",
    "weighted": f"WITH {PANEL}, {_base}, t AS (SELECT case_id, answer, count(*) AS votes, sum(holdout_terms) AS wt, CAST(sum(confidence) AS DOUBLE) / count(*) AS cm FROM panel WHERE slot > 2 GROUP BY case_id, answer), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY wt DESC, votes DESC, cm DESC, answer) AS r FROM t) WHERE r = 1){_end}",
    "two": f"WITH {PANEL}, {_base}, {plurality_sql('panel', 'w0', 'slot > 2')}, w AS (SELECT * FROM w0 WHERE votes >= 2){_end}",
    "horizons": f"WITH {PANEL}, {_base}, {plurality_sql('panel', 'w0', 'slot > 2')}, dp AS (SELECT case_id, answer FROM panel WHERE slot > 2 GROUP BY case_id, answer HAVING bool_or(holdout_terms = 2) AND bool_or(holdout_terms = 3)), w AS (SELECT w0.* FROM w0 JOIN dp ON w0.case_id = dp.case_id AND w0.answer = dp.answer){_end}",
}


def dec12(s, d):
    p, base = horizons(s, d)
    won = votes.by_depth(p.where("slot > 2 and holdout_terms >= 2"))
    verified = won.select("case_id", F.col("answer").alias("won"))
    both = base.join(verified, "case_id", "left").select("case_id", F.coalesce("won", "answer").alias("answer"), F.col("won").isNotNull().alias("replaced"))
    return both.join(truth(s, d), "case_id").groupBy("block").agg(F.count("*").alias("n"), F.count_if(scores.is_right(F.col("answer"), F.col("truth"))).alias("exact"), F.count_if("replaced").alias("replaced"))


DEC12 = f"""WITH {PANEL}, {TRUTH}, {_base},
t AS (SELECT case_id, answer, count(*) AS votes, sum(holdout_terms) AS ds, max(holdout_terms) AS dm, count(DISTINCT holdout_terms) AS dd, count(DISTINCT stage) AS st FROM panel WHERE slot > 2 AND holdout_terms >= 2 GROUP BY case_id, answer),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ds DESC, dm DESC, dd DESC, st DESC, votes DESC, answer) AS r FROM t) WHERE r = 1)
SELECT block, count(*) AS n, count(*) FILTER (coalesce(w.answer, b.answer) = truth) AS exact, count(*) FILTER (w.answer IS NOT NULL) AS replaced
FROM b LEFT JOIN w ON b.case_id = w.case_id JOIN truth ON truth.case_id = b.case_id GROUP BY block"""


def dec13(s, d):
    return decisions.oracle(panel(s, d).select("case_id", "answer"), truth(s, d)).groupBy("reachable").agg(F.count("*").alias("cases"))


DEC13 = f"WITH {PANEL}, {TRUTH}, x AS (SELECT t.case_id, coalesce(bool_or(p.answer = t.truth), false) AS reachable FROM truth t LEFT JOIN panel p ON t.case_id = p.case_id GROUP BY t.case_id) SELECT reachable, count(*) AS cases FROM x GROUP BY reachable"

ARCHIVE = """arch AS (
  SELECT l_partkey, answer, count(DISTINCT case_id) AS job_support, count(DISTINCT l_suppkey) AS strategy_support, count(DISTINCT stage) AS lens_support,
         count(*) FILTER (role = 'proposer') AS proposer_support, count(*) FILTER (role = 'critic') AS critic_support, count(*) FILTER (role = 'verifier') AS verifier_support, count(*) FILTER (role = 'judge') AS judge_support,
         CAST(sum(confidence) AS DOUBLE) / count(*) AS mean_confidence, CAST(max(confidence) AS DOUBLE) AS max_confidence, array_to_string(list(DISTINCT stage ORDER BY stage), ',') AS lenses
  FROM panel GROUP BY l_partkey, answer)"""


def arch(s, d):
    parts = max(int(s.conf.get("spark.sql.shuffle.partitions")), -(-read(s, d, "lineitem").count() // TASK_ROWS))
    own = panel(s, d).select("l_partkey", "answer", "case_id", "l_suppkey", "stage", "role", "confidence").repartition(parts, "l_partkey")
    return scores.archive(own, "l_partkey", "case_id", "l_suppkey", "stage")


def agg17(s, d):
    return arch(s, d).withColumn("answer", F.array_join("answer", "|"))


AGG17 = f"WITH {PANEL}, {ARCHIVE} SELECT * REPLACE (array_to_string(answer, '|') AS answer) FROM arch"


def agg18(s, d):
    got = scores.shares(arch(s, d), "l_partkey", ["job_support", "strategy_support", "proposer_support", "judge_support"])
    return got.withColumn("answer", F.array_join("answer", "|"))


def _share(c):
    return f"CASE WHEN sum({c}) OVER w > 0 THEN CAST({c} AS DOUBLE) / sum({c}) OVER w ELSE 0 END AS {c}_share"


AGG18 = f"WITH {PANEL}, {ARCHIVE} SELECT l_partkey, array_to_string(answer, '|') AS answer, {', '.join(map(_share, ['job_support', 'strategy_support', 'proposer_support', 'judge_support']))} FROM arch WINDOW w AS (PARTITION BY l_partkey)"


def dec14(s, d):
    feats = F.array(*[F.col(c).cast("double") for c in ("job_support", "strategy_support", "judge_support")])
    got = decisions.linear_choice(arch(s, d).withColumn("features", feats), [3, -1, 2], by=("l_partkey",))
    return got.select("l_partkey", text(), "score")


DEC14 = f"""WITH {PANEL}, {ARCHIVE},
r AS (SELECT *, CAST(3 * job_support - strategy_support + 2 * judge_support AS DOUBLE) AS score FROM arch),
q AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, answer) AS k FROM r)
SELECT l_partkey, array_to_string(answer, '|') AS answer, score FROM q WHERE k = 1"""

SCORED = """scored AS (
  SELECT panel.*, truth, block, family, tier, answer = truth AS exact, CASE WHEN answer[1] = truth[1] THEN 1 ELSE 0 END + CASE WHEN answer[2] = truth[2] THEN 1 ELSE 0 END AS terms FROM panel JOIN truth USING (case_id))"""


def scored(s, d):
    return scores.score_records(panel(s, d), truth(s, d))


def agg01(s, d):
    return scored(s, d).groupBy("slot").agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.sum("terms").alias("terms"), F.sum(F.get("per_term", F.lit(0))).alias("term1"), F.count_if("format_valid").alias("format_valid"))


AGG01 = f"WITH {PANEL}, {TRUTH}, {SCORED} SELECT slot, count(*) AS n, count(*) FILTER (exact) AS exact, CAST(sum(terms) AS BIGINT) AS terms, count(*) FILTER (answer[1] = truth[1]) AS term1, count(*) AS format_valid FROM scored GROUP BY slot"


def agg02(s, d):
    x = scored(s, d)
    return x.withColumn("c", F.round(scores.calibration(x), 8).cast("decimal(18,8)")).groupBy("block").agg(F.count("*").alias("n"), F.round(F.sum("c").cast("double") / F.count("*"), 9).alias("calibration"))


AGG02 = f"WITH {PANEL}, {TRUTH}, {SCORED} SELECT block, count(*) AS n, round(CAST(sum(CAST(round(1 - pow(CAST(confidence AS DOUBLE) - CASE WHEN exact THEN 1 ELSE 0 END, 2), 8) AS DECIMAL(18,8))) AS DOUBLE) / count(*), 9) AS calibration FROM scored GROUP BY block"


def agg03(s, d):
    return scores.summary(scored(s, d), ["role", "block"])


AGG03 = f"WITH {PANEL}, {TRUTH}, {SCORED} SELECT role, block, count(*) AS n, count(*) FILTER (exact) AS exact, CAST(count(*) FILTER (exact) AS DOUBLE) / count(*) AS exact_rate, CAST(sum(terms) AS BIGINT) AS terms, count(*) AS format_valid FROM scored GROUP BY role, block"


def agg04(s, d):
    calls = scores.dedupe_calls(panel(s, d), "l_suppkey", ["l_suppkey", "holdout_terms"])
    return calls.select("repeats", "conflict", F.col("holdout_terms").alias("most")).groupBy("conflict").agg(F.count("*").alias("calls"), F.sum("repeats").alias("repeats"), F.sum("most").alias("most"))


AGG04 = f"WITH {PANEL}, c AS (SELECT l_suppkey, max(holdout_terms) AS m, count(*) AS r, count(DISTINCT holdout_terms) > 1 AS conflict FROM panel GROUP BY l_suppkey) SELECT conflict, count(*) AS calls, CAST(sum(r) AS BIGINT) AS repeats, CAST(sum(m) AS BIGINT) AS most FROM c GROUP BY conflict"


def agg05(s, d):
    return scores.breakdown(scored(s, d), "role", ["block", "family", "tier"])


AGG05 = f"""WITH {PANEL}, {TRUTH}, {SCORED}
SELECT role, CASE WHEN grouping(block) = 0 THEN 'block' WHEN grouping(family) = 0 THEN 'family' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS level, coalesce(block, family, tier, 'all') AS value, count(*) AS n, count(*) FILTER (exact) AS exact
FROM scored GROUP BY GROUPING SETS ((role), (role, block), (role, family), (role, tier))"""


def agg06(s, d):
    return scores.leave_one_out(scored(s, d), "block")


AGG06 = f"WITH {PANEL}, {TRUTH}, {SCORED}, b AS (SELECT block, count(*) AS n, count(*) FILTER (exact) AS x FROM scored GROUP BY block) SELECT block, CAST(sum(x) OVER () - x AS DOUBLE) / (sum(n) OVER () - n) AS exact_rate_without FROM b"


def decided(s, d):
    """Decisions of all systems, long."""
    x = scores.score_records(decisions.decide_all(small_panel(s, d)), truth(s, d))
    right = scores.is_right(F.col("plurality"), F.col("truth"))
    return x.withColumn("harmful", right & ~F.col("exact"))


def agg07(s, d):
    return scores.fitness(decided(s, d).where("method in ('judge', 'dual')"), "method", "block")


AGG07 = f"""WITH {SMALL}, {TRUTH}, {plurality_sql('small', 'v', "role = 'proposer'")},
g AS (SELECT case_id, arg_min(answer, slot) FILTER (role = 'judge') AS j, coalesce(count(*) FILTER (role = 'judge') = 2 AND count(DISTINCT answer) FILTER (role = 'judge') = 1, false) AS ok, min(answer) FILTER (role = 'judge') AS a FROM small GROUP BY case_id),
x AS (
  SELECT 'judge' AS method, g.case_id, v.answer AS p, j AS answer FROM g LEFT JOIN v ON g.case_id = v.case_id
  UNION ALL SELECT 'dual', g.case_id, v.answer, CASE WHEN ok THEN a ELSE v.answer END FROM g LEFT JOIN v ON g.case_id = v.case_id),
y AS (
  SELECT method, block, count(*) FILTER (coalesce(answer = truth, false)) AS x, count(*) FILTER (coalesce(p = truth, false) AND NOT coalesce(answer = truth, false)) AS h,
         sum(CASE WHEN answer[1] = truth[1] THEN 1 ELSE 0 END + CASE WHEN answer[2] = truth[2] THEN 1 ELSE 0 END) AS t, count(answer) AS f, count(*) AS n
  FROM x JOIN truth ON x.case_id = truth.case_id GROUP BY method, block)
SELECT method, CAST(sum(x) AS BIGINT) AS exact, min(x) AS weakest_block, CAST(sum(h) AS BIGINT) AS harmful, CAST(sum(t) AS BIGINT) AS terms, CAST(sum(f) AS BIGINT) AS format_valid, CAST(sum(n) AS BIGINT) AS n,
       CAST(6 * sum(x) + sum(t) - sum(h) AS DOUBLE) / (11 * sum(n)) AS fitness FROM y GROUP BY method"""


def agg08(s, d):
    return agg07(s, d).select("method", "fitness")


AGG08 = f"SELECT method, fitness FROM ({AGG07})"


def agg09(s, d):
    return scores.critical_path(ledger(s, d), "job_id", "batch", "tokens")


AGG09 = f"WITH {LEDGER}, b AS (SELECT job_id, batch, count(*) AS n, sum(tokens) AS s, max(tokens) AS m FROM ledger GROUP BY job_id, batch) SELECT job_id, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(s) AS BIGINT) AS total, CAST(sum(m) AS BIGINT) AS critical_path, count(*) AS batches FROM b GROUP BY job_id"


def agg10(s, d):
    by = panel(s, d).groupBy("case_id", "stage").agg(F.max("holdout_terms").alias("m"), F.sum("holdout_terms").alias("s"), F.count("*").alias("n"))
    return by.groupBy("case_id").agg((F.sum("s") / F.sum("n")).alias("direct"), F.max("m").alias("ensemble"), F.sum("m").alias("collaboration"))


AGG10 = f"WITH {PANEL}, b AS (SELECT case_id, stage, max(holdout_terms) AS m, sum(holdout_terms) AS s, count(*) AS n FROM panel GROUP BY case_id, stage) SELECT case_id, CAST(sum(s) AS DOUBLE) / sum(n) AS direct, max(m) AS ensemble, CAST(sum(m) AS BIGINT) AS collaboration FROM b GROUP BY case_id"


def agg11(s, d):
    return scored(s, d).groupBy("role").agg(scores.per_correct(F.sum("holdout_terms"), F.count_if("exact")).alias("tokens_per_correct"), scores.per_correct(F.count("*"), F.count_if("exact")).alias("calls_per_correct"))


AGG11 = f"WITH {PANEL}, {TRUTH}, {SCORED} SELECT role, CASE WHEN count(*) FILTER (exact) > 0 THEN CAST(sum(holdout_terms) AS DOUBLE) / count(*) FILTER (exact) END AS tokens_per_correct, CASE WHEN count(*) FILTER (exact) > 0 THEN CAST(count(*) AS DOUBLE) / count(*) FILTER (exact) END AS calls_per_correct FROM scored GROUP BY role"


def agg12(s, d):
    usage = F.when(F.col("conv_id") % 3 == 0, F.length("text").cast("long"))
    return read(s, d, "conversations").groupBy("role").agg(F.sum(scores.token_proxy(usage, F.col("text"))).alias("tokens"), F.count_if(usage.isNull()).alias("estimated"))


AGG12 = "SELECT role, CAST(sum(coalesce(CASE WHEN conv_id % 3 = 0 THEN length(text) END, CAST(ceil(length(text) / 4.0) AS BIGINT))) AS BIGINT) AS tokens, count(*) FILTER (conv_id % 3 <> 0) AS estimated FROM conversations GROUP BY role"


def agg16(s, d):
    return scores.clusters(panel(s, d), ["case_id"], "slot").withColumn("answer", F.array_join("answer", "|"))


AGG16 = f"WITH {PANEL} SELECT case_id, array_to_string(answer, '|') AS answer, count(*) AS support, round(CAST(sum(confidence) AS DOUBLE) / count(*), 6) AS confidence, arg_min(slot, -confidence * 1000000 + slot) AS representative, array_to_string(list(slot ORDER BY slot), ',') AS members FROM panel GROUP BY case_id, panel.answer"


def agg19(s, d):
    x = scored(s, d).groupBy("l_suppkey").agg(F.count_if("exact").alias("exact"), F.sum("terms").alias("terms"), F.count("*").alias("cases"), (F.sum("confidence").cast("double") / F.count("*")).alias("mean_confidence"), F.count_if(F.col("exact") & (F.col("block") == "1-URGENT")).alias("exact_urgent"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("exact"), F.desc("terms"), "l_suppkey")))


AGG19 = f"WITH {PANEL}, {TRUTH}, {SCORED}, x AS (SELECT l_suppkey, count(*) FILTER (exact) AS exact, CAST(sum(terms) AS BIGINT) AS terms, count(*) AS cases, CAST(sum(confidence) AS DOUBLE) / count(*) AS mean_confidence, count(*) FILTER (exact AND block = '1-URGENT') AS exact_urgent FROM scored GROUP BY l_suppkey) SELECT *, CAST(row_number() OVER (ORDER BY exact DESC, terms DESC, l_suppkey) AS INTEGER) AS place FROM x"


def agg20(s, d):
    return scores.diagnostics(scored(s, d))


AGG20 = f"WITH {PANEL}, {TRUTH}, {SCORED}, t AS (SELECT case_id, answer, count(*) AS c, count(*) FILTER (exact) AS x FROM scored GROUP BY case_id, answer) SELECT case_id, count(*) AS unique_answers, CAST(sum(x) AS BIGINT) AS correct_support, max(c) AS plurality_support, sum(x) > 0 AS reachable FROM t GROUP BY case_id"


def agg21(s, d):
    p = predictions(s, d)
    alive = decisions.survivors(p).select("case_id", "lens_id", F.lit(True).alias("alive"))
    return p.join(alive, ["case_id", "lens_id"], "left").groupBy("lens_id").agg(F.count("*").alias("calls"), F.count_if("alive").alias("survivors"))


AGG21 = f"WITH {HOLDOUT} SELECT lens_id, count(*) AS calls, count(*) FILTER (answer[1 : holdout_terms] = visible_holdout) AS survivors FROM pr GROUP BY lens_id"


def agg22(s, d):
    f = scores.fitness(decided(s, d), "method", "block")
    rules = {"harmful_within_wrong": F.col("harmful") <= F.col("n") - F.col("exact"), "terms_at_least_exact": 2 * F.col("exact") <= F.col("terms"), "terms_within_format": F.col("terms") <= 2 * F.col("format_valid"), "all_right": F.col("exact") == F.col("n")}
    return scores.violations(f, rules, "method")


def join01(s, d):
    bad = panel(s, d).withColumn("case_id", F.when(F.col("case_id") % 50 == 0, -F.col("case_id")).otherwise(F.col("case_id")))
    return scores.unknown_cases(bad, truth(s, d))


JOIN01 = f"WITH {PANEL}, {TRUTH} SELECT DISTINCT CASE WHEN case_id % 50 = 0 THEN -case_id ELSE case_id END AS case_id FROM panel WHERE CASE WHEN case_id % 50 = 0 THEN -case_id ELSE case_id END NOT IN (SELECT case_id FROM truth)"


def join02(s, d):
    planned = read(s, d, "orders").select(F.col("o_orderkey").alias("case_id"))
    return scores.grid(planned, panel(s, d)).groupBy("case_id").agg(F.count_if("present").alias("records"), F.bool_or("present").alias("present"))


JOIN02 = f"WITH {PANEL} SELECT o_orderkey AS case_id, count(slot) AS records, count(slot) > 0 AS present FROM orders LEFT JOIN panel ON o_orderkey = case_id GROUP BY o_orderkey"


def join03(s, d):
    key = F.struct(F.when(F.col("status") == "valid_output", 0).when(F.col("status") == "schema_invalid", 1).otherwise(2), F.col("attempt_number"))
    return ledger(s, d).groupBy("job_id").agg(F.min_by(F.struct("attempt_number", "status", "event_id"), key).alias("x")).select("job_id", "x.*")


JOIN03 = f"WITH {LEDGER}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE status WHEN 'valid_output' THEN 0 WHEN 'schema_invalid' THEN 1 ELSE 2 END, attempt_number) AS k FROM ledger) SELECT job_id, attempt_number, status, event_id FROM r WHERE k = 1"


def join04(s, d):
    """A case's pick is its first line of the smallest part; it resolves only if exactly one record matches."""
    p = panel(s, d)
    pick = p.groupBy("case_id").agg(F.min(F.struct("holdout_terms", "stage")).alias("k"))
    m = p.join(pick, "case_id").where(F.struct("holdout_terms", "stage") == F.col("k"))
    return m.groupBy("case_id").agg(F.when(F.count("*") == 1, F.min(F.array_join("answer", "|"))).alias("answer"), F.count("*").alias("matches"))


JOIN04 = f"WITH {PANEL}, k AS (SELECT case_id, min(holdout_terms * 10 + stage) AS k FROM panel GROUP BY case_id) SELECT panel.case_id, CASE WHEN count(*) = 1 THEN min(array_to_string(answer, '|')) END AS answer, count(*) AS matches FROM panel JOIN k ON panel.case_id = k.case_id AND holdout_terms * 10 + stage = k.k GROUP BY panel.case_id"


def join05(s, d):
    keys = predictions(s, d).select("case_id", "lens_id").where("case_id % 7 <> 0")
    results = decisions.survivors(predictions(s, d)).where("case_id % 5 <> 0").select(F.col("case_id").alias("c"), F.col("lens_id").alias("l"))
    both = keys.join(results, (F.col("case_id") == F.col("c")) & (F.col("lens_id") == F.col("l")), "full_outer")
    side = F.when(F.col("c").isNull(), "key_only").when(F.col("case_id").isNull(), "result_only").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


JOIN05 = f"WITH {HOLDOUT}, k AS (SELECT case_id, lens_id FROM pr WHERE case_id % 7 <> 0), r AS (SELECT case_id AS c, lens_id AS l FROM alive WHERE case_id % 5 <> 0) SELECT CASE WHEN c IS NULL THEN 'key_only' WHEN case_id IS NULL THEN 'result_only' ELSE 'both' END AS side, count(*) AS n FROM k FULL OUTER JOIN r ON case_id = c AND lens_id = l GROUP BY 1"


def join06(s, d):
    x = decided(s, d).select("case_id", "method", F.col("exact").cast("int").alias("e"))
    y = x.select(F.col("case_id").alias("c"), F.col("method").alias("right_method"), F.col("e").alias("f"))
    both = x.join(y, (F.col("case_id") == F.col("c")) & (F.col("method") < F.col("right_method")))
    return both.groupBy(F.col("method").alias("left_method"), "right_method").agg(F.count("*").alias("n"), F.count_if(F.expr("e > f")).alias("left_only"), F.count_if(F.expr("e < f")).alias("right_only"), F.count_if(F.expr("e = 1 and f = 1")).alias("both"), F.count_if(F.expr("e = 0 and f = 0")).alias("neither"))


def _systems_sql():
    from quorate.plans.votes import DEC

    parts = " UNION ALL ".join(f"SELECT case_id, '{m}' AS method, answer FROM ({q})" for m, q in DEC.items())
    return f"""t AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority < '3' THEN 'R' ELSE 'N' END || '|' || o_orderstatus AS truth, o_orderpriority AS block FROM orders),
sys AS (SELECT u.case_id, method, answer, block, coalesce(answer = truth, false) AS exact FROM ({parts}) u JOIN t ON u.case_id = t.case_id)"""


SYSTEMS_SQL = _systems_sql()
JOIN06 = f"WITH {SYSTEMS_SQL} SELECT x.method AS left_method, y.method AS right_method, count(*) AS n, count(*) FILTER (x.exact AND NOT y.exact) AS left_only, count(*) FILTER (y.exact AND NOT x.exact) AS right_only, count(*) FILTER (x.exact AND y.exact) AS both, count(*) FILTER (NOT x.exact AND NOT y.exact) AS neither FROM sys x JOIN sys y ON x.case_id = y.case_id AND x.method < y.method GROUP BY 1, 2"


def join07(s, d):
    a = truth(s, d).select("case_id", "block")
    b = read(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 101 == 0, "x").otherwise(F.col("o_orderpriority")).alias("other"))
    return a.join(b, "case_id", "full_outer").where(~F.col("block").eqNullSafe(F.col("other"))).select("case_id", "block", "other")


JOIN07 = "SELECT o_orderkey AS case_id, o_orderpriority AS block, 'x' AS other FROM orders WHERE o_orderkey % 101 = 0"


def join08(s, d):
    sums = scored(s, d).groupBy("l_suppkey").agg(F.count_if("exact").alias("x"))
    pairs = sums.select(F.col("l_suppkey").alias("child"), (F.col("l_suppkey") - 1).alias("parent"))
    got = pairs.join(sums.select(F.col("l_suppkey").alias("child"), F.col("x").alias("cx")), "child").join(sums.select(F.col("l_suppkey").alias("parent"), F.col("x").alias("px")), "parent")
    return got.select("child", "parent", (F.col("cx") > F.col("px")).alias("replaced"))


JOIN08 = f"WITH {PANEL}, {TRUTH}, {SCORED}, x AS (SELECT l_suppkey, count(*) FILTER (exact) AS x FROM scored GROUP BY l_suppkey) SELECT c.l_suppkey AS child, p.l_suppkey AS parent, c.x > p.x AS replaced FROM x c JOIN x p ON p.l_suppkey = c.l_suppkey - 1"


def join09(s, d):
    o, l = read(s, d, "orders").select("o_orderkey"), read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(l, "o_orderkey", "left_anti").select("o_orderkey", F.lit("missing").alias("kind"))


JOIN09 = "SELECT o_orderkey, 'missing' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"


def join11(s, d):
    t = truth(s, d)
    cells = t.select("family").distinct().crossJoin(t.select("tier").distinct())  # families x tiers
    n = t.where("block = '1-URGENT'").groupBy(F.col("family").alias("f"), F.col("tier").alias("t")).agg(F.count("*").alias("n"))
    return cells.join(n, (F.col("family") == F.col("f")) & (F.col("tier") == F.col("t")), "left").select("family", "tier", F.coalesce("n", F.lit(0)).alias("cases"))


JOIN11 = f"WITH {TRUTH} SELECT f.family, t.tier, count(x.case_id) AS cases FROM (SELECT DISTINCT family FROM truth) f CROSS JOIN (SELECT DISTINCT tier FROM truth) t LEFT JOIN (SELECT * FROM truth WHERE block = '1-URGENT') x ON x.family = f.family AND x.tier = t.tier GROUP BY 1, 2"


def snk04(s, d):
    """The wide case matrix: a column of exactness per method."""
    return decided(s, d).groupBy("case_id").pivot("method", sorted(decisions.SYSTEMS)).agg(F.max(F.col("exact").cast("int")))


SNK04 = f"WITH {SYSTEMS_SQL} SELECT case_id, {', '.join(f'max(CASE WHEN exact THEN 1 ELSE 0 END) FILTER (method = {chr(39)}{m}{chr(39)}) AS {m}' for m in sorted(decisions.SYSTEMS))} FROM sys GROUP BY case_id"

AGG22 = f"""WITH {SMALL}, {TRUTH}, {SYSTEMS_SQL}, {plurality_sql('small', 'pl', "role = 'proposer'")},
f AS (
  SELECT method, count(*) AS n, count(*) FILTER (exact) AS x, count(*) FILTER (NOT exact AND coalesce(pl.answer = truth.truth, false)) AS h, count(sys.answer) AS f,
         sum(CASE WHEN split_part(sys.answer, '|', 1) = truth.truth[1] THEN 1 ELSE 0 END + CASE WHEN split_part(sys.answer, '|', 2) = truth.truth[2] THEN 1 ELSE 0 END) AS t
  FROM sys JOIN truth ON truth.case_id = sys.case_id LEFT JOIN pl ON pl.case_id = sys.case_id GROUP BY method)
SELECT method, 'harmful_within_wrong' AS rule FROM f WHERE h > n - x UNION ALL SELECT method, 'terms_at_least_exact' FROM f WHERE 2 * x > t UNION ALL SELECT method, 'terms_within_format' FROM f WHERE t > 2 * f UNION ALL SELECT method, 'all_right' FROM f WHERE x <> n"""

QUERIES = {
    **{f"DEC10_policy_{p}": (_dec10(p), q) for p, q in DEC10.items()},
    "DEC11_survivors": (dec11, DEC11), "DEC12_verified_system": (dec12, DEC12), "DEC13_oracle": (dec13, DEC13), "DEC14_linear_choice": (dec14, DEC14),
    "AGG01_terms": (agg01, AGG01), "AGG02_calibration": (agg02, AGG02), "AGG03_summary": (agg03, AGG03), "AGG04_call_dedupe": (agg04, AGG04), "AGG05_breakdowns": (agg05, AGG05), "AGG06_leave_one_out": (agg06, AGG06),
    "AGG07_protocol_fitness": (agg07, AGG07), "AGG08_fitness_scalar": (agg08, AGG08), "AGG09_critical_path": (agg09, AGG09), "AGG10_stage_cost": (agg10, AGG10), "AGG11_cost_per_correct": (agg11, AGG11), "AGG12_token_proxy": (agg12, AGG12),
    "AGG16_clusters": (agg16, AGG16), "AGG17_archive": (agg17, AGG17), "AGG18_shares": (agg18, AGG18), "AGG19_lens_scores": (agg19, AGG19), "AGG20_diagnostics": (agg20, AGG20), "AGG21_lens_survivors": (agg21, AGG21), "AGG22_conservation": (agg22, AGG22),
    "JOIN01_unknown_cases": (join01, JOIN01), "JOIN02_grid": (join02, JOIN02), "JOIN03_selected_attempt": (join03, JOIN03), "JOIN04_unique_match": (join04, JOIN04), "JOIN05_alignment": (join05, JOIN05), "JOIN06_paired_methods": (join06, JOIN06),
    "JOIN07_replicates": (join07, JOIN07), "JOIN08_challenge": (join08, JOIN08), "JOIN09_anti": (join09, JOIN09), "JOIN11_cells": (join11, JOIN11), "SNK04_case_matrix": (snk04, SNK04),
}
