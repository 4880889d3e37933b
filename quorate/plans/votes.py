"""Votes and decisions over the order panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorate.operators import decisions, scores, votes
from quorate.plans.fixtures import PANEL, SMALL, TRUTH, panel, plurality_sql, small_panel, truth

WEIGHTS = {"proposer": 1, "critic": 2, "verifier": 3}
BIG = "CASE role WHEN 'proposer' THEN 1 WHEN 'critic' THEN 2 WHEN 'verifier' THEN 3 ELSE 1 END"


def text(c: str = "answer"):
    return F.array_join(c, "|").alias(c)


def _ranked(measures: str, order: str, columns: str, source: str = "panel", answer: str = "answer") -> str:
    return f"""WITH {PANEL},
t AS (SELECT case_id, {answer} AS answer, count(*) AS votes, {measures} FROM {source} GROUP BY case_id, {answer}),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, {order}) AS r FROM t)
SELECT case_id, array_to_string(answer, '|') AS answer, votes, {columns} FROM r WHERE r = 1"""


def vote01(s, d):
    return votes.by_total_confidence(panel(s, d)).select("case_id", text(), "votes", F.col("conf_sum").cast("double").alias("conf_sum"), "lead_slot", "confidence")


VOTE01 = _ranked("sum(confidence) AS cs, arg_min(slot, -confidence * 1000000 + slot) AS lead_slot", "cs DESC, answer", "CAST(cs AS DOUBLE) AS conf_sum, lead_slot, CAST(cs AS DOUBLE) / votes AS confidence")


def vote02(s, d):
    p = panel(s, d).drop("answer").withColumnRenamed("digits", "answer")
    return votes.by_total_and_median(p).select("case_id", text(), "votes", "votes_cast", F.col("conf_sum").cast("double").alias("conf_sum"), F.round("conf_median", 9).alias("conf_median"))


VOTE02 = f"""WITH {PANEL},
t AS (SELECT case_id, digits AS answer, count(*) AS votes, sum(confidence) AS cs, quantile_cont(CAST(confidence AS DOUBLE), 0.5) AS md FROM panel GROUP BY case_id, digits),
r AS (SELECT *, sum(votes) OVER (PARTITION BY case_id) AS vc, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, cs DESC, md DESC, CAST(answer AS BIGINT[])) AS r FROM t)
SELECT case_id, array_to_string(answer, '|') AS answer, votes, CAST(vc AS BIGINT) AS votes_cast, CAST(cs AS DOUBLE) AS conf_sum, round(md, 9) AS conf_median FROM r WHERE r = 1"""


def vote03(s, d):
    p = panel(s, d).drop("answer").withColumnRenamed("digits", "answer")
    return votes.by_total_and_median(p, exact=True).select("case_id", text(), "votes", F.col("conf_median").cast("double").alias("conf_median"))


VOTE03 = f"""WITH {PANEL},
l AS (SELECT case_id, digits AS answer, sum(confidence) AS cs, list(confidence ORDER BY confidence) AS v FROM panel GROUP BY case_id, digits),
t AS (SELECT *, len(v) AS votes, v[(len(v) + 1) // 2] + v[(len(v) + 2) // 2] AS md2 FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, cs DESC, md2 DESC, CAST(answer AS BIGINT[])) AS r FROM t)
SELECT case_id, array_to_string(answer, '|') AS answer, votes, CAST(md2 AS DOUBLE) / 2 AS conf_median FROM r WHERE r = 1"""


def vote04(s, d):
    return votes.by_mean_confidence(panel(s, d)).select("case_id", text(), "votes", "conf_mean", "unique_answers")


VOTE04 = f"WITH {PANEL}, {plurality_sql('panel', 'v')} SELECT case_id, array_to_string(answer, '|') AS answer, votes, conf_mean, unique_answers FROM v"


def vote05(s, d):
    return votes.by_weight(panel(s, d), votes.role_weight(WEIGHTS)).select("case_id", text(), "votes", "weight", "conf_mean")


def _weighted(weight: str) -> str:
    return f"""WITH {PANEL},
t AS (SELECT case_id, answer, count(*) AS votes, CAST(sum({weight}) AS BIGINT) AS weight, CAST(sum(greatest(least(confidence, 1), 0)) AS DOUBLE) / count(*) AS conf_mean FROM panel GROUP BY case_id, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, votes DESC, conf_mean DESC, answer) AS r FROM t)
SELECT case_id, array_to_string(answer, '|') AS answer, votes, weight, conf_mean FROM r WHERE r = 1"""


VOTE05 = _weighted(BIG)


def vote06(s, d):
    return votes.by_weight(panel(s, d), F.col("holdout_terms").cast("long")).select("case_id", text(), "votes", "weight", "conf_mean")


VOTE06 = _weighted("holdout_terms")


def vote07(s, d):
    return votes.by_depth(panel(s, d)).select("case_id", text(), "votes", "depth_sum", "depth_max", "depths", "stages")


VOTE07 = f"""WITH {PANEL},
t AS (SELECT case_id, answer, count(*) AS votes, CAST(sum(holdout_terms) AS BIGINT) AS depth_sum, max(holdout_terms) AS depth_max, count(DISTINCT holdout_terms) AS depths, count(DISTINCT stage) AS stages FROM panel GROUP BY case_id, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY depth_sum DESC, depth_max DESC, depths DESC, stages DESC, votes DESC, answer) AS r FROM t)
SELECT case_id, array_to_string(answer, '|') AS answer, votes, depth_sum, depth_max, depths, stages FROM r WHERE r = 1"""


def vote08(s, d):
    return votes.by_support(panel(s, d), "l_suppkey").select("case_id", text(), "votes", "support", "conf_mean")


VOTE08 = f"""WITH {PANEL},
t AS (SELECT case_id, answer, count(*) AS votes, count(DISTINCT l_suppkey) AS support, CAST(sum(confidence) AS DOUBLE) / count(*) AS conf_mean FROM panel GROUP BY case_id, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY support DESC, conf_mean DESC, answer) AS r FROM t)
SELECT case_id, array_to_string(answer, '|') AS answer, votes, support, conf_mean FROM r WHERE r = 1"""


def vote09(s, d):
    return votes.fixed_slots(panel(s, d), 4).select("case_id", "complete", text(), "votes")


VOTE09 = f"""WITH {PANEL}, {plurality_sql('panel', 'v', 'slot BETWEEN 1 AND 4')},
c AS (SELECT case_id, count(*) = 4 AND count(DISTINCT slot) = 4 AS complete FROM panel WHERE slot BETWEEN 1 AND 4 GROUP BY case_id)
SELECT case_id, complete, CASE WHEN complete THEN array_to_string(answer, '|') END AS answer, CASE WHEN complete THEN votes END AS votes FROM c LEFT JOIN v USING (case_id)"""


def vote10(s, d):
    return votes.expected(scores.score_records(panel(s, d), truth(s, d)))


VOTE10 = f"""WITH {PANEL}, {TRUTH}
SELECT case_id, sum(CASE WHEN answer = truth THEN 1.0::DOUBLE ELSE 0 END) / count(*) AS exact_mean, 1.0::DOUBLE AS format_valid_mean,
       sum(CASE WHEN answer[1] = truth[1] THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN answer[2] = truth[2] THEN 1 ELSE 0 END) / (2 * count(*)) AS term_accuracy
FROM panel JOIN truth USING (case_id) GROUP BY case_id"""


def _decision(system):
    def query(s, d):
        return decisions.decide(small_panel(s, d), system).select("case_id", text("plurality"), text(), "gate_open", "override")

    query.__name__ = f"decide_{system}"
    return query


def _same(role: str, n: int) -> str:
    return f"(count(*) FILTER (role = '{role}') = {n} AND count(DISTINCT answer) FILTER (role = '{role}') = 1)"


def _decision_sql(gate: str, agreed: str, any_of: str = "") -> str:
    return f"""WITH {SMALL}, {plurality_sql('small', 'v', "role = 'proposer'")},
g AS (SELECT case_id, {gate} AS ok, {agreed} AS agreed{any_of} FROM small GROUP BY case_id),
x AS (SELECT g.case_id, v.answer AS plurality, CASE WHEN coalesce(ok, true) THEN agreed ELSE v.answer END AS answer, ok FROM g LEFT JOIN v ON g.case_id = v.case_id)
SELECT case_id, array_to_string(plurality, '|') AS plurality, array_to_string(answer, '|') AS answer, ok AS gate_open, answer IS DISTINCT FROM plurality AS override FROM x"""


_min = "min(answer) FILTER (role = '{}')".format
DEC = {
    "judge": _decision_sql("NULL::BOOLEAN", "arg_min(answer, slot) FILTER (role = 'judge')"),
    "gated": _decision_sql(f"coalesce({_same('critic', 2)} AND {_same('judge', 1)} AND {_min('critic')} = {_min('judge')}, false)", _min("critic")),
    "dual": _decision_sql(f"coalesce({_same('judge', 2)}, false)", _min("judge")),
    "verified": _decision_sql(f"coalesce({_same('verifier', 2)} AND {_same('judge', 1)} AND {_min('verifier')} = {_min('judge')}, false)", _min("verifier")),
    "deliberative": _decision_sql(f"coalesce({_same('judge', 2)} AND list_contains(list(answer) FILTER (role = 'critic'), {_min('judge')}), false)", _min("judge")),
}


def dec06(s, d):
    got = decisions.agreement_gate(small_panel(s, d), ["proposer"], ["verifier", "judge"], 1, ["critic"], 1)
    return got.select("case_id", text(), "gate_open", "agree", "support")


DEC06 = f"""WITH {SMALL}, {plurality_sql('small', 'b', "role = 'proposer'")}, {plurality_sql('small', 'w', "role IN ('verifier', 'judge')")},
u AS (SELECT case_id, answer, count(*) AS support FROM small WHERE role = 'critic' GROUP BY case_id, answer),
x AS (
  SELECT c.case_id, b.answer AS plurality, w.answer AS wanted, coalesce(w.votes, 0) AS agree, coalesce(u.support, 0) AS support
  FROM (SELECT DISTINCT case_id FROM small) c LEFT JOIN b ON c.case_id = b.case_id LEFT JOIN w ON c.case_id = w.case_id LEFT JOIN u ON u.case_id = c.case_id AND u.answer = w.answer)
SELECT case_id, array_to_string(CASE WHEN wanted IS NOT NULL AND agree >= 1 AND support >= 1 THEN wanted ELSE plurality END, '|') AS answer,
       wanted IS NOT NULL AND agree >= 1 AND support >= 1 AS gate_open, agree, support FROM x"""


def dec07(s, d):
    p = small_panel(s, d)
    w = votes.by_weight(p, votes.role_weight(WEIGHTS)).select("case_id", F.array_join("answer", "|").alias("weighted"))
    b = votes.by_mean_confidence(p.where("role = 'proposer'")).select("case_id", F.array_join("answer", "|").alias("base"))
    return w.join(b, "case_id", "left")


DEC07 = f"""WITH {SMALL}, {plurality_sql('small', 'b', "role = 'proposer'")},
t AS (SELECT case_id, answer, count(*) AS votes, sum({BIG}) AS weight, CAST(sum(greatest(least(confidence, 1), 0)) AS DOUBLE) / count(*) AS cm FROM small GROUP BY case_id, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, votes DESC, cm DESC, answer) AS r FROM t)
SELECT r.case_id, array_to_string(r.answer, '|') AS weighted, array_to_string(b.answer, '|') AS base FROM r LEFT JOIN b ON r.case_id = b.case_id WHERE r = 1"""


def dec08(s, d):
    p = panel(s, d).select("case_id", "answer", F.when(F.col("confidence") >= 0.09, True).alias("is_final_output"), F.col("stage").alias("stage_index"), F.col("slot").alias("job_id"))
    return decisions.final_pick(p).select("case_id", text(), "job_id")


DEC08 = f"""WITH {PANEL},
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN confidence >= 0.09 THEN 0 ELSE 1 END, stage DESC, slot) AS r FROM panel)
SELECT case_id, array_to_string(answer, '|') AS answer, slot AS job_id FROM r WHERE r = 1"""


def dec09(s, d):
    return decisions.overrides(decisions.decide(small_panel(s, d), "judge"), truth(s, d))


DEC09 = f"""WITH {SMALL}, {TRUTH}, {plurality_sql('small', 'v', "role = 'proposer'")},
g AS (SELECT case_id, arg_min(answer, slot) FILTER (role = 'judge') AS answer FROM small GROUP BY case_id),
x AS (SELECT g.case_id, v.answer AS p, g.answer AS a, truth FROM g LEFT JOIN v ON g.case_id = v.case_id JOIN truth t ON t.case_id = g.case_id)
SELECT case_id, a IS DISTINCT FROM p AS override, coalesce(p <> truth, true) AND coalesce(a = truth, false) AS useful, coalesce(p = truth, false) AND coalesce(a <> truth, true) AS harmful FROM x"""

QUERIES = {
    "VOTE01_total_confidence": (vote01, VOTE01), "VOTE02_median_numeric": (vote02, VOTE02), "VOTE03_exact_decimal": (vote03, VOTE03), "VOTE04_mean_plurality": (vote04, VOTE04),
    "VOTE05_role_weighted": (vote05, VOTE05), "VOTE06_field_weighted": (vote06, VOTE06), "VOTE07_length_weighted": (vote07, VOTE07), "VOTE08_distinct_support": (vote08, VOTE08),
    "VOTE09_fixed_slots": (vote09, VOTE09), "VOTE10_direct_expected": (vote10, VOTE10),
    "DEC01_judge": (_decision("judge"), DEC["judge"]), "DEC02_gated": (_decision("gated"), DEC["gated"]), "DEC03_dual": (_decision("dual"), DEC["dual"]),
    "DEC04_verified": (_decision("verified"), DEC["verified"]), "DEC05_deliberative": (_decision("deliberative"), DEC["deliberative"]),
    "DEC06_agreement_gate": (dec06, DEC06), "DEC07_weighted_and_base": (dec07, DEC07), "DEC08_final_pick": (dec08, DEC08), "DEC09_overrides": (dec09, DEC09),
}
