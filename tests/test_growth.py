"""Steps whose work is to grow no faster than their input."""

import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quorate.functions import scalars
from quorate.operators import documents, evolution, lineage, resampling, scores, stats, strategies
from quorate.plans import fixtures, ranks


def shown(df):
    """The optimized plan, as explain() prints it."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fit_binomial_makes_each_row_of_differences_once(spark):
    rows = [(1, [1, 3, 7, 13, 21, 31]), (2, [1, 3, 7, 13, 21, 32]), (3, [5, 5]), (4, [2, 4, 8, 14]), (5, [None, 1, 2, 3]), (6, None)]
    df = spark.createDataFrame(rows, "id int, vals array<long>")
    got = {r.id: r.c for r in df.select("id", scalars.fit_binomial(F.col("vals"), 2).alias("c")).collect()}
    assert got == {1: [1, 2, 2], 2: None, 3: None, 4: [2, 2, 2], 5: None, 6: None}
    assert shown(df.select(scalars.fit_binomial(F.col("vals"), 5).alias("c"))).count("vals#") <= 4


def test_panels_and_truths_are_dealt_in_parts_of_bounded_rows(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(lineage, "TASK_ROWS", 500)
    assert fixtures.panel(spark, d).rdd.getNumPartitions() == 12  # 6,000 lines
    assert "REPARTITION_BY_NUM" in ranks.set04(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert ranks.set04(spark, d).where("kind = 'missing'").select("id").distinct().count() == duckdb.sql(f"SELECT count(*) FROM '{d}/orders.parquet' WHERE o_orderkey % 11 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM '{d}/lineitem.parquet')").fetchall()[0][0]


def test_parts_of_panels_are_scored_before_they_leave_their_case(spark):
    votes = spark.createDataFrame([(c, m, ["R" if (c + m) % 3 else "N", "F"], 0.5) for c in range(40) for m in range(4)], "case_id long, member int, answer array<string>, confidence double").withColumn("confidence", F.col("confidence").cast("decimal(12,4)"))
    t = spark.createDataFrame([(c, ["R", "F"], "b") for c in range(40)], "case_id long, truth array<string>, block string")
    table = evolution.submask_votes(votes, t)
    assert "Generate" not in shown(table)  # no row a case and part is sorted or dealt out
    assert {(r.present, r.own): (r.cases, r.exact, r.terms) for r in table.collect()}[(15, 15)] == (40, 26, 66)


def test_sets_meet_cases_without_being_sorted(spark):
    votes = spark.createDataFrame([(1, m, ["R", "F"]) for m in range(12)] + [(2, 39, ["N", "F"])], "case_id long, member int, answer array<string>").withColumn("confidence", F.lit("0.5").cast("decimal(12,4)"))
    t = spark.createDataFrame([(1, ["R", "F"], "b"), (2, ["R", "F"], "c")], "case_id long, truth array<string>, block string")
    out = evolution.set_scores(votes, t, spark.createDataFrame([(3, 2), ((1 << 39) | 1, 2)], "subset long, size int"))
    assert "RepartitionByExpression" not in shown(out)
    assert {(r.subset, r.block): (r.exact, r.terms) for r in out.collect()} == {(3, "b"): (1, 2), (3, "c"): (0, 0), ((1 << 39) | 1, "b"): (1, 2), ((1 << 39) | 1, "c"): (0, 1)}


def test_splits_of_arrays_are_those_of_columns(spark):
    cases = [(0, 1, 2), (5, 0, 3), (5, 3, 3), (1, 1, 2), (7, 1, 3), (20, 9, 10), (50, 1, 20), (2000, 1, 1000), (300, 99, 100), (64, 1, 2), (400, 2, 7), (1_000_000, 3, 5), (10**9, 1, 10**9)] * 40
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, n long, part long, whole long")
    want = [r.k for r in rows.select("i", resampling.binomial(F.col("n"), F.col("part"), F.col("whole"), F.lit("seed"), F.col("i")).alias("k")).orderBy("i").collect()]
    assert resampling.binomials(*np.array(cases).T, lambda i: f"seed|{i}").tolist() == want


def test_replicates_meet_pools_in_as_many_tasks_as_their_draws_need(spark, monkeypatch):
    monkeypatch.setattr(resampling, "TASK_DRAWS", 10_000, raising=False)
    cases = spark.range(900).select(F.lit("all").alias("stratum"), F.when(F.col("id") < 300, F.col("id")).otherwise(F.col("id") % 20).alias("v"))
    out = resampling.bootstrap(cases, ["v"], 300, "tasks")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and ", 9)" in plan  # 300 light cases x 300 draws
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan  # no row a replicate and class is joined
    assert out.count() == 300


def test_sign_flips_are_counted_in_as_many_tasks_as_their_words_need(spark, monkeypatch):
    monkeypatch.setattr(stats, "TASK_WORDS", 5000, raising=False)
    monkeypatch.setattr(stats, "PLACES", 3, raising=False)
    cases = spark.range(1000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("diff"))
    out = stats.sign_flip_sampled(cases, 2500, "seed")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 9)" in plan  # 17 words x 2500 rounds
    word = lambda r, at: int(hashlib.md5(f"seed|{r}|1.000000|{at}".encode()).hexdigest()[:15], 16)
    ones = lambda r: sum((word(r, at) & ((1 << min(60, 1000 - 60 * at)) - 1)).bit_count() for at in range(17))
    want = sum(abs(1000 - 2 * ones(r)) >= 332 for r in range(2500))
    assert out.first().p == (want + 1) / 2501


def test_documents_are_checked_in_as_many_tasks_as_they_need(spark, monkeypatch):
    own = []
    monkeypatch.setattr(documents, "TASK_DOCUMENTS", 25, raising=False)
    monkeypatch.setattr(strategies, "TASK_DOCUMENTS", 25, raising=False)
    for module in (documents, strategies):
        monkeypatch.setattr(module, "cut", lambda df: own.append(lineage.cut(df).rdd.getNumPartitions()) or lineage.cut(df))
    rows = spark.range(100).repartition(1).select(F.col("id").alias("doc"), F.try_parse_json(F.lit('{"strategy_id":"","stages":[],"selector":{"mode":"base_plurality"}}')).alias("value"))
    got = strategies.strategy_errors(rows, spark.createDataFrame([("l1",)], "lens_id string")).groupBy("error").count().collect()
    assert {r.error: r["count"] for r in got} == {"$.strategy_id: minLength": 100, "$.strategy_id: repeated": 99, "$.stages: minItems": 100, "$.stages: no proposer": 100}
    assert min(own) == 4
    own.clear()
    assert documents.check(rows, {"type": "object", "properties": {"strategy_id": {"minLength": 1}}}).count() == 100
    assert own[-1] == 4


def test_archives_count_distinct_ones_without_dealing_records_out_again(spark):
    rows = spark.createDataFrame([(1, "a", 1, 7, 0, "judge"), (1, "a", 1, 8, 0, "critic"), (1, "a", None, 8, 2, "judge"), (1, "b", 2, None, 1, "proposer"), (2, "a", None, None, None, "verifier")], "part long, answer string, job long, strategy long, lens int, role string")
    out = scores.archive(rows.withColumn("confidence", F.lit("0.5").cast("decimal(12,4)")).repartition(3, "part"), "part", "job", "strategy", "lens")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan
    assert {(r.part, r.answer): tuple(r)[2:] for r in out.collect()} == {(1, "a"): (1, 2, 2, 0, 1, 0, 2, 0.5, 0.5, "0,2"), (1, "b"): (1, 0, 1, 1, 0, 0, 0, 0.5, 0.5, "1"), (2, "a"): (0, 0, 0, 0, 0, 1, 0, 0.5, 0.5, "")}


def test_panels_of_a_race_make_their_candidates_once(spark, monkeypatch):
    rows = [(c, a, [float(c % 5 if a == "x" else 2), 1.0], (a == "x") == (c % 2 == 0), f"f{c % 2}") for c in range(300) for a in ("x", "y")]
    candidates = spark.createDataFrame(rows, "case_id long, answer string, features array<double>, right boolean, family string")
    made, patterns = [], evolution.patterns
    monkeypatch.setattr(evolution, "patterns", lambda *args: made.append(args) or patterns(*args))
    got = {r.policy: r for r in evolution.halving(candidates, evolution.policies(spark, 2), "case_id", ((0.3, 8), (0.6, 4)), ["family"]).collect()}
    assert len(made) == 1
    of = lambda c: int(hashlib.md5(str(c).encode()).hexdigest()[:8], 16) % 1000
    assert {(r.cases, r.holdout_cases) for r in got.values()} == {(sum(of(c) < 600 for c in range(300)), sum(of(c) >= 600 for c in range(300)))}
    for p, r in got.items():
        w = (p % 4, p // 4 % 4)
        right = [(w[0] * (c % 5) + w[1] >= w[0] * 2 + w[1]) == (c % 2 == 0) for c in range(300)]
        assert (r.exact, r.holdout_exact) == (sum(x for c, x in enumerate(right) if of(c) < 600), sum(x for c, x in enumerate(right) if of(c) >= 600))
