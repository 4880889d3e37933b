"""Queries and operators over whole tables and large counts, against brute force on the driver."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quorate.operators import graphs, stats
from quorate.plans import scores as score_plans
from quorate.plans import searches as search_plans
from quorate.plans import stats as stat_plans
from quorate.plans import texts as text_plans
from quorate.plans.fixtures import ledger, read, truth

SMALL = "/root/testdata/sf0.01"


def test_mcnemar_of_large_counts(spark):
    cases = [(25, 122), (241, 1263), (220, 37), (0, 1000), (0, 5000), (1, 1100), (16, 15), (1000, 1100), (1200, 1200)]
    got = spark.createDataFrame(cases, "a long, b long").select("a", "b", stats.mcnemar(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        want = stats.binomial_two_sided(min(r.a, r.b), r.a + r.b)
        assert math.isclose(r.p, want, rel_tol=1e-9, abs_tol=1e-300), (r, want)


def test_mcnemar_queries_count_all_discordant_cases(spark):
    p = {r.test: (r.p, stats.binomial_two_sided(min(r.only_a, r.only_b), r.only_a + r.only_b)) for r in stat_plans.stat08(spark, SMALL).collect()}
    assert all(abs(a - b) <= 1e-9 for a, b in p.values()), p
    assert {r.test: r.p for r in stat_plans.stat09(spark, SMALL).collect()} == {t: a for t, (a, _) in p.items()}
    for r in stat_plans.stat12(spark, SMALL).collect():
        assert abs(r.p - stats.binomial_two_sided(min(r.wins, r.losses), r.wins + r.losses)) <= 1e-9, r


def test_chain_schedule_equals_driver(spark):
    for lengths in ([3, 3, 7, 1, 2, 5, 7, 9, 20], [1, 4], [2, 2, 2, 2, 2], [5, 6, 7, 8], [1, 1, 1, 1, 1, 6, 6, 6]):
        jobs = [(f"{g}-{t}", f"g{g}") for g, n in enumerate(lengths) for t in range(n)]
        edges = [(f"{g}-{t}", f"{g}-{t - 1}") for g, n in enumerate(lengths) for t in range(1, n)]
        order = graphs.fair_schedule(jobs, edges)
        batch = graphs.batches(order, edges, 4)
        got = graphs.chain_schedule(spark.createDataFrame(jobs, "job string, group string"), spark.createDataFrame(edges, "job string, needs string"), 4).collect()
        assert sorted(map(tuple, got)) == sorted((j, i, batch[j]) for i, j in enumerate(order)), lengths
    for bad in ([("a", "b"), ("b", "a")], [("b", "a"), ("c", "a")], [("b", "x")]):
        with pytest.raises(ValueError):
            graphs.chain_schedule(spark.createDataFrame([(x, "g") for x in "abc"], "job string, group string"), spark.createDataFrame(bad, "job string, needs string"), 4)


def test_schedule_of_all_conversations(spark):
    jobs, edges = [(r.job, str(r.conv_id)) for r in text_plans.jobs(spark, SMALL).collect()], [tuple(r) for r in text_plans.edges(spark, SMALL).collect()]
    order = graphs.fair_schedule(jobs, edges)
    batch = graphs.batches(order, edges, 4)
    assert sorted(map(tuple, text_plans.dag01(spark, SMALL).collect())) == sorted((j, i, batch[j]) for i, j in enumerate(order))


def test_reconcile_all_customers_and_attempts(spark):
    valid = {r.job_id for r in ledger(spark, SMALL).where("status = 'valid_output'").collect()}
    results = {r.c_custkey for r in read(spark, SMALL, "customer").collect()}
    want = {(k, "result_without_attempt") for k in results - valid} | {(k, "attempt_without_result") for k in valid - results} | {(k, "digest_differs") for k in results & valid if k % 10 == 0}
    got = [(r.job_id, r.problem) for r in search_plans.aud12(spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want


def test_cells_count_all_cases(spark):
    want = Counter((r.family, r.tier) for r in truth(spark, SMALL).where("block = '1-URGENT'").collect())
    got = {(r.family, r.tier): r.cases for r in score_plans.join11(spark, SMALL).collect()}
    assert {k: n for k, n in got.items() if n} == dict(want)
