"""Schedules of job graphs with fan-in, against the heap on the driver."""

import hashlib
import random

import pytest

from quorate.operators import graphs
from quorate.plans import texts


def random_graph(rng, groups, sizes, dense):
    jobs, edges = [], []
    for g in range(groups):
        names = [f"{g}-{i}" for i in range(rng.choice(sizes))]
        jobs += [(x, f"g{g}") for x in names]
        chain = g % 3 == 0
        edges += [(x, y) for i, x in enumerate(names) for j, y in enumerate(names[:i]) if (j == i - 1 if chain else rng.random() < dense)]
    return jobs, edges


def scheduled(spark, jobs, edges, most, seed=None):
    return graphs.schedule(spark.createDataFrame(jobs, "job string, group string"), spark.createDataFrame(edges, "job string, needs string"), most, seed)


@pytest.mark.parametrize(("groups", "most"), [(12, 5), (3, 5), (1, 4)])
def test_schedule_equals_the_heap(spark, groups, most):
    jobs, edges = random_graph(random.Random(groups), groups, [1, 3, 7, 15], 0.25)
    order = graphs.fair_schedule(jobs, edges)
    batch = graphs.batches(order, edges, most)
    got = {r.job: (r.place, r.batch) for r in scheduled(spark, jobs, edges + edges[:3], most).collect()}
    assert got == {j: (i, batch[j]) for i, j in enumerate(order)}


def test_two_proposers_and_a_critic(spark):
    jobs, edges = [("p1", "g"), ("p2", "g"), ("c", "g")], [("c", "p1"), ("c", "p2")]
    got = {r.job: (r.turn, r.batch) for r in scheduled(spark, jobs, edges, 10).collect()}
    assert got["c"] == (2, 1) and got["p1"][1] == got["p2"][1] == 0
    with_seed = [r.job for r in scheduled(spark, jobs, edges, 10, "2025").orderBy("place").collect()]
    assert with_seed == sorted(["p1", "p2"], key=lambda j: __import__("hashlib").sha256(f"2025\0call\0{j}".encode()).hexdigest()) + ["c"]


@pytest.mark.parametrize(
    ("jobs", "edges", "what"),
    [
        ([("a", "g"), ("a", "g")], [], "repeated"),
        ([("a", "g")], [("a", "b")], "unknown"),
        ([("a", "g")], [("b", "a")], "unknown"),
        ([("a", "g"), ("b", "h")], [("b", "a")], "another group"),
        ([("a", "g"), ("b", "g"), ("c", "g")], [("a", "b"), ("b", "c"), ("c", "a")], "cycle"),
    ],
)
def test_graphs_that_have_no_schedule(spark, jobs, edges, what):
    with pytest.raises(ValueError, match=what):
        scheduled(spark, jobs, edges, 3)


def test_schedule_of_nothing(spark):
    assert scheduled(spark, [], [], 3).count() == 0


def test_cycles(spark):
    rng = random.Random(3)
    for n, m in ((12, 16), (30, 40), (8, 30)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(a, b) for a, b in pairs}
        while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
            reach |= more
        want = {f"{a:02}": f"{min(b for b in range(n) if (a, b) in reach and (b, a) in reach):02}" for a in range(n) if (a, a) in reach}
        got = graphs.cycles(spark.createDataFrame([(f"{a:02}", f"{b:02}") for a, b in pairs], "job string, needs string")).collect()
        assert {r.job: r.cycle for r in got} == want
    assert graphs.cycles(spark.createDataFrame([], "job string, needs string")).count() == 0


def nested(spark, jobs, edges):
    groups = {}
    for job, g in jobs:
        groups.setdefault(g, []).append((job, sorted({x for j, x in edges if j == job})))
    return spark.createDataFrame(list(groups.items()), "group string, rows array<struct<job string, needs array<string>>>")


def test_groups_that_lie_together_equal_the_heap(spark):
    jobs, edges = random_graph(random.Random(5), 40, [1, 2, 3, 7, 15], 0.3)
    jobs, edges = jobs + [("late", "h"), ("a", "h"), ("b", "h")], edges + [("a", "late"), ("b", "late"), ("b", "a")]
    got = graphs.places(graphs.turns_of(nested(spark, jobs, edges))).collect()
    assert [r.job for r in sorted(got, key=lambda r: r.place)] == graphs.fair_schedule(jobs, edges)
    assert sorted(r.place for r in got) == list(range(len(jobs)))
    for wrong in ([("a", "g"), ("a", "g")], []), ([("a", "g"), ("b", "h")], [("b", "a")]), ([("a", "g")], [("a", "a")]), ([("a", "g"), ("b", "g")], [("a", "b"), ("b", "a")]):
        with pytest.raises(ValueError, match="a cycle, a repeated job"):
            graphs.turns_of(nested(spark, *wrong))
    assert graphs.turns_of(nested(spark, [], [])).count() == 0


def test_places_are_counted_in_parts_that_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(graphs, "TASK_ROWS", 300, raising=False)
    jobs = [(f"{g}-{i}", f"{g}") for g in range(1000) for i in range(1 + g % 5)]
    out = graphs.places(spark.createDataFrame([(j, g, int(j.split("-")[1])) for j, g in jobs], "job string, group string, turn int"))
    assert out.rdd.getNumPartitions() == 10  # 3,000 jobs; in 4 parts before
    want = sorted(jobs, key=lambda x: (int(x[0].split("-")[1]), hashlib.sha256(x[1].encode()).hexdigest()))
    assert [r.job for r in out.orderBy("place").collect()] == [j for j, _ in want]


def test_groups_are_split_from_long_chains_by_size_alone(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MOST_JOBS", 6)
    seen = []
    monkeypatch.setattr(graphs, "depths", lambda edges, jobs, own=graphs.depths: seen.append(jobs.select("group").distinct().count()) or own(edges, jobs))
    chain = lambda g, n: ([(f"{g}{i}", g) for i in range(n)], [(f"{g}{i}", f"{g}{i - 1}") for i in range(1, n)])
    long, short, fan = chain("l", 9), chain("s", 6), ([("f1", "f"), ("f2", "f"), ("f3", "f")], [("f3", "f1"), ("f3", "f2")])
    jobs, edges = long[0] + short[0] + fan[0], long[1] + short[1] + fan[1]
    order = [r.job for r in scheduled(spark, jobs, edges, 3).orderBy("place").collect()]
    assert order == graphs.fair_schedule(jobs, edges) and seen == [1]  # the short chain needs no rounds
    order = [r.job for r in scheduled(spark, *short, 3).orderBy("place").collect()]
    assert order == [j for j, _ in short[0]] and seen == [1]
    for more, what in ([("l8", "l0")], "no chain"), ([("l0", "x")], "unknown"), ([("x", "l0")], "unknown"), ([("l0", "f1")], "another group"), ([("f1", "l0")], "another group"):
        with pytest.raises(ValueError, match=what):
            scheduled(spark, jobs, edges + more, 3)
    with pytest.raises(ValueError, match="repeated"):
        scheduled(spark, jobs + [("l3", "l")], edges, 3)
    with pytest.raises(ValueError, match="no chain"):
        scheduled(spark, long[0], long[1] + [("l0", "l8")], 3)


def test_order_lines_are_shuffled_once(spark):
    plan = texts.order_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
