"""Bootstraps by class counts and random numbers from digests: laws against exact probabilities."""

import math
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from quorate.functions import draws
from quorate.operators import resampling, stats

ROUNDS = 20_000


def pmf(n, p, k):
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def far(observed, expected, n):
    """Chi-square statistic over cells of 5 or more expected, the others put together, and how many cells there are."""
    cells, rest = [], [0, 0.0]
    for k, e in expected.items():
        if n * e >= 5:
            cells.append((observed.get(k, 0), n * e))
        else:
            rest[0], rest[1] = rest[0] + observed.get(k, 0), rest[1] + n * e
    rest[0] += sum(c for k, c in observed.items() if k not in expected)
    if rest[1] >= 5:
        cells.append(tuple(rest))
    else:
        assert rest[0] <= 25
    return sum((o - e) ** 2 / e for o, e in cells), len(cells)


@pytest.mark.parametrize(("n", "part", "whole"), [(7, 1, 3), (20, 9, 10), (50, 1, 20), (2000, 1, 1000), (300, 99, 100), (64, 1, 2), (400, 2, 7), (1_000_000, 3, 5)])
def test_binomial_law(spark, n, part, whole):
    got = spark.range(ROUNDS).select(resampling.binomial(F.lit(n).cast("long"), F.lit(part).cast("long"), F.lit(whole).cast("long"), F.lit("law"), F.col("id")).alias("k")).groupBy("k").count()
    seen = {r.k: r["count"] for r in got.collect()}
    p, sd = part / whole, math.sqrt(n * part / whole * (1 - part / whole))
    assert sum(seen.values()) == ROUNDS
    width = max(1, int(sd / 5))  # neighbouring numbers in one cell where there are many
    cell = lambda k: k // width
    want = Counter()
    for k in range(max(0, int(n * p - 9 * sd - 9)), min(n, int(n * p + 9 * sd + 9)) + 1):
        want[cell(k)] += pmf(n, p, k)
    chi, cells = far(Counter({c: sum(v for k, v in seen.items() if cell(k) == c) for c in {cell(k) for k in seen}}), want, ROUNDS)
    assert chi < cells + 5 * math.sqrt(2 * cells), (chi, cells)


def test_binomial_ends(spark):
    rows = spark.createDataFrame([(0, 1, 2), (5, 0, 3), (5, 3, 3), (10**9, 1, 10**9)], "n long, part long, whole long")
    got = [r[0] for r in rows.select(resampling.binomial(F.col("n"), F.col("part"), F.col("whole"), F.lit("ends"))).collect()]
    assert got[:3] == [0, 0, 5] and 0 <= got[3] < 40


@pytest.mark.parametrize("heavy", [1, 100])
def test_replicates_follow_the_enumeration(spark, monkeypatch, heavy):
    """All samples of two strata of 3 and 2 cases, by classes and by pools."""
    monkeypatch.setattr(resampling, "HEAVY", heavy)
    cases = [("x", 0, 1.5), ("x", 0, 1.5), ("x", 2, -1.0), ("y", 1, None), ("y", 5, 0.25)]
    df = spark.createDataFrame(cases, "stratum string, a long, n double")
    got = Counter(tuple(round(v, 9) for v in r) for r in resampling.bootstrap(df, ["a", "n"], ROUNDS, "law").select("a", "n").collect())
    want = Counter()
    x, y = cases[:3], cases[3:]
    for pick in product(x, x, x, y, y):
        want[round(sum(c[1] for c in pick) / 5, 9), round(sum(c[2] or 0 for c in pick) / 5, 9)] += 1 / (27 * 4)
    chi, cells = far(got, want, ROUNDS)
    assert sum(got.values()) == ROUNDS and chi < cells + 5 * math.sqrt(2 * cells), (chi, cells)


def test_replicates_of_many_cases(spark):
    """One stratum of classes of all sizes: means and spread of a million cases' bootstrap."""
    df = spark.range(1_000_000).select(F.lit("all").alias("stratum"), F.when(F.col("id") < 300, F.col("id")).otherwise(F.col("id") % 3).alias("v"))
    m, v = df.agg(F.avg("v"), F.var_pop("v")).first()
    got = resampling.bootstrap(df, ["v"], 500, "many").agg(F.avg("v"), F.stddev("v"), F.count("*")).first()
    sd = math.sqrt(v / 1e6)
    assert abs(got[0] - m) < 5 * sd / math.sqrt(500) and 0.85 < got[1] / sd < 1.15 and got[2] == 500


def test_bootstrap_of_nothing(spark):
    none = spark.createDataFrame([], "stratum string, a long")
    assert resampling.bootstrap(none, ["a"], 10, "none").count() == 0
    one = spark.createDataFrame([(None, 4)], "stratum string, a long")
    assert [r.a for r in resampling.bootstrap(one, ["a"], 3, "one").collect()] == [4.0] * 3
    assert stats.REPLICATES == 50_000


def test_numbers_below(spark):
    for n in (1, 2, 7, 1000, (1 << 40) - 3):
        got = [r[0] for r in spark.range(4000).select(draws.below(F.lit(n).cast("long"), F.lit("numbers"), F.col("id"))).collect()]
        assert 0 <= min(got) and max(got) < n
        assert abs(sum(got) / len(got) - (n - 1) / 2) <= 5 * n / math.sqrt(12 * len(got))
    seen = Counter(r[0] for r in spark.range(9000).select(draws.choice(["a", "b", "c"], F.lit("choice"), F.col("id"))).collect())
    assert set(seen) == {"a", "b", "c"} and all(2800 < c < 3200 for c in seen.values())
