"""Paired statistics: percentiles, exact tests and corrections; bootstraps are in resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.operators.lineage import cut

#: Replicates of a bootstrap and random sign patterns, unless the caller asks for other numbers.
REPLICATES, FLIPS = 50_000, 100_000
#: Words of a round that are counted together, and words of a task, about.
PLACES, TASK_WORDS = 256, 1 << 22


def floor_percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the sorted value at floor((n - 1) p), counted from 0, for each named p; nulls do not count.

    Values are counted first, so that a window runs over a group's distinct values and no group is collected.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    n = F.sum("c").over(Window.partitionBy(by))
    placed = counts.select(by, value, upto.alias("upto"), n.alias("n"))
    return placed.groupBy(by).agg(*[F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p), F.col(value))).alias(name) for name, p in shares.items()])


def interval(distribution: DataFrame, metric: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """The linear-interpolation percentiles at both ends of the level."""
    a = (1 - level) / 2
    return distribution.groupBy(*by).agg(F.percentile(metric, F.lit(a)).alias("low"), F.percentile(metric, F.lit(1 - a)).alias("high"))


#: What ln(n!) has beyond Stirling's formula, exactly for small n; a series gives it for larger ones.
_STIRLING = [0.0, *(math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16))]


def _stirling_rest(n: Column) -> Column:
    series = 1 / (12 * n) - 1 / (360 * F.pow(n, F.lit(3))) + 1 / (1260 * F.pow(n, F.lit(5))) - 1 / (1680 * F.pow(n, F.lit(7)))
    return F.when(n < len(_STIRLING), F.get(F.array(*[F.lit(x) for x in _STIRLING]), n.cast("int"))).otherwise(series)


def mcnemar(only_left: Column, only_right: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the binomial tail at one half, at most 1; 1 without any.

    The log of the tail's largest term, at the smaller count k, comes from Stirling's formula and its rest; the others follow
    downwards as ratios to it. The ratio j terms below is exp(-j^2 / (n + 1)) at most, so that 7.1 sqrt(n + 1) of them hold all
    that a double can tell.
    """
    n, k = (only_left + only_right).cast("double"), F.least(only_left, only_right).cast("double")
    away = (n - 2 * k) / n
    spread = n / 2 * ((1 - away) * F.log1p(-away) + (1 + away) * F.log1p(away))
    top = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - spread + F.log(n / (2 * math.pi * k * (n - k))) / 2
    top = F.when(k == 0, -n * math.log(2)).otherwise(top)
    below = F.least(k, F.ceil(7.1 * F.sqrt(n + 1))).cast("long")
    step = lambda s, j: F.struct((s["term"] * (k - j) / (n - k + 1 + j)).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    ratios = F.aggregate(F.sequence(F.lit(0).cast("long"), below), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(top + F.log(ratios))))


def holm(tests: DataFrame, p: str = "p", key: str = "test") -> DataFrame:
    """Step-down adjusted p: the running maximum of (m - rank) p, at most 1; ties by key. One row per test."""
    w = Window.orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    ranked = tests.withColumn("raw", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return ranked.withColumn("adjusted", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("raw")


def sign_flip_exact(differences: DataFrame, value: str = "diff", order: str = "case_id") -> DataFrame:
    """p of the sum's size over all 2^n sign patterns of the nonzero differences; n is to be 20 at most."""
    own = differences.where(F.col(value) != 0).select(order, value)
    if own.limit(21).count() > 20:
        raise ValueError("more than 20 nonzero differences: use sign_flip_sampled")
    n = [r[1] for r in sorted(own.collect())]
    spark = differences.sparkSession
    total = abs(sum(n))
    flips = spark.range(1 << len(n))
    signed = sum((F.when((F.shiftright("id", i) % 2) == 1, float(-x)).otherwise(float(x)) for i, x in enumerate(n)), F.lit(0.0))
    return flips.agg(F.count("*").alias("patterns"), (F.count_if(F.abs(signed) >= total - 1e-12) / F.count("*")).alias("p"))


def sign_flip_sampled(differences: DataFrame, rounds: int = FLIPS, seed: str = "", value: str = "diff") -> DataFrame:
    """p from random sign patterns, (extreme + 1) / (rounds + 1).

    Differences of equal size are one class, and a round needs only how many of a class change sign: so many bits of MD5
    words of seed, round, size and place are counted, 60 differences a word. PLACES words of a thousand rounds are counted
    together, so that a thousand rows of them leave a task.
    """
    spark = differences.sparkSession
    sizes = differences.where(F.col(value) != 0).groupBy(F.abs(value).cast("double").alias("size")).agg(F.count("*").alias("n"), F.sum(F.signum(value)).cast("long").alias("net"))
    sizes = cut(sizes.withColumn("text", F.round("size", 6).cast("decimal(38,6)").cast("string")).withColumn("last", F.ceil(F.col("n") / 60) - 1))
    made = sizes.agg(F.coalesce(F.sum(F.col("last") + 1), F.lit(0))).first()[0] * rounds
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made // TASK_WORDS))  # given, as Spark would put these few bytes into few tasks
    runs = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / PLACES))).alias("run")).select("*", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // 1000))).alias("part"))
    each = runs.repartition(tasks, "size", "run", "part").select("*", F.explode(F.sequence(F.col("part") * 1000, F.least(F.col("part") * 1000 + 999, F.lit(rounds - 1)))).alias("round"))
    each = each.select("*", F.explode(F.sequence(F.col("run") * PLACES, F.least((F.col("run") + 1) * PLACES - 1, F.col("last")))).alias("place"))
    word = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "round", "text", "place").cast("binary")), 1, 15), 16, 10).cast("long")
    kept = F.when(F.col("n") - F.col("place") * 60 < 60, F.expr("shiftleft(1L, cast(n - place * 60 as int)) - 1")).otherwise(F.lit((1 << 60) - 1))
    ones = each.groupBy("round", "size").agg(F.sum(F.bit_count(word.bitwiseAND(kept))).alias("ones"), F.first("n").alias("n"), F.first("net").alias("net"))
    sums = ones.groupBy("round").agg(F.abs(F.sum(F.col("size") * (F.col("n") - 2 * F.col("ones")))).alias("s"), F.abs(F.sum(F.col("size") * F.col("net"))).alias("t"))
    none = spark.range(1).select(F.lit(rounds).cast("long").alias("rounds"))
    got = sums.agg(F.count_if(F.col("s") >= F.col("t") - 1e-9).alias("extreme"), F.count("*").alias("made"))
    return none.crossJoin(got).select("rounds", F.when(F.col("made") == 0, 1.0).otherwise((F.col("extreme") + 1) / (F.col("rounds") + 1)).alias("p"))  # one row each


def classification(low: Column, high: Column, low90: Column, high90: Column, margin: float = 0.10) -> Column:
    """superior if the 95 % interval is beyond 0, equivalent if the 90 % interval lies within the margin, else inconclusive."""
    return F.when((low > 0) | (high < 0), "superior").when((low90 >= -margin) & (high90 <= margin), "equivalent").otherwise("inconclusive")


def contrasts(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per pair of columns right minus left: mean difference, wins, losses and ties."""
    rows = F.explode(F.array(*[F.struct(F.lit(f"{b}-{a}").alias("contrast"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")) for a, b in pairs])).alias("x")
    long = wide.select(rows).select("x.*")
    return long.groupBy("contrast").agg((F.sum(F.col("b") - F.col("a")) / F.count("*")).alias("estimate"), F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("b") == F.col("a")).alias("ties"))


def checks(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(name, passed) per rule over a one-row frame, and `all`."""
    pairs = [F.struct(F.lit(n).alias("name"), F.coalesce(r, F.lit(False)).alias("passed")) for n, r in rules.items()]
    every = F.lit(True)
    for r in rules.values():
        every &= F.coalesce(r, F.lit(False))
    return row.select(F.explode(F.array(*pairs, F.struct(F.lit("all").alias("name"), every.alias("passed")))).alias("x")).select("x.*")


def block_sensitivity(blocks: DataFrame, value: str = "diff") -> DataFrame:
    """From one row per block (block, n, diff): whether leaving a block out turns the sign, one block holds 75 % of the net, blocks spread by 30 points."""
    s = blocks.agg(F.sum(value).alias("net"), F.sum("n").alias("n"), F.max(F.col(value) / F.col("n")).alias("hi"), F.min(F.col(value) / F.col("n")).alias("lo"), F.max(F.abs(value)).alias("most"), F.collect_list(value).alias("each"))
    turned = F.exists("each", lambda x: (F.col("net") - x) * F.col("net") < 0)
    return s.select(turned.alias("direction_changes"), (F.col("most") >= 0.75 * F.abs("net")).alias("concentrated"), (F.col("hi") - F.col("lo") >= 0.30).alias("wide_spread"))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(b / a) of positive costs, else null."""
    return F.when((a > 0) & (b > 0), F.log(b / a))


def binomial_two_sided(k: int, n: int) -> float:
    """The exact value that mcnemar() approximates, for tests and small counts on the driver."""
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)
