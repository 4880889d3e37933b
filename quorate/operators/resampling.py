"""Bootstraps by class counts: cases that are equal in stratum and metrics are one class, and a replicate draws how many of each.

The counts of a replicate are multinomial. They come from binomial splits along a binary tree over a stratum's classes, so that work
grows with replicates and classes, not with cases. Classes of few cases are put into pools, in which cases are drawn one by one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.draws import BITS, let, unit, words
from quorate.operators.lineage import cut

#: A class of fewer cases goes to a pool; a pool has about so many cases.
HEAVY, POOL = 16, 2048
#: Up to so many trials are made one by one.
ONE_BY_ONE = 20
#: Rejection is used where so many of either outcome are expected; each try succeeds in more than 7 of 10 cases.
EXPECTED, REJECTIONS = 10, 64
#: With fewer expected, no more than so many come up (a chance below 1e-90).
WALK = 127
#: Replicates that meet a stratum's tree or a pool together, and splits or draws that are made at once (in the processor's cache).
PART, BLOCK = 1000, 1 << 16
#: Splits and draws of a task, about.
TASK_SPLITS, TASK_DRAWS = 1 << 21, 1 << 26
#: SplitMix64's step and multipliers.
GAMMA, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: ln k! less (k + 1/2) ln(k + 1) - (k + 1) + ln(2 pi) / 2, for k from 0 to 9.
FACTORIAL_RESTS = (0.08106146679532726, 0.04134069595540929, 0.02767792568499834, 0.02079067210376509, 0.01664469118982119, 0.01387612882307075, 0.01189670994589177, 0.01041126526197209, 0.009255462182712733, 0.008330563433362871)


def _rest(k: Column) -> Column:
    x = (k + 1).cast("double")
    series = (F.lit(1.0) / 12 - (F.lit(1.0) / 360 - F.lit(1.0) / 1260 / (x * x)) / (x * x)) / x
    return F.when(k < len(FACTORIAL_RESTS), F.get(F.array(*[F.lit(r) for r in FACTORIAL_RESTS]), k.cast("int"))).otherwise(series)


def _one_by_one(n: Column, p: Column, label: Sequence[Column]) -> Column:
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 2)), lambda j: F.struct(j.alias("j"), F.md5(F.concat_ws("|", *label, j).cast("binary")).alias("h")))
    word = lambda h, at: F.conv(F.substring(h, at, 13), 16, 10).cast("long")
    hit = lambda w: (unit(w) < p).cast("long")
    step = lambda s, x: s + hit(word(x["h"], 1)) + F.when(2 * x["j"] + 1 < n, hit(word(x["h"], 14))).otherwise(0)
    return F.aggregate(pairs, F.lit(0).cast("long"), step)


def _walked(n: Column, p: Column, label: Sequence[Column]) -> Column:
    u = unit(words(*label, F.lit("walk"))[0])
    first = F.exp(n * F.log1p(-p))
    start = F.struct(F.lit(0).cast("long").alias("k"), first.alias("pmf"), first.alias("cdf"), u.alias("u"))
    onward = lambda s: let(s["pmf"] * (n - s["k"]) / (s["k"] + 1) * (p / (1 - p)), lambda f: F.struct((s["k"] + 1).alias("k"), f.alias("pmf"), (s["cdf"] + f).alias("cdf"), s["u"].alias("u")))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(WALK).cast("long"))), start, lambda s, _: F.when(s["cdf"] > s["u"], s).otherwise(onward(s)), lambda s: s["k"])


def _refused(n: Column, p: Column, label: Sequence[Column]) -> Column:
    """Hormann's transformed rejection with squeeze (1993), for p up to a half."""
    spread = F.sqrt(n * p * (1 - p))
    b = 1.15 + 2.53 * spread
    fixed = F.struct(b.alias("b"), (-0.0873 + 0.0248 * b + 0.01 * p).alias("a"), (n * p + 0.5).alias("c"), (0.92 - 4.2 / b).alias("vr"), ((2.83 + 5.1 / b) * spread).alias("alpha"), F.floor((n + 1) * p).alias("m"), (p / (1 - p)).alias("r"))

    def tried(f: Column) -> Column:
        def accepted(x: Column) -> Column:
            k, us, v = x["k"], x["us"], x["v"]
            bound = (f["m"] + 0.5) * F.log((f["m"] + 1) / (f["r"] * (n - f["m"] + 1))) + (n + 1) * F.log((n - f["m"] + 1) / (n - k + 1)) + (k + 0.5) * F.log(f["r"] * (n - k + 1) / (k + 1))
            bound = bound + _rest(f["m"]) + _rest(n - f["m"]) - _rest(k) - _rest(n - k)
            good = F.when((us >= 0.07) & (v <= f["vr"]), True).when((k < 0) | (k > n), False).otherwise(F.log(v * f["alpha"] / (f["a"] / (us * us) + f["b"])) <= bound)
            return F.when(good, k)

        def attempt(i: Column) -> Column:
            digest = F.md5(F.concat_ws("|", *label, i).cast("binary"))
            half = lambda h, at: unit(F.conv(F.substring(h, at, 13), 16, 10).cast("long"))
            uv = lambda h: F.struct((half(h, 1) - 0.5).alias("u"), half(h, 14).alias("v"))
            placed = lambda w: let(F.lit(0.5) - F.abs(w["u"]), lambda us: F.struct(us.alias("us"), w["v"].alias("v"), F.floor((2 * f["a"] / us + f["b"]) * w["u"] + f["c"]).alias("k")))
            return let(digest, lambda h: let(uv(h), lambda w: let(placed(w), accepted)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(REJECTIONS - 1)), F.lit(None).cast("long"), lambda s, i: F.when(s.isNotNull(), s).otherwise(attempt(i)))

    return let(fixed, tried)


def binomial(n: Column, part: Column, whole: Column, *label: Column) -> Column:
    """A number of successes of n trials with a chance of part in whole, from digests of the label; n, part and whole are longs."""
    less = F.least(part, whole - part)
    p = less / whole.cast("double")
    k = F.when((n == 0) | (less == 0), F.lit(0).cast("long")).when(n <= ONE_BY_ONE, _one_by_one(n, p, label)).when(n * p < EXPECTED, _walked(n, p, label)).otherwise(_refused(n, p, label))
    return let(k, lambda x: F.when(part * 2 > whole, n - x).otherwise(x))


def items(cases: DataFrame, metrics: Sequence[str], stratum: str = "stratum") -> DataFrame:
    """(stratum, item, n, cells): a stratum's classes and pools by number, with their cases; cells are the metrics, a class having one cell.

    Heavy classes come first, by their metrics, then the pools. A pool's cells are in order of their metrics, as many as it has
    cases; which pool a light class goes to follows from the digest of its metrics.
    """
    kind = F.struct(*[F.col(m) for m in metrics])
    classes = cases.select(F.col(stratum).cast("string").alias("stratum"), kind.alias("cell")).groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    light = classes.where(F.col("n") < HEAVY)
    pools = light.groupBy(F.col("stratum").alias("of")).agg(F.ceil(F.sum("n") / POOL).alias("pools"))
    text = F.concat_ws("|", *[F.coalesce(F.col(f"cell.`{m}`").cast("string"), F.lit("")) for m in metrics])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") % F.col("pools")
    dealt = light.join(pools, F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", number.alias("pool"), "n", "cell")
    cells = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", "n"))), lambda x: F.array_repeat(x["cell"], x["n"].cast("int"))))
    pooled = dealt.groupBy("stratum", "pool").agg(F.sum("n").alias("n"), cells.alias("cells"))
    both = classes.where(F.col("n") >= HEAVY).select("stratum", F.lit(-1).cast("long").alias("pool"), "n", F.array("cell").alias("cells")).union(pooled)
    order = Window.partitionBy("stratum").orderBy("pool", F.col("cells")[0])  # over a stratum's items, a sixteenth of its cases at most
    return both.select("stratum", (F.row_number().over(order) - 1).cast("long").alias("item"), (F.col("pool") >= 0).alias("pool"), "n", "cells")


def _digests(labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two units a label from its MD5, as unit() makes them of words()."""
    whole = np.frombuffer(b"".join([hashlib.md5(x.encode(), usedforsecurity=False).digest() for x in labels]), ">u8").astype(np.uint64)
    high, low = whole[::2], whole[1::2]
    both = high >> np.uint64(12), ((high & np.uint64(0xFFF)) << np.uint64(40)) | (low >> np.uint64(24))
    return tuple((w.astype(np.float64) + 0.5) / float(1 << BITS) for w in both)


def _rests(k: np.ndarray) -> np.ndarray:
    x = (k + 1).astype(np.float64)
    series = (1.0 / 12 - (1.0 / 360 - 1.0 / 1260 / (x * x)) / (x * x)) / x
    return np.where(k < len(FACTORIAL_RESTS), np.array(FACTORIAL_RESTS)[np.clip(k, 0, len(FACTORIAL_RESTS) - 1)], series)


def binomials(n: np.ndarray, part: np.ndarray, whole: np.ndarray, label: Callable[[int], str]) -> np.ndarray:
    """binomial() of arrays: the same numbers, label(i) being the text of row i's label."""
    less = np.minimum(part, whole - part)
    p = less / whole.astype(np.float64)
    out = np.zeros(len(n), np.int64)
    some = (n > 0) & (less > 0)
    single = some & (n <= ONE_BY_ONE)
    walked = some & ~single & (n * p < EXPECTED)
    if single.any():
        at = np.flatnonzero(single)
        words_ = (n[at] + 1) // 2
        row, j = np.repeat(at, words_), np.arange(words_.sum()) - np.repeat(np.cumsum(words_) - words_, words_)
        one, two = _digests([f"{label(i)}|{x}" for i, x in zip(row.tolist(), j.tolist(), strict=True)])
        np.add.at(out, row, (one < p[row]).astype(np.int64) + ((two < p[row]) & (2 * j + 1 < n[row])))
    if walked.any():
        at = np.flatnonzero(walked)
        u, m, q = _digests([f"{label(i)}|walk" for i in at.tolist()])[0], n[at], p[at]
        pmf = np.exp(m * np.log1p(-q))
        cdf, k, odds = pmf.copy(), np.zeros(len(at), np.int64), q / (1 - q)
        for most in range(1, WALK + 1):
            on = np.flatnonzero((cdf <= u) & (m >= most))
            if not len(on):
                break
            pmf[on] = pmf[on] * (m[on] - k[on]) / (k[on] + 1) * odds[on]
            cdf[on] += pmf[on]
            k[on] += 1
        out[at] = k
    left = np.flatnonzero(some & ~single & ~walked)
    for attempt in itertools.count():
        if not len(left):
            break
        u, v = _digests([f"{label(i)}|{attempt}" for i in left.tolist()])
        k, good = _tried(n[left], p[left], u - 0.5, v)
        out[left[good]] = k[good]
        left = left[~good]
    return np.where(part * 2 > whole, n - out, out)


def _tried(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A try of _refused(), and whether it is taken."""
    spread = np.sqrt(n * p * (1 - p))
    b = 1.15 + 2.53 * spread
    a, alpha, m, r = -0.0873 + 0.0248 * b + 0.01 * p, (2.83 + 5.1 / b) * spread, np.floor((n + 1) * p).astype(np.int64), p / (1 - p)
    us = 0.5 - np.abs(u)
    k = np.floor((2 * a / us + b) * u + (n * p + 0.5)).astype(np.int64)
    good = (us >= 0.07) & (v <= 0.92 - 4.2 / b)
    at = np.flatnonzero(~good & (k >= 0) & (k <= n))
    n, k_, m, r = n[at], k[at], m[at], r[at]
    bound = (m + 0.5) * np.log((m + 1) / (r * (n - m + 1))) + (n + 1) * np.log((n - m + 1) / (n - k_ + 1)) + (k_ + 0.5) * np.log(r * (n - k_ + 1) / (k_ + 1))
    bound = bound + _rests(m) + _rests(n - m) - _rests(k_) - _rests(n - k_)
    good[at] = np.log(v[at] * alpha[at] / (a[at] / (us[at] * us[at]) + b[at])) <= bound
    return k, good


def _split(names: list[str], depth: int, replicates: int, seed: str):
    """A part's replicates of one stratum from its items (stratum, none, part, item, pool, n, metrics): a row with the sums over classes, and one for each pool that is met.

    Counts of as many replicates as a BLOCK allows go down the tree together, a level at a time.
    """

    def run(items_: pd.DataFrame) -> pd.DataFrame:
        items_ = items_.sort_values("item")
        stratum, none, part = items_.stratum.iloc[0], items_.none.iloc[0], int(items_.part.iloc[0])
        upto, pool = np.concatenate([[0], np.cumsum(items_.n.to_numpy())]), items_.pool.to_numpy()
        values = [items_[m].to_numpy()[~pool] for m in names]
        size, out = len(items_), []
        step = max(1, BLOCK // size)
        last = min(replicates, (part + 1) * PART)
        for first in range(part * PART, last, step):
            ids = np.arange(first, min(first + step, last))
            k = np.full((len(ids), 1), upto[-1])
            for level in range(depth):
                below = depth - level - 1
                node = np.arange(k.shape[1])
                start, middle, end = (upto[np.minimum(x << below, size)] for x in (2 * node, 2 * node + 1, 2 * node + 2))
                row, at = np.nonzero(k)
                named, nodes, own = ids[row].tolist(), at.tolist(), f"|{stratum}|{level}|"
                x = binomials(k[row, at], (middle - start)[at], (end - start)[at], lambda i: f"{seed}|{named[i]}{own}{nodes[i]}")  # noqa: B023
                kids = np.zeros((len(ids), 2 * k.shape[1]), np.int64)
                kids[row, 2 * at], kids[row, 2 * at + 1] = x, k[row, at] - x
                k = kids[:, : ((size - 1) >> below) + 1]
            if not pool.all():
                heavy = k[:, ~pool]
                out.append(pd.DataFrame({"replicate": ids, "item": -1, "k": heavy.sum(1), **{m: heavy @ v for m, v in zip(names, values, strict=True)}}))
            row, at = np.nonzero(k * pool)
            out.append(pd.DataFrame({"replicate": ids[row], "item": items_.item.to_numpy()[at], "k": k[row, at], **{m: np.zeros(len(row), v.dtype) for m, v in zip(names, values, strict=True)}}))
        return pd.concat(out).assign(stratum=stratum, none=none, part=part)[["stratum", "none", "part", "replicate", "item", "k", *names]]

    return run


def mixed(base: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first counts[i] words, of 52 bits, of the stream that SplitMix64 makes of base[i], one stream after the other."""
    starts = np.cumsum(counts) - counts
    z = np.repeat(base.astype(np.uint64) - starts.astype(np.uint64) * np.uint64(GAMMA), counts)
    z += np.arange(1, len(z) + 1, dtype=np.uint64) * np.uint64(GAMMA)
    t = z >> np.uint64(30)
    z ^= t
    z *= np.uint64(MIX[0])
    z ^= np.right_shift(z, np.uint64(27), out=t)
    z *= np.uint64(MIX[1])
    z ^= np.right_shift(z, np.uint64(31), out=t)
    z >>= np.uint64(12)
    return z


def _drawn(names: list[str]):
    """Sums over the cells that replicates (replicate, base, k) draw from one pool, BLOCK draws at a time."""

    def run(rows: pd.DataFrame, pools: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["replicate", "base", "k"]].reset_index(drop=True)
        cells = [np.asarray(pools[c].iloc[0]) for c in names]
        out, k = [np.zeros(len(rows), c.dtype) for c in cells], rows.k.to_numpy()
        upto, at = np.cumsum(k), 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
            n = k[at:to]
            starts = np.cumsum(n) - n
            place, many = mixed(rows.base.to_numpy()[at:to], n), np.uint64(len(cells[0]))
            place -= place // many * many  # numpy divides by one number faster than it takes remainders
            for o, c in zip(out, cells, strict=True):
                o[at:to] = np.add.reduceat(c.take(place.view(np.int64)), starts)  # every k is above 0
            at = to
        return rows[["replicate", "k"]].assign(**dict(zip(names, out, strict=True)))

    return run


def bootstrap(cases: DataFrame, metrics: Sequence[str], replicates: int, seed: str = "", stratum: str = "stratum") -> DataFrame:
    """Means of each metric per replicate; all metrics of a replicate share its draws, and strata keep their sizes.

    Null metrics add nothing to a sum, but their cases count. An empty table gives no row. Strata and pools meet the replicates in
    PARTS of them: a task has the sizes of a stratum's items, or a pool, and the numbers of a part's replicates. Of classes only
    their sums leave a task, a row a replicate and stratum.
    """
    found = cut(items(cases, metrics, stratum)).withColumns({"none": F.col("stratum").isNull(), "stratum": F.coalesce("stratum", F.lit(""))})
    spark, kinds, names = cases.sparkSession, [_summed(cases, m) for m in metrics], [f"m{i}" for i in range(len(metrics))]
    size = found.agg(F.max("item").alias("most"), F.count("*").alias("items"), F.coalesce(F.sum(F.when(F.col("pool"), F.col("n"))), F.lit(0)).alias("light")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = lambda work, of: max(least, -(-work * replicates // of))
    value = lambda c, m, kind: F.coalesce(c[m], F.lit(0)).cast(kind)
    picked = lambda m, kind: lambda c: value(c, m, kind)
    typed = list(zip(metrics, kinds, names, strict=True))
    own = ", ".join(["replicate int", "k long", *[f"{n} {kind}" for n, kind in zip(names, kinds, strict=True)]])
    parts = -(-replicates // PART)
    each = F.explode(F.sequence(F.lit(0), F.lit(max(0, parts - 1)))).alias("part")
    # numbers of parts are given, as Spark would put these few bytes into few tasks, whatever work they make
    shares = found.select("stratum", "none", "item", "pool", "n", *[F.when(~F.col("pool"), value(F.col("cells")[0], m, kind)).otherwise(F.lit(0).cast(kind)).alias(n) for m, kind, n in typed], each)
    strata = ["stratum", "none", "part"]
    split = _split(names, max(1, (size.most or 0).bit_length()), replicates, seed)
    k = cut(shares.repartition(tasks(size["items"], TASK_SPLITS), *strata).groupBy(*strata).applyInPandas(split, f"stratum string, none boolean, part int, replicate int, item long, {own.partition(', ')[2]}"))
    pools = found.where("pool").select("stratum", "none", "item", *[F.transform("cells", picked(m, kind)).alias(n) for m, kind, n in typed], each)
    ask = k.where("item >= 0").select("stratum", "none", "item", "replicate", "k", "part", words(F.lit(seed), "replicate", "stratum", F.lit("pool"), "item")[0].alias("base"))
    keys, many = ["stratum", "none", "item", "part"], tasks(size.light, TASK_DRAWS)
    single = ask.repartition(many, *keys).groupBy(*keys).cogroup(pools.repartition(many, *keys).groupBy(*keys)).applyInPandas(_drawn(names), own)
    whole = k.where("item < 0").select("replicate", "k", *names)
    return whole.union(single).groupBy("replicate").agg(*[(F.sum(n) / F.sum("k")).alias(m) for n, m in zip(names, metrics, strict=True)])


def _summed(cases: DataFrame, metric: str) -> str:
    return "double" if dict(cases.dtypes)[metric] in ("double", "float") else "long"


def binomial_sql(rows: str, splits: str, seed: str) -> str:
    """CTE tree (replicate, stratum, level, node, k, attempt) in DuckDB, as _split() makes it; rows names (replicate, stratum, k), splits (stratum, level, node, part, whole)."""
    w = lambda at, *label: f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(label)})), {at}, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"
    label = (f"'{seed}'", "replicate", "stratum", "level", "node")
    rests = ", ".join(f"{x}::DOUBLE" for x in FACTORIAL_RESTS)
    rest = lambda k: f"(CASE WHEN {k} < {len(FACTORIAL_RESTS)} THEN ([{rests}])[CAST({k} AS BIGINT) + 1] ELSE (1.0::DOUBLE / 12 - (1.0::DOUBLE / 360 - 1.0::DOUBLE / 1260 / ((({k}) + 1)::DOUBLE * (({k}) + 1))) / ((({k}) + 1)::DOUBLE * (({k}) + 1))) / (({k}) + 1) END)"
    bound = f"(m + 0.5::DOUBLE) * ln((m + 1) / (r * (k - m + 1))) + (k + 1) * ln((k - m + 1) / (k - q + 1)::DOUBLE) + (q + 0.5::DOUBLE) * ln(r * (k - q + 1) / (q + 1)) + {rest('m')} + {rest('(k - m)')} - {rest('q')} - {rest('(k - q)')}"
    pmf = "list_transform(range(128), lambda j: CASE WHEN j <= k THEN exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + j * ln(p) + (k - j) * ln(1 - p)) ELSE 0 END)"
    return f"""tree(replicate, stratum, level, node, k, attempt) AS (
  SELECT replicate, stratum, 0, 0::BIGINT, k, 0 FROM {rows}
  UNION ALL
  SELECT replicate, stratum, y.level, y.node, y.k, y.attempt FROM (
    SELECT replicate, stratum, unnest(CASE WHEN x IS NULL THEN [{{'level': level, 'node': node, 'k': k, 'attempt': attempt + 1}}]
        ELSE [{{'level': level + 1, 'node': node * 2, 'k': CASE WHEN turned THEN k - x ELSE x END, 'attempt': 0}}, {{'level': level + 1, 'node': node * 2 + 1, 'k': CASE WHEN turned THEN x ELSE k - x END, 'attempt': 0}}] END) AS y
    FROM (
      SELECT *, CASE way WHEN 0 THEN 0::BIGINT
        WHEN 1 THEN CAST(list_sum(list_transform(range(k), lambda j: CASE WHEN (CAST('0x' || substr(md5(concat_ws('|', {', '.join(label)}, j // 2)), 1 + 13 * (j % 2), 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE < p THEN 1 ELSE 0 END)) AS BIGINT)
        WHEN 2 THEN (list_transform([{pmf}], lambda f: len(list_filter(range(least(k, {WALK})), lambda j: list_sum(f[1:j + 1]) <= {w(1, *label, "'walk'")}))))[1]
        ELSE CASE WHEN us >= 0.07 AND v <= 0.92::DOUBLE - 4.2::DOUBLE / b THEN q WHEN q < 0 OR q > k THEN NULL
             WHEN ln(v * ((2.83::DOUBLE + 5.1::DOUBLE / b) * spread) / (a / (us * us) + b)) <= {bound} THEN q END END AS x
      FROM (
        SELECT *, CAST(floor((2 * a / us + b) * u + (k * p + 0.5::DOUBLE)) AS BIGINT) AS q FROM (
          SELECT *, 0.5::DOUBLE - abs(u) AS us, -0.0873::DOUBLE + 0.0248::DOUBLE * b + 0.01::DOUBLE * p AS a FROM (
            SELECT *, 1.15::DOUBLE + 2.53::DOUBLE * spread AS b, {w(1, *label, "attempt")} - 0.5::DOUBLE AS u, {w(14, *label, "attempt")} AS v,
                   CAST(floor((k + 1) * p) AS BIGINT) AS m, p / (1 - p) AS r, CASE WHEN k = 0 OR p = 0 THEN 0 WHEN k <= {ONE_BY_ONE} THEN 1 WHEN k * p < {EXPECTED} THEN 2 ELSE 3 END AS way FROM (
              SELECT t.*, least(part, whole - part) / whole::DOUBLE AS p, part * 2 > whole AS turned, sqrt(t.k * (least(part, whole - part) / whole::DOUBLE) * (1 - least(part, whole - part) / whole::DOUBLE)) AS spread
              FROM tree t JOIN {splits} s ON s.stratum = t.stratum AND s.level = t.level AND s.node = t.node))))))
  WHERE y.k > 0)"""


def pool_sql(rows: str, seed: str) -> str:
    """(replicate, stratum, pool, pos) of all draws from pools in DuckDB; rows names (replicate, stratum, item, pool, n, k)."""
    wrap = f"{(1 << 64) - 1}::UHUGEINT"
    turn = lambda z, bits, by: f"((xor({z}, {z} >> {bits}) * {by}::UHUGEINT) & {wrap})"
    return f"""SELECT replicate, stratum, pool, CAST((xor(z, z >> 31) >> 12) % n AS BIGINT) AS pos FROM (
  SELECT * REPLACE ({turn('z', 27, MIX[1])} AS z) FROM (
    SELECT * REPLACE ({turn('z', 30, MIX[0])} AS z) FROM (
      SELECT replicate, stratum, pool, n, (base::UHUGEINT + (j + 1)::UHUGEINT * {GAMMA}::UHUGEINT) & {wrap} AS z FROM (
        SELECT *, unnest(range(k)) AS j FROM (SELECT *, CAST('0x' || substr(md5(concat_ws('|', '{seed}', replicate, stratum, 'pool', item)), 1, 13) AS BIGINT) AS base FROM {rows} WHERE pool >= 0)))))"""
