"""Whole-number sequences as column expressions: eight families, their recognition from a prefix, and how hard they are.

Terms are BIGINT; every family is an aggregate over the term numbers, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.scalars import differences, fit_binomial

#: Multipliers that recurrences may have.
MULTIPLIERS = (-3, -2, -1, 1, 2, 3)


def _numbers(first: int, last: Column | int) -> Column:
    last = F.lit(last) if isinstance(last, int) else last
    return F.filter(F.sequence(F.lit(first), F.greatest(last.cast("int"), F.lit(first))), lambda n: n <= last)


def binomial(c: Column, x: Column) -> Column:
    """Sum of c_j times x over j for a small x, as BIGINT."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("term"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, a: Column) -> Column:
        more = F.call_function("div", s["term"] * (x - s["j"]), s["j"] + 1)
        return F.struct((s["sum"] + a * s["term"]).alias("sum"), more.alias("term"), (s["j"] + 1).alias("j"))

    return F.aggregate(c, start, step, lambda s: s["sum"])


def poly(c: Column, count: int) -> Column:
    """a_n = B_c(n - 1)."""
    return F.transform(_numbers(0, count - 1), lambda n: binomial(c, n.cast("long")))


def _grow(seeds: Column, first: int, count: int, term) -> Column:
    """Appends term(out, n) for n from first to count."""
    return F.aggregate(_numbers(first, count), seeds, lambda out, n: F.array_append(out, term(out, n)))


def _at(list_: Column, i: Column) -> Column:
    return F.get(list_, i.cast("int"))


def pdelta(seed: Column, c: Column, count: int) -> Column:
    """Differences by turns are binomial polynomials of the cycle; c holds one list of coefficients per phase."""
    p = F.size(c)
    return _grow(F.array(seed), 2, count, lambda out, n: F.element_at(out, -1) + binomial(_at(c, (n - 2) % p), F.floor((n - 2) / p)))


def affine(seed: Column, m: Column, b: Column, count: int) -> Column:
    """a_n = m_r a_(n-1) + b_r by turns."""
    return _grow(F.array(seed), 2, count, lambda out, n: _at(m, (n - 2) % F.size(m)) * F.element_at(out, -1) + _at(b, (n - 2) % F.size(m)))


def lin2(seeds: Column, u: Column, v: Column, b: Column, count: int) -> Column:
    """a_n = u a_(n-1) + v a_(n-2) + b_r by turns, after two seeds."""
    return _grow(seeds, 3, count, lambda out, n: u * F.element_at(out, -1) + v * F.element_at(out, -2) + _at(b, (n - 3) % F.size(b)))


def lagpoly(seeds: Column, c: Column, count: int, lag: int) -> Column:
    """Each of `lag` strands grows by a binomial polynomial of its cycle."""
    return _grow(seeds, lag + 1, count, lambda out, n: _at(out, n - lag - 1) + binomial(_at(c, (n - 1) % lag), F.floor((n - 1) / lag) - 1))


def interleave(strands: Sequence[Column], count: int) -> Column:
    """Terms of the strands by turns."""
    every = F.array(*strands)
    return F.transform(_numbers(1, count), lambda n: F.get(_at(every, (n - 1) % len(strands)), F.floor((n - 1) / len(strands)).cast("int")))


def growblock(l0: Column, v: Column, d: Column, count: int) -> Column:
    """Block j has l0 + j terms V(j) + t D(j)."""
    block = lambda j: F.transform(F.sequence(F.lit(0).cast("long"), l0 + j - 1), lambda t: binomial(v, j) + t * binomial(d, j))
    return F.slice(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")), block)), 1, count)


def modaffine(seed: Column, m: Column, b: Column, modulus: Column, count: int) -> Column:
    """a_n = (m_r a_(n-1) + b_r) mod M by turns."""
    return _grow(F.array(seed), 2, count, lambda out, n: F.pmod(_at(m, (n - 2) % F.size(m)) * F.element_at(out, -1) + _at(b, (n - 2) % F.size(m)), modulus))


def poly_degree(values: Column, least: int = 2, most: int = 5) -> Column:
    """The lowest degree whose binomial polynomial meets all values, or null."""
    return F.coalesce(*[F.when(fit_binomial(values, d).isNotNull(), F.lit(d)) for d in range(least, most + 1)])


def affine_programs(values: Column) -> Column:
    """All (m, b) with a_n = m a_(n-1) + b for the whole prefix and m one of MULTIPLIERS."""
    tails = F.slice(values, F.lit(2), F.size(values) - 1)
    heads = F.slice(values, F.lit(1), F.size(values) - 1)
    bias = lambda m: F.array_distinct(F.zip_with(tails, heads, lambda a, b: a - m * b))
    one = lambda m: F.when(F.size(bias(F.lit(m))) == 1, F.struct(F.lit(m).alias("m"), F.get(bias(F.lit(m)), F.lit(0)).alias("b")))
    return F.array_compact(F.array(*[one(m) for m in MULTIPLIERS]))


def period_degree(values: Column, pairs: Sequence[tuple[int, int]] = ((2, 0), (2, 1), (3, 1), (3, 2))) -> Column:
    """The first (period, degree) at which differences by turns are binomial polynomials of that degree, as text, or null."""
    d = differences(values)
    phase = lambda p, r: F.transform(F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda i: i % p == r), lambda i: F.get(d, i))
    fits = lambda p, k: [fit_binomial(phase(p, r), k).isNotNull() for r in range(p)]
    out = []
    for p, k in pairs:
        every = F.lit(True)
        for f in fits(p, k):
            every &= f
        out.append(F.when(every, F.lit(f"{p},{k}")))
    return F.coalesce(*out)


def poly_tier(degree: Column) -> Column:
    """1 up to degree 3, 2 for 4, else 3."""
    return F.when(degree <= 3, 1).when(degree == 4, 2).otherwise(3)


def longest_run(values: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.cast("long").alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(values, start, step, lambda s: s["best"])
