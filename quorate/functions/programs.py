"""Programs of eight sequence families: evaluated, placed in tiers and held against bounds, as column expressions; recognisers finds them from a prefix.

A program is a struct of one type for all families: `family`; `shape`, its sizes; `seeds`, its first terms; `rows`, its lists of
coefficients. POLY has (degree) and one row; PDELTA (period, degree), a seed and a row a phase; AFFINE (period), a seed, multipliers
and biases; LIN2 (period), two seeds, the two weights and biases; LAGPOLY (lag, degree), a seed and a row a strand; INTERLEAVE
(strands, then each strand's degree, or 0 for an affine one), a seed and a row a strand; GROWBLOCK (first length, two degrees) and
two rows; MODAFFINE (period, modulus), a seed, multipliers and biases. Terms are BIGINT and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions import sequences

# Fixed values of the families.
FAMILIES = ("POLY", "PDELTA", "AFFINE", "LIN2", "LAGPOLY", "INTERLEAVE", "GROWBLOCK", "MODAFFINE")
MULTIPLIERS = (-3, -2, -1, 2, 3)
WEIGHTS = (-2, -1, 1, 2)
STRAND_MULTIPLIERS = (-2, -1, 2)
PRIMES = tuple(p for p in range(19, 128) if all(p % d for d in range(2, 12)))
PDELTA_SHAPES = ((2, 0), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2))
LAGPOLY_SHAPES = ((2, 0), (2, 1), (3, 1), (3, 2), (4, 1))
MOST_SEED, MOST_COEFFICIENT = 30, 9
VISIBLE_MOST, TARGET_MOST = 10**9, 10**12

TYPE = "struct<family: string, shape: array<bigint>, seeds: array<bigint>, rows: array<array<bigint>>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def longs(*values) -> Column:
    return F.array(*[F.lit(v).cast("bigint") if isinstance(v, int) else v.cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


def program(family: str, shape: Column, seeds: Column, rows: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), shape.alias("shape"), seeds.alias("seeds"), rows.alias("rows")).cast(TYPE)


def steps(last: Column | int) -> Column:
    """0 to last - 1."""
    last = F.lit(last) if isinstance(last, int) else last
    return F.filter(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: i < last)


def phase(values: Column, period: int, r: Column | int) -> Column:
    return F.filter(values, lambda _, i: i % period == r)


def bounded(values: Column, most: int) -> Column:
    return F.forall(values, lambda v: F.abs(v) <= most)


def led(c: Column) -> Column:
    """Whether a polynomial's coefficients are within bounds: the first as a seed, the others as coefficients."""
    return (F.abs(F.get(c, F.lit(0))) <= MOST_SEED) & bounded(F.slice(c, 2, F.size(c)), MOST_COEFFICIENT)


def several(rows: Column) -> Column:
    return F.size(F.array_distinct(rows)) > 1


def strand_terms(kind: Column, seed: Column, row: Column, count: int) -> Column:
    get = lambda i: F.array(F.get(row, F.lit(i)))
    return F.when(kind > 0, sequences.poly(row, count)).otherwise(sequences.affine(seed, get(0), get(1), count))


def evaluate_family(family: str, p: Column, count: int) -> Column:
    """The first `count` terms of a program of that family."""
    shape = lambda i: F.get(p["shape"], F.lit(i))
    row = lambda i: F.get(p["rows"], F.lit(i))
    weight = lambda i: F.get(row(0), F.lit(i))
    seed = F.get(p["seeds"], F.lit(0))
    if family == "LAGPOLY":
        return F.coalesce(*[F.when(shape(0) == lag, sequences.lagpoly(p["seeds"], p["rows"], count, lag)) for lag in (2, 3, 4)])
    if family == "INTERLEAVE":
        strands = F.transform(F.slice(p["shape"], 2, 3), lambda kind, i: strand_terms(kind, F.get(p["seeds"], i), F.get(p["rows"], i), (count + 1) // 2))
        return let(strands, lambda s: F.transform(steps(count), lambda n: F.get(F.get(s, (n % shape(0)).cast("int")), F.floor(n / shape(0)).cast("int"))))
    return {
        "POLY": lambda: sequences.poly(row(0), count), "PDELTA": lambda: sequences.pdelta(seed, p["rows"], count), "AFFINE": lambda: sequences.affine(seed, row(0), row(1), count),
        "LIN2": lambda: sequences.lin2(p["seeds"], weight(0), weight(1), row(1), count), "GROWBLOCK": lambda: sequences.growblock(shape(0), row(0), row(1), count),
        "MODAFFINE": lambda: sequences.modaffine(seed, row(0), row(1), shape(1), count),
    }[family]()


def evaluate(p: Column, count: int) -> Column:
    """The first `count` terms of a program of any family."""
    return F.coalesce(*[F.when(p["family"] == name, evaluate_family(name, p, count)) for name in FAMILIES])


def tier(p: Column) -> Column:
    """The lowest tier, 1 to 3, that has such a program."""
    a, b = F.get(p["shape"], F.lit(0)), F.get(p["shape"], F.lit(1))
    degree = F.array_max(F.slice(p["shape"], 2, 3))
    middle = lambda first: F.when(first, 1).when((b == 1) & (a <= 3), 2).otherwise(3)
    by_family = {
        "POLY": sequences.poly_tier(a), "PDELTA": middle((a == 2) & (b == 0)), "AFFINE": a.cast("int"), "LIN2": a.cast("int"), "LAGPOLY": middle((a == 2) & (b == 0)),
        "INTERLEAVE": F.when(degree > 2, 3).when(a == 2, 1).otherwise(2), "GROWBLOCK": b.cast("int"), "MODAFFINE": F.when((a == 1) & (b <= 43), 1).when((a == 1) | (b < 53), 2).otherwise(3),
    }
    return F.coalesce(*[F.when(p["family"] == name, t) for name, t in by_family.items()])


def in_bounds(p: Column, terms: Column, visible: Column, targets: int = 5) -> Column:
    """Whether a program whose terms are given, visible + targets of them at least, makes a fair case: terms within bounds, six different ones at least,
    no run above three (but in blocks), no jump by more than four digits (but modulo), and modulo two wraps and no term twice."""

    def judged(v: Column) -> Column:
        seen, hidden = F.slice(v, F.lit(1), visible), F.slice(v, visible + 1, F.lit(targets))
        digits = F.transform(v, lambda y: F.length(F.abs(y).cast("string")))
        jumps = F.exists(F.zip_with(F.slice(digits, F.lit(1), visible + targets - 1), F.slice(digits, F.lit(2), visible + targets - 1), lambda a, b: b - a), lambda j: j > 4)
        turn = lambda name, i: F.get(F.get(p["rows"], F.lit(name)), (i % F.get(p["shape"], F.lit(0))).cast("int"))
        wraps = F.size(F.filter(steps(visible - 1), lambda i: turn(0, i) * F.get(v, i) + turn(1, i) >= F.get(p["shape"], F.lit(1))))
        is_mod, is_block = p["family"] == "MODAFFINE", p["family"] == "GROWBLOCK"
        good = bounded(seen, VISIBLE_MOST) & bounded(hidden, TARGET_MOST) & (F.size(F.array_distinct(seen)) >= 6)
        return good & (is_block | (sequences.longest_run(seen) <= 3)) & (is_mod | ~jumps) & (~is_mod | ((wraps >= 2) & (F.size(F.array_distinct(v)) == visible + targets)))

    return let(F.slice(terms, F.lit(1), visible + targets), judged)
