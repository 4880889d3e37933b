"""Cases for sequence families: programs drawn by digests, and rejection sampling until a case is fair and not ambiguous."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import count, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import programs
from quorate.functions.draws import below_of, pairs
from quorate.functions.programs import FAMILIES, longs, program
from quorate.operators.lineage import cut
from quorate.operators.recognisers import FINGERPRINT, audit

# Fixed values of the tiers 1 to 3: terms shown, and limits of coefficients and seeds.
VISIBLE, COEFFICIENT, SEED = {1: 12, 2: 13, 3: 14}, {1: 5, 2: 7, 3: 9}, {1: 12, 2: 20, 3: 30}
#: Numbers that a program is drawn from, at most.
NUMBERS = 48
#: Attempts of a case, in waves: most cells need few, so later waves see only the cells that are still open.
WAVES = (4, 20, 200, 2_000, 20_000)


def drawn(family: str, level: int, draw: Callable[[int, int], Column]) -> Column:
    """A program of a family within a tier's limits; draw(low, high) gives another number each time."""
    c, s = COEFFICIENT[level], SEED[level]
    seed, near = lambda: draw(-s, s), lambda: draw(-c, c)

    def choice(values: Sequence[int]) -> Column:
        return F.element_at(longs(*values), (draw(0, len(values) - 1) + 1).cast("int"))

    def vector(degree: int, first: Callable[[], Column] = near) -> Column:
        """The last coefficient is not 0."""
        last = near()
        head = [first(), *[near() for _ in range(degree - 1)]] if degree else []
        other = draw(0, 2 * c - 1) - c  # -c to c - 1, and from 0 on one more
        return longs(*head, F.when(last == 0, F.when(other < 0, other).otherwise(other + 1)).otherwise(last))

    def rows(most: int, degrees: Sequence[int], n: Column, degree: Column) -> Column:
        each = F.coalesce(*[F.when(degree == d, F.array(*[vector(d) for _ in range(most)])) for d in degrees])
        return F.slice(each, F.lit(1), n.cast("int"))

    if family == "POLY":
        return program(family, longs(level + 2), longs(), F.array(vector(level + 2, seed)))
    if family in ("PDELTA", "LAGPOLY"):
        shapes = {1: [(2, 0)], 2: [(2, 1), (3, 1)], 3: [(3, 1), (3, 2), (4, 1), (4, 2)] if family == "PDELTA" else [(3, 2), (4, 1)]}[level]
        at = (draw(0, len(shapes) - 1) + 1).cast("int")
        n, degree = F.element_at(longs(*[a for a, _ in shapes]), at), F.element_at(longs(*[b for _, b in shapes]), at)
        seeds = longs(seed()) if family == "PDELTA" else F.slice(longs(*[seed() for _ in range(4)]), F.lit(1), n.cast("int"))
        return program(family, longs(n, degree), seeds, rows(4, sorted({b for _, b in shapes}), n, degree))
    if family == "AFFINE":
        return program(family, longs(level), longs(seed()), F.array(longs(*[choice(programs.MULTIPLIERS) for _ in range(level)]), longs(*[near() for _ in range(level)])))
    if family == "LIN2":
        return program(family, longs(level), longs(seed(), seed()), F.array(longs(choice(programs.WEIGHTS), choice(programs.WEIGHTS)), longs(*[near() for _ in range(level)])))
    if family == "INTERLEAVE":
        kinds = {1: (2, 0), 2: (2, 0, 1), 3: (3, 0, 2)}[level]
        orders = sorted(set(permutations(kinds)))
        at = draw(0, len(orders) - 1)
        strand = {k: vector(k, seed) if k else longs(choice(programs.STRAND_MULTIPLIERS), near()) for k in kinds}
        first = seed()
        made = [program(family, longs(len(o), *o), longs(*[first if k == 0 else 0 for k in o]), F.array(*[strand[k] for k in o])) for o in orders]
        return F.element_at(F.array(*made), (at + 1).cast("int"))
    if family == "GROWBLOCK":
        return program(family, longs(choice((1, 2)), level, min(1, level - 1)), longs(), F.array(vector(level, seed), vector(min(1, level - 1))))
    if family == "MODAFFINE":
        low, high = {1: (19, 43), 2: (31, 79), 3: (53, 127)}[level]
        modulus = choice([p for p in programs.PRIMES if low <= p <= high])
        period = {1: F.lit(1), 2: choice((1, 2)), 3: F.lit(2)}[level].cast("int")
        below = lambda: F.pmod(draw(0, 1 << 30), modulus)
        few = lambda values: F.slice(longs(*values), F.lit(1), period)
        return program(family, longs(period, modulus), longs(below()), F.array(few([draw(2, 9), draw(2, 9)]), few([below(), below()])))
    raise ValueError(family)


def draw_programs(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cells (key, family, tier) with a program each, drawn by the key's columns, family and tier; numbers are unbiased."""

    def spans(family: str, level: int) -> list[int]:
        """How many values each number of a program may have, in the order in which they are drawn."""
        found: list[int] = []
        drawn(family, level, lambda low, high: found.append(high - low + 1) or F.lit(0))
        return found

    def of(family: str) -> DataFrame:
        part = cells.where(F.col("family") == family).withColumn("words", pairs(NUMBERS, *[F.col(k).cast("string") for k in key], "family", F.col("tier").cast("string")))
        for level in VISIBLE:  # numbers first, in one array, as their expressions would fill the program's
            part = part.withColumn(f"numbers_{level}", F.zip_with(F.slice("words", 1, len(spans(family, level))), longs(*spans(family, level)), below_of))
        made = []
        for level in VISIBLE:
            number = count()
            made.append(F.when(F.col("tier") == level, drawn(family, level, lambda low, high, n=number, c=f"numbers_{level}": low + F.get(c, F.lit(next(n))))))
        return part.withColumn("program", F.coalesce(*made)).drop("words", *[f"numbers_{t}" for t in VISIBLE])

    return reduce(DataFrame.union, [of(f) for f in FAMILIES])


def with_terms(drawn_: DataFrame) -> DataFrame:
    """Drawn programs with FINGERPRINT terms and the number of visible ones."""
    drawn_ = cut(drawn_)  # its families are branches, and so are these
    parts = [drawn_.where(F.col("family") == f).withColumn("terms", programs.evaluate_family(f, F.col("program"), FINGERPRINT)) for f in FAMILIES]
    return reduce(DataFrame.union, parts).withColumn("visible", F.coalesce(*[F.when(F.col("tier") == t, n) for t, n in VISIBLE.items()]))


def fair(p: Column, level: Column, terms: Column, visible: Column) -> Column:
    """Whether a program has its tier and differing rows, and makes a case within bounds."""
    alike = p["family"].isin("PDELTA", "LAGPOLY") & (F.size(F.array_distinct(p["rows"])) == 1)
    turns = p["family"].isin("AFFINE", "MODAFFINE") & (F.size(F.get(p["rows"], F.lit(0))) > 1) & (F.size(F.array_distinct(F.arrays_zip(F.get(p["rows"], F.lit(0)), F.get(p["rows"], F.lit(1))))) == 1)
    return ~alike & ~turns & (programs.tier(p) == level) & programs.in_bounds(p, terms, visible)


def sampled(cells: DataFrame, key: Sequence[str], waves: Sequence[int] = WAVES) -> DataFrame:
    """Per cell the first attempt whose program is fair, is found again from its prefix, has one continuation there, and below tier 3 no
    easier reading: (key, family, tier, attempt, program, terms, visible, candidates). A cell for which no attempt serves has no row.

    Waves of attempts go to the cells that are still open; bounds are tested before prefixes are searched, and each wave is
    a written table.
    """
    names = [*key, "family", "tier"]
    left, out, begun = cut(cells.select(*names).distinct()), None, 0
    for end in waves:
        tries = with_terms(draw_programs(left.withColumn("attempt", F.explode(F.sequence(F.lit(begun + 1), F.lit(end)))), [*key, "attempt"]))
        good = tries.where(fair(F.col("program"), F.col("tier"), F.col("terms"), F.col("visible")))
        good = cut(good.withColumn("id", F.monotonically_increasing_id()))
        told = audit(good.select("id", "program", "terms", "visible"), probes=False)
        serves = F.col("itself") & (F.col("continuations") == 1) & ((F.col("tier") == 3) | (F.col("lower_tier") == 0))
        told = good.join(told.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).where(serves)
        first = F.min_by(F.struct("attempt", "program", "terms", "visible", "candidates"), "attempt")
        found = cut(told.groupBy(*names).agg(first.alias("y")).select(*names, "y.*"))
        out, begun = found if out is None else out.union(found), end
        left = cut(left.join(found.select(*names), names, "left_anti"))
        if left.isEmpty():
            break
    return out
