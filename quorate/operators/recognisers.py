"""All programs of eight families that a prefix admits, as relations: hypotheses are rows, a wrong one is filtered, phases are grouped.

Prefixes are partitioned by id once; everything that follows is grouped within an id, so that no further shuffle is made. A
prefix gives some thousand hypotheses at most, whatever its terms are.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions import programs
from quorate.functions.programs import MOST_COEFFICIENT, MOST_SEED, bounded, led, longs, program
from quorate.functions.sequences import binomial
from quorate.operators.lineage import cut

#: Terms by which two programs count as one sequence, and terms that are to be continued.
FINGERPRINT, TARGETS = 25, 5


def _differences(v: Column) -> Column:
    return F.when(F.size(v) > 1, F.zip_with(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda a, b: a - b)).otherwise(longs())


def _every(values: Column, step: Column, r: Column) -> Column:
    """values[r], values[r + step] ..."""
    return F.filter(values, lambda _, i: i % step == r)


def _options(rows: Sequence[tuple[int, ...]], *names: str) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]))


def _fits(x: DataFrame) -> DataFrame:
    """(id, head, family, shape, r, c, values): strands that are binomial polynomials, with coefficients c within the family's bounds."""
    head = F.slice("x", 1, 4).alias("head")

    def strands(family: str, options, names, values: Column, shape: Column) -> DataFrame:
        return x.select("*", _options(options, *names).alias("o")).select("*", "o.*").select("id", head, F.lit(family).alias("family"), shape.alias("shape"), F.col("r"), F.col("d"), values.alias("v0"))

    each = lambda pairs: [(p, d, r) for p, d in pairs for r in range(p)]
    p, d, r = F.col("p"), F.col("d"), F.col("r")
    # the places at which blocks of l, l + 1 ... terms begin
    begins = {first: [sum(first + k for k in range(b)) for b in range(8)] for first in (1, 2)}
    at_begins = F.coalesce(*[F.when(p == first, F.transform(F.filter(longs(*at), lambda i: i < F.size("x")), lambda i: F.get("x", i.cast("int")))) for first, at in begins.items()])
    found = strands("POLY", [(0, k, 0) for k in range(2, 6)], ("p", "d", "r"), F.col("x"), longs(d))
    found = found.union(strands("PDELTA", each(programs.PDELTA_SHAPES), ("p", "d", "r"), _every(_differences(F.col("x")), p, r), longs(p, d)))
    found = found.union(strands("LAGPOLY", each(programs.LAGPOLY_SHAPES), ("p", "d", "r"), _differences(_every(F.col("x"), p, r)), longs(p, d)))
    found = found.union(strands("INTERLEAVE", [(k, e, i) for k in (2, 3) for i in range(k) for e in (1, 2, 3)], ("p", "d", "r"), _every(F.col("x"), p, r), longs(p)))
    found = found.union(strands("GROWBLOCK", [(first, e, 0) for first in (1, 2) for e in (1, 2, 3)], ("p", "d", "r"), at_begins, longs(p, d)))
    found = cut(found)  # else filters repeat the expressions of v0
    at = lambda j: F.get("v0", F.lit(j))
    lead = [sum((at(j) * ((-1) ** (k - j) * comb(k, j)) for j in range(1, k + 1)), at(0) * (-1) ** k) for k in range(6)]
    found = found.where(F.size("v0") > F.col("d")).withColumn("c", F.slice(F.array(*lead), F.lit(1), F.col("d") + 1))
    found = cut(found).where(F.forall(F.transform("v0", lambda v, n: v == binomial(F.col("c"), n.cast("bigint"))), lambda ok: ok))
    leading = F.col("family").isin("POLY", "INTERLEAVE")
    fine = F.when(F.col("family").isin("PDELTA", "LAGPOLY"), bounded(F.col("c"), MOST_COEFFICIENT)).otherwise(led(F.col("c")) & (~leading | (F.element_at("c", -1) != 0)))
    return found.where(fine).select("id", "head", "family", "shape", "r", "d", "c")


def _polynomial(fits: DataFrame) -> list[DataFrame]:
    own = fits.where("family = 'POLY'").select("id", program("POLY", F.col("shape"), longs(), F.array("c")).alias("program"))
    out = [own]
    for family, seeds in (("PDELTA", F.slice("head", 1, 1)), ("LAGPOLY", F.slice(F.col("head"), F.lit(1), F.get("shape", F.lit(0)).cast("int")))):
        rows = F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda y: y["c"])
        whole = fits.where(F.col("family") == family).groupBy("id", "head", "shape").agg(rows.alias("rows"))
        fine = (F.size("rows") == F.get("shape", F.lit(0))) & programs.several(F.col("rows")) & bounded(seeds, MOST_SEED)
        out.append(whole.where(fine).select("id", program(family, F.col("shape"), seeds, F.col("rows")).alias("program")))
    return out


def _combined(options: DataFrame, keys: Sequence[str], count: Column, most: int) -> DataFrame:
    """(keys, found): all lists that take one of the options `o` of each phase r, for phases 0 to count - 1; phases without options leave none."""
    sets = options.groupBy("id", *keys).agg(*[F.collect_list(F.when(F.col("r") == i, F.col("o"))).alias(f"o{i}") for i in range(most)])
    for i in range(most):
        sets = sets.withColumn(f"o{i}", F.explode(F.when(count > i, F.col(f"o{i}")).otherwise(F.array(F.lit(None)))))
    return sets.select("id", *keys, F.array_compact(F.array(*[f"o{i}" for i in range(most)])).alias("found"))


def _steps(x: DataFrame) -> DataFrame:
    """(id, head, n, a, b, c): each term a, the n-th from 1 on, with the two before it."""
    n = F.explode(F.sequence(F.lit(2), F.size("x"))).alias("n")
    at = lambda back: F.get("x", F.col("n") - 1 - back)
    return x.select("id", "x", n).select("id", F.slice("x", 1, 2).alias("head"), "n", at(0).alias("a"), at(1).alias("b"), F.when(F.col("n") > 2, at(2)).alias("c"))


def _turns(x: DataFrame) -> list[DataFrame]:
    """AFFINE and MODAFFINE: for each period, phase and multiplier the bias that all terms of the phase share."""
    rows = lambda found: F.array(F.transform(found, lambda y: y["m"]), F.transform(found, lambda y: y["b"]))
    option = F.struct(F.col("m").cast("long").alias("m"), F.col("bias").alias("b"))
    lines = _steps(x.where(F.abs(F.get("x", F.lit(0))) <= MOST_SEED)).select("*", _options([(p, m) for p in (1, 2, 3) for m in programs.MULTIPLIERS], "p", "m").alias("y")).select("*", "y.*")
    lines = lines.groupBy("id", "head", "p", "m", ((F.col("n") - 2) % F.col("p")).alias("r")).agg(F.min(F.col("a") - F.col("m") * F.col("b")).alias("bias"), F.max(F.col("a") - F.col("m") * F.col("b")).alias("top"))
    lines = lines.where((F.col("bias") == F.col("top")) & (F.abs("bias") <= MOST_COEFFICIENT)).select("id", "head", "p", "r", option.alias("o"))
    affine = _combined(lines, ["head", "p"], F.col("p"), 3).select("id", program("AFFINE", longs(F.col("p")), F.slice("head", 1, 1), rows(F.col("found"))).alias("program"))
    small = x.where((F.array_min("x") >= 0) & (F.array_max("x") < max(programs.PRIMES))).select("*", F.explode(F.filter(longs(*programs.PRIMES), lambda m: m > F.array_max("x"))).alias("modulus"))
    modulo = _steps(small.withColumnRenamed("id", "of").select(F.struct("of", "modulus").alias("id"), "x"))
    modulo = modulo.select("*", _options([(p, m) for p in (1, 2) for m in range(2, 10)], "p", "m").alias("y")).select("id.of", "id.modulus", "head", "n", "a", "b", "y.*")
    bias = F.pmod(F.col("a") - F.col("m") * F.col("b"), F.col("modulus"))
    modulo = modulo.groupBy(F.col("of").alias("id"), "modulus", "head", "p", "m", ((F.col("n") - 2) % F.col("p")).alias("r")).agg(F.min(bias).alias("bias"), F.max(bias).alias("top"))
    modulo = modulo.where("bias = top").select("id", "modulus", "head", "p", "r", option.alias("o"))
    modaffine = _combined(modulo, ["modulus", "head", "p"], F.col("p"), 2).select("id", program("MODAFFINE", longs(F.col("p"), F.col("modulus")), F.slice("head", 1, 1), rows(F.col("found"))).alias("program"))
    return [affine, modaffine]


def _lin2(x: DataFrame) -> DataFrame:
    options = [(p, u, v) for p in (1, 2, 3) for u in programs.WEIGHTS for v in programs.WEIGHTS]
    rows = _steps(x.where(bounded(F.slice("x", 1, 2), MOST_SEED) & (F.size("x") > 2))).where("n > 2").select("*", _options(options, "p", "u", "v").alias("y")).select("*", "y.*")
    bias = F.col("a") - F.col("u") * F.col("b") - F.col("v") * F.col("c")
    rows = rows.groupBy("id", "head", "p", "u", "v", ((F.col("n") - 3) % F.col("p")).alias("r")).agg(F.min(bias).alias("bias"), F.max(bias).alias("top"))
    rows = rows.where((F.col("bias") == F.col("top")) & (F.abs("bias") <= MOST_COEFFICIENT))
    biases = F.transform(F.array_sort(F.collect_list(F.struct("r", "bias"))), lambda y: y["bias"])
    whole = rows.groupBy("id", "head", "p", "u", "v").agg(biases.alias("biases")).where(F.size("biases") == F.col("p"))
    return whole.select("id", program("LIN2", longs(F.col("p")), F.col("head"), F.array(longs(F.col("u"), F.col("v")), F.col("biases"))).alias("program"))


def _interleave(x: DataFrame, fits: DataFrame) -> DataFrame:
    atom = lambda kind, seed, row: F.struct(kind.cast("long").alias("kind"), seed.cast("long").alias("seed"), row.alias("row")).alias("o")
    polys = fits.where("family = 'INTERLEAVE'").select("id", F.get("shape", F.lit(0)).cast("int").alias("p"), "r", atom(F.col("d"), F.lit(0), F.col("c")))
    lines = x.select("*", _options([(k, r, m) for k in (2, 3) for r in range(k) for m in programs.STRAND_MULTIPLIERS], "p", "r", "m").alias("y")).select("id", "y.*", _every(F.col("x"), F.col("y.p"), F.col("y.r")).alias("v"))
    b = F.array_distinct(F.zip_with(F.slice("v", F.lit(2), F.size("v") - 1), F.slice("v", F.lit(1), F.size("v") - 1), lambda a, b: a - F.col("m") * b))
    lines = lines.where(F.size("v") > 1).withColumn("b", b).where((F.size("b") == 1) & bounded(F.col("b"), MOST_COEFFICIENT) & (F.abs(F.get("v", F.lit(0))) <= MOST_SEED))
    lines = lines.select("id", "p", "r", atom(F.lit(0), F.get("v", F.lit(0)), longs(F.col("m"), F.get("b", F.lit(0)))))
    both = _combined(polys.union(lines), ["p"], F.col("p"), 3)
    part = lambda name: F.transform("found", lambda y: y[name])
    terms = F.transform("found", lambda y: programs.strand_terms(y["kind"], y["seed"], y["row"], 9))
    return both.where(F.size(F.array_distinct(terms)) == F.col("p")).select("id", program("INTERLEAVE", F.concat(longs(F.col("p")), part("kind")), part("seed"), part("row")).alias("program"))


def _growblock(x: DataFrame, fits: DataFrame) -> DataFrame:
    """Blocks are even if steps within one are alike; the blocks' steps are one number or a line in the block's number."""
    places = [(first, n, b, t) for first in (1, 2) for n, (b, t) in enumerate([(b, t) for b in range(8) for t in range(first + b)][:30])]
    terms = _steps(x).select("id", "n", (F.col("a") - F.col("b")).alias("step"), (F.col("a") - 2 * F.col("b") + F.col("c")).alias("bend"))
    where = lambda first, what: F.get(longs(*[(b, t)[what] for f, _, b, t in places if f == first]), F.col("n") - 1)
    own = F.explode(F.array(*[F.struct(F.lit(first).alias("p"), where(first, 0).alias("block"), where(first, 1).alias("t")) for first in (1, 2)]))
    seen = terms.select("*", own.alias("y")).select("*", "y.*").where("t > 0")
    steps = seen.groupBy("id", "p").agg(F.count_if((F.col("t") > 1) & (F.col("bend") != 0)).alias("uneven"), F.array_sort(F.collect_list(F.when(F.col("t") == 1, F.struct("block", "step")))).alias("s")).where("uneven = 0")
    s = lambda i: F.get("s", F.lit(i))
    rise = s(1)["step"] - s(0)["step"]  # neighbouring blocks
    straight = F.forall("s", lambda y: y["step"] == s(0)["step"] + rise * (y["block"] - s(0)["block"]))
    same = F.forall("s", lambda y: y["step"] == s(0)["step"])
    lines = F.array(F.when((F.size("s") > 0) & same, longs(s(0)["step"])), F.when((F.size("s") > 1) & straight, longs(s(0)["step"] - rise * s(0)["block"], rise)))
    rows = steps.select("id", "p", F.posexplode(lines).alias("dd", "line")).where(F.col("line").isNotNull() & bounded(F.col("line"), MOST_COEFFICIENT) & F.exists("line", lambda y: y != 0))
    blocks = fits.where("family = 'GROWBLOCK'").select(F.col("id").alias("of"), F.get("shape", F.lit(0)).alias("first"), "d", "c")
    met = rows.join(blocks, (F.col("id") == F.col("of")) & (F.col("p") == F.col("first")))
    return met.select("id", program("GROWBLOCK", longs(F.col("p"), F.col("d"), F.col("dd")), longs(), F.array("c", "line")).alias("program"))


def recognise(prefixes: DataFrame, count: int = FINGERPRINT) -> DataFrame:
    """(id, program, terms): all programs within the families' bounds whose first terms are a prefix's, each with `count` terms.

    Prefixes are (id, x), x being 6 to 30 BIGINTs; ids are longs and distinct. A prefix that no program has gives no row.
    """
    x = cut(prefixes.select("id", "x").repartition("id"))
    fits = cut(_fits(x))
    found = [*_polynomial(fits), *_turns(x), _lin2(x), _interleave(x, fits), _growblock(x, fits)]
    families = ["POLY", "PDELTA", "LAGPOLY", "AFFINE", "MODAFFINE", "LIN2", "INTERLEAVE", "GROWBLOCK"]
    out = [f.select("id", "program", programs.evaluate_family(name, F.col("program"), count).alias("terms")) for name, f in zip(families, found, strict=True)]
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return cut(every)


def audit(cases: DataFrame, targets: int = TARGETS, probes: bool = True) -> DataFrame:
    """(id, probe, candidates, families, sequences, continuations, lower_tier, itself): how ambiguous a case's terms are, by length of prefix.

    Cases are (id, program, terms, visible), terms being FINGERPRINT of the program's own. Prefixes of visible, visible - 2 and visible - 4 terms, 6 at
    least, are probed, or (`probes` false) that of visible terms alone. Candidates are the programs found; sequences and continuations count different terms among them, over
    FINGERPRINT terms and over the `targets` after the visible ones; lower_tier counts candidates of a lower tier than the
    case's program, and itself says whether its terms are among them.
    """
    lengths = F.array_distinct(F.array(*[F.greatest(F.lit(6), F.col("visible") - k) for k in ((4, 2, 0) if probes else (0,))]))
    tried = cut(cases.select("id", "program", "terms", "visible", F.explode(lengths).alias("probe")).withColumn("key", F.monotonically_increasing_id()))
    found = recognise(tried.select(F.col("key").alias("id"), F.slice(F.col("terms"), F.lit(1), F.col("probe")).alias("x")))
    found = found.select(F.col("id").alias("of"), F.col("program").alias("p"), F.col("terms").alias("t"))
    both = tried.join(found, F.col("key") == F.col("of"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    after = F.slice(F.col("t"), F.col("visible") + 1, F.lit(targets))
    return both.groupBy("key", "id", "probe").agg(
        F.count("*").alias("candidates"), F.array_sort(F.collect_set("p.family")).alias("families"), F.count_distinct(text(F.col("t"))).alias("sequences"), F.count_distinct(text(after)).alias("continuations"),
        F.count_if(programs.tier(F.col("p")) < programs.tier(F.col("program"))).alias("lower_tier"), F.bool_or(F.col("t") == F.col("terms")).alias("itself")).drop("key")
