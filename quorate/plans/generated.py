"""Generated cases, random numbers, founders and the audits of generations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quorate.functions import programs as programs_
from quorate.functions import sequences
from quorate.operators import audits, decisions, recognisers, scores, validators, votes
from quorate.operators import cases as sampling
from quorate.operators.lineage import cut
from quorate.plans.fixtures import PANEL, SMALL, TRUTH, panel, plurality_sql, read, small_panel, truth

SEED, ATTEMPTS, TERMS = "quorate", 40, 12


def number(n: int, *parts):
    """A number below n from the MD5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary")), 1, 8), 16, 10).cast("long") % n


def programs(s, d):
    """Per region and tier up to ATTEMPTS polynomial programs: coefficients within the tier's bounds."""
    cells = read(s, d, "region").select("r_name").crossJoin(s.range(1, 4).select(F.col("id").cast("int").alias("tier")))  # fifteen cells
    tries = cells.select("r_name", "tier", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))).alias("attempt"))
    c = [number(13, "r_name", "tier", "attempt", F.lit(j)) - 6 for j in range(5)]
    return tries.select("r_name", "tier", "attempt", F.slice(F.array(*c), F.lit(1), F.col("tier") + 2).alias("c"))


_NUMBER = f"CAST('0x' || substr(md5('{SEED}|' || r_name || '|' || tier || '|' || attempt || '|{{}}'), 1, 8) AS BIGINT) % 13 - 6"
PROGRAMS = f"pg AS (SELECT r_name, tier, attempt, list_slice([{', '.join(_NUMBER.format(j) for j in range(5))}], 1, tier + 2) AS c FROM (SELECT r_name, CAST(t AS INTEGER) AS tier, CAST(a AS INTEGER) AS attempt FROM region, range(1, 4) x(t), range({ATTEMPTS}) y(a)))"


def seq02(s, d):
    return programs(s, d).select("r_name", "tier", "attempt", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("coefficients"))


SEQ02 = f"WITH {PROGRAMS} SELECT r_name, tier, attempt, array_to_string(c, ',') AS coefficients FROM pg"


def cases(s, d):
    """Rejection sampling: per cell the first attempt whose terms stay within bounds, have no equal neighbours and end in a new leading coefficient."""
    t = programs(s, d).withColumn("terms", sequences.poly(F.col("c"), TERMS))
    fine = F.forall("terms", lambda x: F.abs(x) <= 3000) & (sequences.longest_run(F.col("terms")) <= 1) & (F.element_at("c", -1) != 0)
    return t.where(fine).groupBy("r_name", "tier").agg(F.min_by(F.struct("attempt", "terms"), "attempt").alias("x")).select("r_name", "tier", "x.attempt", F.array_join(F.transform("x.terms", lambda v: v.cast("string")), ",").alias("terms"))


SEQ06 = f"""WITH {PROGRAMS},
tm AS (SELECT *, [c[1] + c[2] * n + c[3] * n * (n - 1) // 2 + coalesce(c[4], 0) * n * (n - 1) * (n - 2) // 6 + coalesce(c[5], 0) * n * (n - 1) * (n - 2) * (n - 3) // 24 FOR n IN range({TERMS})] AS t FROM pg),
ok AS (SELECT *, row_number() OVER (PARTITION BY r_name, tier ORDER BY attempt) AS k FROM tm WHERE list_max(list_transform(t, lambda x: abs(x))) <= 3000 AND c[len(c)] <> 0 AND list_min(list_transform(range(1, {TERMS}), lambda i: abs(t[i + 1] - t[i]))) > 0)
SELECT r_name, tier, attempt, array_to_string(t, ',') AS terms FROM ok WHERE k = 1"""


def cells(s, d):
    """A cell for each region, family and tier."""
    kinds = [(f, t) for f in sampling.FAMILIES for t in sampling.VISIBLE]
    return read(s, d, "region").select("r_name").crossJoin(F.broadcast(s.createDataFrame(kinds, "family string, tier int")))  # 24 kinds


def first_programs(s, d):
    """The first program of each cell, whatever it is."""
    return sampling.draw_programs(cells(s, d).withColumn("attempt", F.lit(1)), ["r_name", "attempt"])


def text_of(p):
    return F.to_json(p)


def seq02_families(s, d):
    return first_programs(s, d).withColumnRenamed("program", "p").select("r_name", "family", "tier", text_of(F.col("p")).alias("program"), F.to_json(programs_.evaluate(F.col("p"), 12)).alias("terms"))


def keyed(s, d):
    """The first programs with ids, their terms and the number of visible ones."""
    return cut(sampling.with_terms(first_programs(s, d)).withColumn("id", F.monotonically_increasing_id()))


def seq03_families(s, d):
    """All programs of all families that each cell's first twelve terms admit."""
    k = keyed(s, d)
    found = recognisers.recognise(k.select("id", F.slice("terms", 1, 12).alias("x")))
    return k.select("id", "r_name", "family", "tier").join(found.select("id", text_of(F.col("program")).alias("program")), "id").drop("id")


def seq04_families(s, d):
    """The ambiguity of each cell's first program, at three lengths of prefix."""
    k = keyed(s, d)
    told = recognisers.audit(k.select("id", "program", "terms", "visible"))
    told = told.withColumn("families", F.array_join("families", ","))
    return k.select("id", "r_name", "family", "tier", text_of(F.col("program")).alias("program")).join(told, "id").drop("id")


def seq05_families(s, d):
    k = sampling.with_terms(first_programs(s, d))
    return k.select("r_name", "family", "tier", programs_.tier(F.col("program")).alias("least_tier"), programs_.in_bounds(F.col("program"), F.col("terms"), F.lit(12)).alias("in_bounds"))


def published(s, d):
    """A case for each region, family and tier, by rejection sampling of up to 20,000 attempts."""
    return sampling.sampled(cells(s, d), ["r_name"])


def seq06_families(s, d):
    p = published(s, d)
    return p.select("r_name", "family", "tier", "attempt", text_of(F.col("program")).alias("program"), "visible", "candidates", F.to_json("terms").alias("terms"))


def seq08_families(s, d):
    """Cases verified from their cells: the attempt's program drawn again, its terms, tier, bounds and audit; one was changed by hand, and fails."""
    p = cut(published(s, d))
    changed = (F.col("r_name") == "ASIA") & (F.col("family") == "POLY") & (F.col("tier") == 1)
    p = p.withColumn("terms", F.when(changed, F.transform("terms", lambda v, i: F.when(i == 3, v + 1).otherwise(v))).otherwise(F.col("terms")))
    names = ["r_name", "family", "tier"]
    again = sampling.with_terms(sampling.draw_programs(p.select(*names, "attempt"), ["r_name", "attempt"])).select(*[F.col(c).alias(f"n_{c}") for c in (*names, "program", "terms")])
    both = cut(p.join(again, [F.col(c) == F.col(f"n_{c}") for c in names]).withColumn("id", F.monotonically_increasing_id()))
    told = recognisers.audit(both.select("id", F.col("program"), "terms", "visible"), probes=False)
    told = told.select(F.col("id").alias("of"), F.col("itself"), F.col("continuations"), F.col("candidates").alias("found"))
    checked = both.join(told, F.col("id") == F.col("of"), "left")
    return checked.select(
        *names, text_of(F.col("program")).eqNullSafe(text_of(F.col("n_program"))).alias("same_program"), (F.col("terms") == F.col("n_terms")).alias("same_terms"), sampling.fair(F.col("program"), F.col("tier"), F.col("terms"), F.col("visible")).alias("fair"),
        F.coalesce(F.col("itself") & (F.col("continuations") == 1) & (F.col("found") == F.col("candidates")), F.lit(False)).alias("same_audit"))


def seq08(s, d):
    """Cases regenerated and compared with a copy in which one was changed."""
    a = cases(s, d)
    damaged = a.withColumn("terms", F.when((F.col("r_name") == "ASIA") & (F.col("tier") == 1), "0").otherwise(F.col("terms")))
    return audits.recompute(a, damaged).groupBy("side").agg(F.count("*").alias("n"))


SEQ08 = f"SELECT unnest(['published', 'recomputed']) AS side, (SELECT count(*) FROM ({SEQ06}) WHERE r_name = 'ASIA' AND tier = 1) AS n"


#: Fixed values of two public generators: an increment and two multipliers of 64 bits, an increment of 32 bits.
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MULBERRY = 0x6D2B79F5


def splitmix64(seeds: pa.Array) -> pa.Array:
    """The first number of each seed's generator, as a signed 64-bit number."""
    z = seeds.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(SPLITMIX[0])
    z = (z ^ (z >> np.uint64(30))) * np.uint64(SPLITMIX[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SPLITMIX[2])
    return pa.array((z ^ (z >> np.uint64(31))).view(np.int64))


def mulberry32(seeds: pa.Array) -> pa.Array:
    """The first number of each seed's generator, from 0 up to 1."""
    a = seeds.to_numpy(zero_copy_only=False).astype(np.uint32) + np.uint32(MULBERRY)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return pa.array((t ^ (t >> np.uint32(14))).astype(np.float64) / 4294967296.0)


def fn09(s, d):
    k = F.col("p_partkey")
    return read(s, d, "part").select("p_partkey", F.arrow_udf(splitmix64, "long")(k).alias("splitmix64"), F.arrow_udf(mulberry32, "double")(k).alias("mulberry32"))


def fn12(s, d):
    """Named sequences at the numbers that parts' sizes give (modulo 16), by their recurrences."""
    n, long = F.col("n"), lambda v: F.lit(v).cast("long")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    upto = lambda first: F.filter(F.sequence(long(0), n), lambda k: k >= first)
    div = lambda a, b: F.call_function("div", a, b)
    second = lambda step: F.aggregate(upto(2), pair(long(1), long(1)), lambda x, k: pair(x["b"], step(x, k)), lambda x: x["b"])
    columns = {
        "catalan": F.aggregate(upto(1), long(1), lambda c, k: div(c * (4 * k - 2), k + 1)),
        "motzkin": second(lambda x, k: div((2 * k + 1) * x["b"] + (3 * k - 3) * x["a"], k + 2)),
        "involutions": second(lambda x, k: x["b"] + (k - 1) * x["a"]),
        "central_trinomial": second(lambda x, k: div((2 * k - 1) * x["b"] + (3 * k - 3) * x["a"], k)),
        "stirling2": F.aggregate(upto(2), long(0), lambda x, k: 2 * x + 1),
        # a row of partial sums of the row before, read backwards
        "zigzag": F.aggregate(upto(1), F.array(long(1)), lambda row, k: F.aggregate(F.reverse(row), F.array(long(0)), lambda out, v: F.array_append(out, F.element_at(out, -1) + v)), lambda row: F.element_at(row, -1)),
        "cayley": F.aggregate(upto(3), long(1), lambda x, k: x * n),
    }
    numbers = read(s, d, "part").groupBy((F.col("p_size") % 16).cast("long").alias("n")).agg(F.count("*").alias("parts"))
    return numbers.select("n", "parts", *[c.alias(name) for name, c in columns.items()])


FN12 = """WITH RECURSIVE z(m, a) AS (
  SELECT 1, [CAST(1 AS HUGEINT), 1]
  UNION ALL SELECT m + 1, list_append(a, CAST(list_sum(list_transform(range(m + 1), lambda k: factorial(CAST(m AS INTEGER)) // (factorial(CAST(k AS INTEGER)) * factorial(CAST(m - k AS INTEGER))) * a[k + 1] * a[m - k + 1])) AS HUGEINT) // 2) FROM z WHERE m < 15),
n AS (SELECT CAST(p_size % 16 AS BIGINT) AS n, count(*) AS parts FROM part GROUP BY 1),
s AS (
  SELECT n, sum(factorial(n::INTEGER) // (factorial((n - 2 * k)::INTEGER) * factorial(k::INTEGER) * factorial((k + 1)::INTEGER))) AS motzkin,
         sum(factorial(n::INTEGER) // (factorial((n - 2 * k)::INTEGER) * factorial(k::INTEGER) * (1 << k))) AS involutions, sum(factorial(n::INTEGER) // (factorial((n - 2 * k)::INTEGER) * factorial(k::INTEGER) * factorial(k::INTEGER))) AS trinomial
  FROM n, range(8) t(k) WHERE 2 * k <= n GROUP BY n)
SELECT n, parts, CAST(factorial((2 * n)::INTEGER) // (factorial(n::INTEGER) * factorial((n + 1)::INTEGER)) AS BIGINT) AS catalan, CAST(motzkin AS BIGINT) AS motzkin, CAST(involutions AS BIGINT) AS involutions, CAST(trinomial AS BIGINT) AS central_trinomial,
       CASE WHEN n = 0 THEN 0 ELSE ((1 << n) - 2) // 2 END AS stirling2, CAST((SELECT a FROM z WHERE m = 15)[n + 1] AS BIGINT) AS zigzag, CASE WHEN n < 3 THEN 1 ELSE CAST(list_product(list_transform(range(n - 2), lambda k: n)) AS BIGINT) END AS cayley
FROM n JOIN s USING (n)"""


def fn15(s, d):
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    t = F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssX")
    return read(s, d, "orders").select("o_orderkey", text.alias("iso"), F.unix_timestamp(t).alias("seconds"))


FN15 = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS seconds FROM orders"


def val08(s, d):
    """Items that can be scored: an answer of two canonical terms and a confidence within bounds."""
    p = panel(s, d).withColumn("answer", F.when(F.col("slot") % 5 == 0, F.array(F.lit("+5"), F.lit("1"))).otherwise(F.col("digits"))).withColumn("confidence", F.col("confidence") * 11)
    return p.select("case_id", "slot", (F.size(validators.item_errors("proposer")) == 0).alias("scored"))


VAL08 = f"WITH {PANEL} SELECT case_id, slot, slot % 5 <> 0 AND confidence * 11 <= 1 AS scored FROM panel"


def val09(s, d):
    """Calls that answer exactly their planned turns."""
    c = read(s, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("got"), F.max("turn").alias("last"))
    want = F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))
    return c.select("conv_id", ((F.size(F.array_except(want, "got")) == 0) & (F.size(F.array_except("got", want)) == 0)).alias("compliant"))


VAL09 = "SELECT conv_id, count(DISTINCT turn) = 5 AND min(turn) = 1 AND max(turn) = 5 AS compliant FROM conversations GROUP BY conv_id"


def evo07(s, d):
    """Founders: each region's first genes by hash order of the part types."""
    types = read(s, d, "part").select("p_type").distinct()
    r = read(s, d, "region").select("r_name").crossJoin(types)  # five regions
    from quorate.operators import ranks

    placed = ranks.anonymous_order(r, "r_name", [F.col("r_name"), F.col("p_type")], "L", 4)
    return placed.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "p_type"))), lambda x: x["p_type"]), ",").alias("genes"))


EVO07 = "WITH t AS (SELECT r_name, p_type, row_number() OVER (PARTITION BY r_name ORDER BY sha256(r_name || '|' || p_type)) AS k FROM region, (SELECT DISTINCT p_type FROM part)) SELECT r_name, string_agg(p_type, ',' ORDER BY k) AS genes FROM t WHERE k <= 4 GROUP BY r_name"


def aud03(s, d):
    """Packets against the records they were made from: rows that do not agree, null being equal to null."""
    p = panel(s, d).select("case_id", "slot", F.array_join("answer", "|").alias("raw"))
    packet = p.select(F.col("case_id").alias("c"), F.col("slot").alias("k"), F.when(F.col("case_id") % 97 == 0, "damaged").otherwise(F.col("raw")).alias("packet"))
    return p.join(packet, (F.col("case_id") == F.col("c")) & (F.col("slot") == F.col("k"))).where(~F.col("raw").eqNullSafe(F.col("packet"))).select("case_id", "slot", "raw", "packet")


AUD03 = f"WITH {PANEL} SELECT case_id, slot, array_to_string(answer, '|') AS raw, 'damaged' AS packet FROM panel WHERE case_id % 97 = 0"


def aud08(s, d):
    """Crosses of neighbouring parts' genes: children with a gene that neither parent has."""
    p = read(s, d, "part").select("p_partkey", F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("g"))
    a = p.select((F.col("p_partkey") + 1).alias("child"), F.col("g").alias("a"))
    b = p.select((F.col("p_partkey") + 2).alias("child"), F.col("g").alias("b"))
    child = p.select(F.col("p_partkey").alias("child"), F.col("g").alias("c")).join(a, "child").join(b, "child")
    own = F.zip_with(F.arrays_zip("a", "b"), "c", lambda x, y: ((x["a"] == y) | (x["b"] == y)).cast("int"))
    return child.select("child", F.aggregate(own, F.lit(0), lambda s_, x: s_ + x).alias("inherited"))


AUD08 = "SELECT c.p_partkey AS child, CAST(c.p_brand IN (a.p_brand, b.p_brand) AS INTEGER) + CAST(c.p_type IN (a.p_type, b.p_type) AS INTEGER) + CAST(c.p_size IN (a.p_size, b.p_size) AS INTEGER) AS inherited FROM part c JOIN part a ON a.p_partkey = c.p_partkey - 1 JOIN part b ON b.p_partkey = c.p_partkey - 2"


def aud09(s, d):
    """Replacements recomputed from keys, against records of which some were turned round."""
    from quorate.plans.searches import evo04

    got = evo04(s, d)
    said = got.select(F.col("slot").alias("k"), F.when(F.col("slot") % 4 == 0, ~F.col("replaced")).otherwise(F.col("replaced")).alias("recorded"))
    return got.join(said, F.col("slot") == F.col("k")).where("replaced <> recorded").select("slot", "replaced", "recorded")


def _aud09():
    from quorate.plans.searches import EVO04

    return f"SELECT slot, replaced, NOT replaced AS recorded FROM ({EVO04}) WHERE slot % 4 = 0"


def aud15(s, d):
    """Named checks of a scoring round's shape."""
    x = scores.score_records(votes.by_mean_confidence(panel(s, d)), truth(s, d))
    return audits.named_checks({"cases_twice": x.groupBy("case_id").count().where("count > 1"), "terms_out_of_range": x.where("terms not between 0 and 2"), "exact_without_terms": x.where("exact and terms < 2"), "without_votes": x.where("votes < 2")})


AUD15 = f"WITH {PANEL}, {plurality_sql('panel', 'v')} SELECT unnest(['cases_twice', 'terms_out_of_range', 'exact_without_terms', 'without_votes']) AS name, unnest([0, 0, 0, (SELECT count(*) FROM v WHERE votes < 2)]) AS violations, unnest([true, true, true, (SELECT count(*) FROM v WHERE votes < 2) = 0]) AS passed"


def aud16(s, d):
    """A development gate: the role graph and the judges' records."""
    from quorate.operators import stats

    p = small_panel(s, d)
    one = p.agg(F.count_distinct("role").alias("roles"), F.count_if(F.col("role") == "judge").alias("judges"), F.count_if((F.col("role") == "judge") & F.col("answer").isNull()).alias("empty"), F.max("slot").alias("most"))
    return stats.checks(one, {"four_roles": F.col("roles") == 4, "judges_present": F.col("judges") > 0, "judges_answer": F.col("empty") == 0, "at_most_five": F.col("most") <= 5})


AUD16 = f"WITH {SMALL}, o AS (SELECT count(DISTINCT role) = 4 AS a, count(*) FILTER (role = 'judge') > 0 AS b, count(*) FILTER (role = 'judge' AND answer IS NULL) = 0 AS c, max(slot) <= 5 AS d FROM small) SELECT unnest(['four_roles', 'judges_present', 'judges_answer', 'at_most_five', 'all']) AS name, unnest([a, b, c, d, a AND b AND c AND d]) AS passed FROM o"


def snk05(s, d):
    """The summary behind a report's table: decisions of one system by block."""
    x = scores.score_records(decisions.decide(small_panel(s, d), "dual"), truth(s, d))
    return x.groupBy("block").agg(F.count("*").alias("cases"), F.count_if("exact").alias("exact"), F.count_if("gate_open").alias("opened"))


SNK05 = f"""WITH {SMALL}, {TRUTH}, {plurality_sql('small', 'v', "role = 'proposer'")},
g AS (SELECT case_id, coalesce(count(*) FILTER (role = 'judge') = 2 AND count(DISTINCT answer) FILTER (role = 'judge') = 1, false) AS ok, min(answer) FILTER (role = 'judge') AS a FROM small GROUP BY case_id)
SELECT block, count(*) AS cases, count(*) FILTER (CASE WHEN ok THEN a ELSE v.answer END = truth) AS exact, count(*) FILTER (ok) AS opened FROM g LEFT JOIN v ON g.case_id = v.case_id JOIN truth ON truth.case_id = g.case_id GROUP BY block"""


QUERIES = {
    "SEQ02_families": (seq02_families, None), "SEQ03_families": (seq03_families, None), "SEQ04_families": (seq04_families, None), "SEQ05_families": (seq05_families, None), "SEQ06_families": (seq06_families, None), "SEQ08_families": (seq08_families, None),
    "SEQ02_programs": (seq02, SEQ02), "SEQ06_rejection_sampling": (cases, SEQ06), "SEQ08_regeneration": (seq08, SEQ08), "FN09_random_numbers": (fn09, None), "FN12_named_sequences": (fn12, FN12), "FN15_iso_times": (fn15, FN15),
    "VAL08_scored_items": (val08, VAL08), "VAL09_compliance": (val09, VAL09), "EVO07_founders": (evo07, EVO07), "AUD03_provenance": (aud03, AUD03), "AUD08_reproduction": (aud08, AUD08), "AUD09_replacement": (aud09, _aud09()),
    "AUD15_scoring_checks": (aud15, AUD15), "AUD16_development_gate": (aud16, AUD16), "SNK05_summary": (snk05, SNK05),
}
