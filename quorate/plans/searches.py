"""Selector searches, audits and reports over order panels, parts and users' ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorate.functions import draws
from quorate.operators import audits, evolution, ranks, scores
from quorate.operators.lineage import cut
from quorate.plans.fixtures import LEDGER, PANEL, TRUTH, ledger, panel, plurality_sql, read, truth
from quorate.plans.scores import SCORED, SYSTEMS_SQL, decided, scored

SHA = "sha256(CAST({} AS VARCHAR))".format


LENSES = 8


def submasks(s, d):
    """Suppliers work under one of eight lenses; orders' priorities are blocks."""
    votes = panel(s, d).select("case_id", (F.col("l_suppkey") % LENSES).alias("member"), "answer", "confidence")
    return evolution.subset_scores(evolution.submask_votes(votes, truth(s, d)), evolution.subsets(s, LENSES))


def agg23(s, d):
    """Every set of three lenses and more, voted as a panel, by its weakest block, exact cases, terms and size."""
    out = submasks(s, d).groupBy("subset", "size").agg(F.min("exact").alias("weakest_block"), F.sum("exact").alias("exact"), F.sum("terms").alias("terms"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("weakest_block"), F.desc("exact"), F.desc("terms"), "size", "subset")))  # one row a set


SUBSETS = f"""{PANEL}, {TRUTH},
o AS (SELECT subset, panel.* FROM panel, range(1, {1 << LENSES}) u(subset) WHERE bit_count(subset) >= 3 AND (subset >> (l_suppkey % {LENSES})) % 2 = 1),
t AS (SELECT subset, case_id, answer, count(*) AS v, CAST(sum(confidence) AS DOUBLE) / count(*) AS c FROM o GROUP BY subset, case_id, answer),
r AS (SELECT *, row_number() OVER (PARTITION BY subset, case_id ORDER BY v DESC, c DESC, answer) AS k FROM t),
b AS (
  SELECT CAST(subset AS INTEGER) AS subset, CAST(bit_count(subset) AS INTEGER) AS size, block, count(*) FILTER (answer = truth) AS exact,
         CAST(sum(CASE WHEN answer[1] = truth[1] THEN 1 ELSE 0 END + CASE WHEN answer[2] = truth[2] THEN 1 ELSE 0 END) AS BIGINT) AS terms
  FROM r JOIN truth USING (case_id) WHERE k = 1 GROUP BY 1, 2, block)"""
AGG23 = f"""WITH {SUBSETS},
y AS (SELECT subset, size, min(exact) AS weakest_block, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(terms) AS BIGINT) AS terms FROM b GROUP BY subset, size)
SELECT *, CAST(row_number() OVER (ORDER BY weakest_block DESC, exact DESC, terms DESC, size, subset) AS INTEGER) AS place FROM y"""


def agg23_transfer(s, d):
    """Sets chosen by the urgent block on the high one, and the other way round."""
    scored = cut(submasks(s, d))  # sets x blocks rows
    return evolution.transfer(scored, "1-URGENT", "2-HIGH").union(evolution.transfer(scored, "2-HIGH", "1-URGENT"))


def _transfer_sql(train: str, test: str) -> str:
    return f"""SELECT '{train}' AS train, '{test}' AS test, min(subset) FILTER (place = 1) AS selected, avg(z) AS mean, quantile_cont(z, 0.5) AS median, min(z) AS least, max(z) AS most FROM (
  SELECT *, row_number() OVER (ORDER BY tr DESC, tt DESC, size, subset) AS place FROM (
    SELECT subset, size, CAST(coalesce(sum(exact) FILTER (block = '{train}'), 0) AS BIGINT) AS tr, CAST(coalesce(sum(terms) FILTER (block = '{train}'), 0) AS BIGINT) AS tt, CAST(coalesce(sum(exact) FILTER (block = '{test}'), 0) AS BIGINT) AS z
    FROM b GROUP BY subset, size)) WHERE place <= 100"""


AGG23_TRANSFER = f"WITH {SUBSETS} {_transfer_sql('1-URGENT', '2-HIGH')} UNION ALL {_transfer_sql('2-HIGH', '1-URGENT')}"


def agg23_forty(s, d):
    """25,000 sets of forty lenses, by weakest block, exact cases, terms and size."""
    votes = panel(s, d).select("case_id", (F.col("l_suppkey") % FORTY).alias("member"), "answer", "confidence")
    t = truth(s, d)
    blocks = [r.block for r in t.select("block").distinct().collect()]  # five priorities
    out = evolution.set_scores(votes, t, evolution.drawn_sets(s, FORTY, seed="lenses"))
    least = F.when(F.count("*") == len(blocks), F.min("exact")).otherwise(0)
    return out.groupBy("subset", "size").agg(least.alias("weakest_block"), F.sum("exact").alias("exact"), F.sum("terms").alias("terms"))


FORTY = 40


def _entries(s, d):
    return scored(s, d).groupBy("l_suppkey").agg(F.count_if("exact").alias("exact"), F.sum("terms").alias("terms"))


def evo04(s, d):
    e = _entries(s, d)
    parents = e.where("l_suppkey % 2 = 0").select((F.col("l_suppkey") / 2).cast("long").alias("slot"), F.col("l_suppkey").alias("id"), "exact", "terms")
    children = e.where("l_suppkey % 2 = 1").select(((F.col("l_suppkey") + 1) / 2).cast("long").alias("slot"), F.col("l_suppkey").alias("id"), "exact", "terms")
    return evolution.challenge(parents, children, ["exact", "terms"])


ENTRIES = f"WITH {PANEL}, {TRUTH}, {SCORED}, e AS (SELECT l_suppkey, count(*) FILTER (exact) AS exact, CAST(sum(terms) AS BIGINT) AS terms FROM scored GROUP BY l_suppkey)"
EVO04 = f"{ENTRIES} SELECT p.l_suppkey // 2 AS slot, CASE WHEN (c.exact, c.terms) > (p.exact, p.terms) THEN c.l_suppkey ELSE p.l_suppkey END AS survivor, (c.exact, c.terms) > (p.exact, p.terms) AS replaced FROM e p JOIN e c ON c.l_suppkey + 1 = p.l_suppkey WHERE p.l_suppkey % 2 = 0"


def evo05(s, d):
    e = _entries(s, d).withColumn("all", F.lit("all"))
    return ranks.best_of(e, ["all"], [-F.col("exact"), -F.col("terms")], "l_suppkey", "min").select(F.col("l_suppkey").alias("champion"))


EVO05 = f"{ENTRIES} SELECT l_suppkey AS champion FROM e ORDER BY exact DESC, terms DESC, sha256(CAST(l_suppkey AS VARCHAR)) LIMIT 1"


ROLES = ("proposer", "critic", "verifier", "judge")


def candidates(s, d):
    """Per order and answer its support by role, and whether it is right."""
    c = panel(s, d).groupBy("case_id", "answer").agg(*[F.count_if(F.col("role") == r).cast("double").alias(r) for r in ROLES])
    return c.join(truth(s, d), "case_id").select("case_id", "answer", F.array(*ROLES).alias("features"), scores.is_right(F.col("answer"), F.col("truth")).alias("right"))


def evo06(s, d):
    """All 256 policies of weights 0 to 3 for four roles."""
    return evolution.evaluate(evolution.patterns(candidates(s, d), "case_id"), evolution.policies(s, 4)).select("policy", "cases", "exact")


CHOICES = f"""{PANEL}, {TRUTH},
c AS (SELECT case_id, answer, {', '.join(f"count(*) FILTER (role = '{r}') AS f{i}" for i, r in enumerate(ROLES))} FROM panel GROUP BY case_id, answer),
s AS (SELECT policy, case_id, answer, f0 * (policy % 4) + f1 * (policy // 4 % 4) + f2 * (policy // 16 % 4) + f3 * (policy // 64 % 4) AS sc FROM c, range(256) p(policy)),
r AS (SELECT *, row_number() OVER (PARTITION BY policy, case_id ORDER BY sc DESC, answer) AS k FROM s),
x AS (SELECT policy, case_id, answer, answer = truth AS ok, CAST('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000 AS pm FROM r JOIN truth USING (case_id) WHERE k = 1)"""
EVO06 = f"WITH {CHOICES} SELECT CAST(policy AS INTEGER) AS policy, count(*) AS cases, count(*) FILTER (ok) AS exact FROM x GROUP BY policy"
PANELS = ((0.12, 80), (0.24, 16), (0.48, 5))


def evo06_race(s, d):
    """Panels of growing size keep fewer and fewer policies; the last ones are scored on cases that no panel had."""
    return evolution.halving(candidates(s, d), evolution.policies(s, 4), "case_id", PANELS)


def _race_sql() -> str:
    rounds, left = [], "SELECT DISTINCT policy FROM x"
    for i, (share, keep) in enumerate(PANELS):
        rounds.append(f"""e{i} AS (
  SELECT policy, count(*) AS cases, count(*) FILTER (ok) AS exact, md5(string_agg(case_id || ':' || answer[1] || answer[2], ',' ORDER BY case_id)) AS sig
  FROM x WHERE pm < {int(share * 1000)} AND policy IN ({left}) GROUP BY policy),
k{i} AS (
  SELECT policy, cases, exact FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY exact DESC, policy) AS o FROM e{i}) WHERE o = 1 ORDER BY exact DESC, policy LIMIT {keep})""")
        left = f"SELECT policy FROM k{i}"
    last = len(PANELS) - 1
    return f"""WITH {CHOICES}, {', '.join(rounds)},
h AS (SELECT policy, count(*) AS holdout_cases, count(*) FILTER (ok) AS holdout_exact FROM x WHERE pm >= {int(PANELS[-1][0] * 1000)} GROUP BY policy)
SELECT CAST(policy AS INTEGER) AS policy, cases, exact, holdout_cases, holdout_exact FROM k{last} LEFT JOIN h USING (policy)"""


EVO06_RACE = _race_sql()


SHARES, SELECTORS = ("job", "strategy", "lens", "proposer", "reviewer"), 5_000
#: Shares of an order's cases and how many selectors each panel keeps; a third of the cases is in none.
SELECTOR_PANELS = ((1 / 6, 800), (1 / 3, 160), (2 / 3, 25))
SELECTOR_FEATURES = 12


def selector_candidates(s, d):
    """Per order and answer twelve features in whole millionths, which any engine sums alike, and whether it is right."""
    a = scores.archive(panel(s, d), "case_id", "slot", "l_suppkey", "stage").withColumn("reviewer_support", F.expr("critic_support + verifier_support + judge_support"))
    w = Window.partitionBy("case_id")
    sums = {f"{c}_total": F.greatest(F.sum(f"{c}_support").over(w), F.lit(1)) for c in SHARES}  # of no support at all each share is 0
    millionths = [
        *[f"1000000 * {c}_support div {c}_total" for c in SHARES], "cast(floor(1000000 * mean_confidence) as bigint)", "cast(floor(1000000 * max_confidence) as bigint)", "1000000 * lens_support div job_support",
        "if(proposer_support > 0 and reviewer_support > 0, 1000000L, 0L)", "1000000 * reviewer_support div job_support", "1000000 * job_support * lens_support div (job_total * lens_total)", "1000000 div job_support"]
    c = a.withColumns(sums).select("case_id", "answer", F.array(*[F.expr(m) for m in millionths]).alias("features"))
    return c.join(truth(s, d), "case_id").select("case_id", "answer", "features", scores.is_right(F.col("answer"), F.col("truth")).alias("right"), "family", "tier")


def evo06_selectors(s, d):
    """5,000 selectors of twelve weights from -8 to 8 race over panels of growing size, by exact cases, weakest family, weakest tier and small weights."""
    seeds = [[8 if i == j else 0 for i in range(SELECTOR_FEATURES)] for j in range(3)]  # one for each of three features alone
    drawn = cut(evolution.drawn_policies(s, SELECTOR_FEATURES, seeds, SELECTORS, seed="selectors"))
    size = F.aggregate("weights", F.lit(0), lambda t, x: t + F.abs(x))
    order = [F.desc("exact"), F.desc("worst_family"), F.desc("worst_tier"), size, F.desc("weights")]
    return evolution.halving(selector_candidates(s, d), drawn, "case_id", SELECTOR_PANELS, ["family", "tier"], order)


def _selectors_sql() -> str:
    n, million = SELECTOR_FEATURES, "1000000 *"
    seeds = ", ".join(f"({j}, {[8 if i == j else 0 for i in range(n)]})" for j in range(3))
    weights = ", ".join(f"CAST({draws.between_sql('17', chr(39) + 'selectors' + chr(39), 'id', repr(str(i)))} AS INTEGER) - 8" for i in range(n))
    total = lambda c: f"greatest(sum({c}_support) OVER (PARTITION BY case_id), 1)"
    feats = ", ".join([
        *[f"{million} {c}_support // {c}_total" for c in SHARES], f"floor({million} mean_confidence)", f"floor({million} max_confidence)", f"{million} lens_support // job_support",
        f"CASE WHEN proposer_support > 0 AND reviewer_support > 0 THEN 1000000 ELSE 0 END", f"{million} reviewer_support // job_support", f"{million} job_support * lens_support // (job_total * lens_total)", "1000000 // job_support"])
    dot = " + ".join(f"w[{i}] * f[{i}]" for i in range(1, n + 1))
    rounds, left = [], "SELECT policy, w FROM q"
    for i, (share, keep) in enumerate((*SELECTOR_PANELS, (None, None))):
        within = f"pm < {int(share * 1000)}" if keep else f"pm >= {int(SELECTOR_PANELS[-1][0] * 1000)}"
        rounds.append(f"""x{i} AS (
  SELECT policy, case_id, any_value(family) AS family, any_value(tier) AS tier, arg_min({{'answer': answer, 'ok': ok}}, {{'s': -({dot}), 'a': answer}}) AS got
  FROM c, ({left}) WHERE {within} GROUP BY policy, case_id),
e{i} AS (
  SELECT policy, count(*) AS cases, count(*) FILTER (got.ok) AS exact, sum(CAST(hash(case_id, got.answer) AS HUGEINT) % 1000000007) || '|' || sum(CAST(hash(got.answer, case_id) AS HUGEINT) % 998244353) AS sig FROM x{i} GROUP BY policy)""")
        if keep:
            worst = ", ".join(f"(SELECT policy, min(z) AS worst_{c} FROM (SELECT policy, {c}, CAST(count(*) FILTER (got.ok) AS DOUBLE) / count(*) AS z FROM x{i} GROUP BY policy, {c}) GROUP BY policy) {c}_" for c in ("family", "tier"))
            order = "exact DESC, worst_family DESC, worst_tier DESC, list_sum(list_transform(w, lambda v: abs(v))), w DESC"
            rounds.append(f"""k{i} AS (
  SELECT policy, w, cases, exact, worst_family, worst_tier FROM (
    SELECT e{i}.*, w, worst_family, worst_tier, row_number() OVER (PARTITION BY sig ORDER BY {order}) AS o
    FROM e{i} JOIN q USING (policy), {worst} WHERE family_.policy = e{i}.policy AND tier_.policy = e{i}.policy)
  WHERE o = 1 ORDER BY {order} LIMIT {keep})""")
            left = f"SELECT policy, w FROM k{i}"
    last = len(SELECTOR_PANELS)
    return f"""WITH {PANEL}, {TRUTH},
d AS (SELECT id + 3 AS policy, [{weights}] AS w FROM range({2 * SELECTORS}) t(id)),
q AS (SELECT min(policy) AS policy, w FROM (SELECT policy, w FROM d WHERE list_max(w) > 0 UNION ALL SELECT * FROM (VALUES {seeds}) v(policy, w)) GROUP BY w ORDER BY 1 LIMIT {SELECTORS}),
a AS (
  SELECT case_id, answer, count(DISTINCT slot) AS job_support, count(DISTINCT l_suppkey) AS strategy_support, count(DISTINCT stage) AS lens_support, count(*) FILTER (role = 'proposer') AS proposer_support,
         count(*) FILTER (role <> 'proposer') AS reviewer_support, CAST(sum(confidence) AS DOUBLE) / count(*) AS mean_confidence, CAST(max(confidence) AS DOUBLE) AS max_confidence
  FROM panel GROUP BY case_id, answer),
b AS (SELECT *, {', '.join(f"{total(c)} AS {c}_total" for c in SHARES)} FROM a),
c AS (SELECT case_id, answer, [CAST(v AS BIGINT) FOR v IN [{feats}]] AS f, answer = truth AS ok, family, tier, CAST('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000 AS pm FROM b JOIN truth USING (case_id)),
{', '.join(rounds)}
SELECT k.policy, k.cases, k.exact, k.worst_family, k.worst_tier, h.cases AS holdout_cases, h.exact AS holdout_exact FROM k{last - 1} k LEFT JOIN e{last} h USING (policy)"""


EVO06_SELECTORS = _selectors_sql()


def genomes(s, d):
    """Parts as individuals, brands as populations: genes are the two words of a part's name, its type and its size by tens; each locus's choices are all that occur."""
    words = F.split("p_name", " ")
    g = read(s, d, "part").select("p_partkey", "p_brand", "p_retailprice", F.array(F.get(words, 0), F.get(words, 1), "p_type", F.floor(F.col("p_size") / 10).cast("string")).alias("genes"))
    choices = g.agg(F.array(*[F.array_sort(F.collect_set(F.get("genes", i))) for i in range(4)]).alias("choices"))  # four vocabularies
    return g.crossJoin(F.broadcast(choices))


GENOMES = """g AS (SELECT p_partkey, p_brand, p_retailprice, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type, CAST(p_size // 10 AS VARCHAR)] AS genes FROM part),
ch AS (SELECT [list_sort(list(DISTINCT genes[1])), list_sort(list(DISTINCT genes[2])), list_sort(list(DISTINCT genes[3])), list_sort(list(DISTINCT genes[4]))] AS choices FROM g)"""


def mutated_sql(source: str, genes: str, label: list[str]) -> str:
    """Rows of source with `mutant`, as evolution.mutated() makes it of genes and choices."""
    return f"""SELECT *, list_transform(range(1, 5), lambda i: CASE WHEN i = locus + 1 THEN coalesce(others[pick + 1], {genes}[i]) ELSE {genes}[i] END) AS mutant
FROM (SELECT *, {draws.between_sql("greatest(len(others), 1)", *label, "'gene'")} AS pick
FROM (SELECT *, list_filter(choices[locus + 1], lambda x: x <> {genes}[locus + 1]) AS others FROM (SELECT *, {draws.between_sql("4", *label, "'locus'")} AS locus FROM {source})))"""


def crossed_sql(a: str, b: str, label: list[str]) -> str:
    mask = f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(label)}, 'mask')), 1, 13) AS BIGINT)"
    return f"list_transform(range(1, 5), lambda i: CASE WHEN ({mask} >> (i - 1)) % 2 = 1 THEN {b}[i] ELSE {a}[i] END)"


def evo01(s, d):
    """Every part with one gene changed."""
    child = evolution.mutated(F.col("genes"), F.col("choices"), F.lit("evo01"), "p_partkey")
    return genomes(s, d).select("p_partkey", F.array_join("genes", "|").alias("parent"), F.array_join(child, "|").alias("child"))


EVO01 = f"WITH {GENOMES} SELECT p_partkey, array_to_string(genes, '|') AS parent, array_to_string(mutant, '|') AS child FROM ({mutated_sql('(SELECT * FROM g, ch)', 'genes', [chr(39) + 'evo01' + chr(39), 'p_partkey'])})"


def evo02(s, d):
    """Parts of even keys crossed with the next ones."""
    pair = genomes(s, d).groupBy(F.expr("p_partkey div 2").alias("pair")).agg(F.min_by("genes", "p_partkey").alias("a"), F.max_by("genes", "p_partkey").alias("b"), F.count("*").alias("n")).where("n = 2")
    return pair.select("pair", F.array_join(evolution.crossed(F.col("a"), F.col("b"), F.lit("evo02"), "pair"), "|").alias("child"))


EVO02 = f"""WITH {GENOMES}, p AS (SELECT p_partkey // 2 AS pair, arg_min(genes, p_partkey) AS a, arg_max(genes, p_partkey) AS b FROM g GROUP BY 1 HAVING count(*) = 2)
SELECT pair, array_to_string({crossed_sql('a', 'b', [chr(39) + 'evo02' + chr(39), 'pair'])}, '|') AS child FROM p"""


def evo03(s, d):
    """The next generation of each brand from its two dearest parts: four mutants and two crosses, none that is there."""
    g = genomes(s, d)
    out = evolution.generations(g, "p_brand", "genes", [F.desc("p_retailprice"), F.col("p_partkey")], F.col("choices"), "evo03")
    return out.select("p_brand", "slot", F.array_join("child", "|").alias("child"))


def _evo03() -> str:
    label = ["'evo03'", "p_brand", "slot", "attempt"]
    taken = []
    for k in range(6):
        earlier = " UNION ALL ".join(f"SELECT * FROM k{j}" for j in range(k))
        unlike = f" AND (p_brand, child) NOT IN (SELECT (p_brand, child) FROM ({earlier}))" if k else ""
        taken.append(f"k{k} AS (SELECT p_brand, {k} AS slot, arg_min(child, attempt) AS child FROM f WHERE slot = {k}{unlike} GROUP BY p_brand)")
    return f"""WITH {GENOMES},
b AS (SELECT p_brand, max(genes) FILTER (o = 1) AS a, coalesce(max(genes) FILTER (o = 2), max(genes) FILTER (o = 1)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS o FROM g) GROUP BY p_brand),
t AS (SELECT *, CASE WHEN slot % 2 = 0 THEN a ELSE b END AS parent FROM b, ch, range(6) s(slot), range(16) n(attempt)),
m AS (SELECT p_brand, slot, attempt, CASE WHEN slot < 4 THEN mutant ELSE {crossed_sql('a', 'b', label)} END AS child FROM ({mutated_sql('t', 'parent', label)})),
f AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.p_brand = m.p_brand AND g.genes = m.child)),
{', '.join(taken)}
SELECT p_brand, CAST(slot AS INTEGER) AS slot, array_to_string(child, '|') AS child FROM ({' UNION ALL '.join(f'SELECT * FROM k{k}' for k in range(6))})"""


EVO03 = _evo03()


def manifests(s, d):
    frozen = read(s, d, "part").where("p_partkey % 7 <> 0").select(F.concat(F.when(F.col("p_partkey") % 13 == 0, F.lit("../")).otherwise(F.lit("")), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 17 == 0, "short").otherwise(F.sha2(F.col("p_name").cast("binary"), 256)).alias("sha256"))
    found = read(s, d, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.sha2(F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name")).cast("binary"), 256).alias("sha256"))
    return frozen, found


def aud01(s, d):
    return audits.compare_manifests(*manifests(s, d))


AUD01 = """WITH a AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN '../' ELSE '' END || p_partkey AS p, CASE WHEN p_partkey % 17 = 0 THEN 'short' ELSE sha256(p_name) END AS h FROM part WHERE p_partkey % 7 <> 0),
b AS (SELECT CAST(p_partkey AS VARCHAR) AS p, sha256(CASE WHEN p_partkey % 11 = 0 THEN p_name || 'x' ELSE p_name END) AS h FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p LIKE '../%' THEN 'escape' WHEN a.p IS NULL THEN 'extra' WHEN a.h = 'short' THEN 'malformed' WHEN b.p IS NULL THEN 'missing' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status FROM a FULL OUTER JOIN b ON a.p = b.p"""


def aud02(s, d):
    """One row of structural facts of the panel."""
    return panel(s, d).agg(F.count("*").alias("records"), F.count_distinct("case_id").alias("cases"), (F.count_distinct("case_id", "slot") == F.count("*")).alias("unique_slots"), (F.max("slot") <= 20).alias("within_budget"), F.count_if(F.col("answer").isNull()).alias("without_answer"))


AUD02 = f"WITH {PANEL} SELECT count(*) AS records, count(DISTINCT case_id) AS cases, count(DISTINCT (case_id, slot)) = count(*) AS unique_slots, max(slot) <= 20 AS within_budget, count(*) FILTER (answer IS NULL) AS without_answer FROM panel"


def aud04(s, d):
    a = scores.summary(scored(s, d), ["block"]).select("block", "n", "exact")
    b = a.withColumn("exact", F.when(F.col("block") == "2-HIGH", F.col("exact") + 1).otherwise(F.col("exact")))
    return audits.recompute(a, b)


AUD04 = f"WITH {PANEL}, {TRUTH}, {SCORED}, x AS (SELECT block, count(*) AS n, count(*) FILTER (exact) AS e FROM scored GROUP BY block) SELECT block, n, e AS exact, 'published' AS side FROM x WHERE block = '2-HIGH' UNION ALL SELECT block, n, e + 1, 'recomputed' FROM x WHERE block = '2-HIGH'"


def _rounds(s, d):
    """Nations by key as rounds; each names the digest of the one before, but for two."""
    n = read(s, d, "nation").select(F.col("n_nationkey").alias("round"), F.sha2(F.col("n_name").cast("binary"), 256).alias("digest"))
    w = Window.orderBy("round")
    return n.withColumn("parent", F.when(F.col("round").isin(7, 12), "wrong").otherwise(F.lag("digest").over(w)))


def aud07(s, d):
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    history = _rounds(s, d).withColumn("children", F.array(F.col("round"))).withColumn("members", F.when(F.col("round") == 20, F.array(F.lit(-1))).otherwise(F.array_sort(F.collect_list("round").over(w))))
    a = audits.chain_breaks(_rounds(s, d)).select("round", F.lit("chain").alias("kind"))
    return a.union(audits.history_breaks(history).select("round", F.lit("history").alias("kind")))


AUD07 = "SELECT n_nationkey AS round, 'chain' AS kind FROM nation WHERE n_nationkey IN (7, 12) UNION ALL SELECT n_nationkey, 'history' FROM nation WHERE n_nationkey IN (20, 21)"


def aud10(s, d):
    final = read(s, d, "supplier").select((F.col("s_suppkey") % 3).cast("int").alias("stage"), F.col("s_suppkey").alias("k"))
    stages = final.where("stage = 0").select(F.lit(0).alias("as_of"), "k").union(final.where("stage <= 1 and k % 10 <> 4").select(F.lit(1).alias("as_of"), "k"))
    return audits.cumulative(stages.where("k % 50 <> 3"), final, "stage", "k")


AUD10 = """WITH f AS (SELECT CAST(s_suppkey % 3 AS INTEGER) AS stage, s_suppkey AS k FROM supplier),
st AS (SELECT 0 AS as_of, k FROM f WHERE stage = 0 AND k % 50 <> 3 UNION ALL SELECT 1, k FROM f WHERE stage <= 1 AND k % 10 <> 4 AND k % 50 <> 3),
w AS (SELECT as_of, k FROM (VALUES (0), (1)) a(as_of) JOIN f ON stage <= as_of) SELECT *, 'final' AS side FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM st) UNION ALL SELECT *, 'stage' FROM (SELECT * FROM st EXCEPT ALL SELECT * FROM w)"""


def aud11(s, d):
    return audits.role_counts(panel(s, d), ["case_id"], {"proposer": 4, "critic": 1, "verifier": 1, "judge": 1})


AUD11 = f"""WITH {PANEL} SELECT case_id, count(*) AS jobs, {', '.join(f"count(*) FILTER (role = '{r}') AS {r}" for r in ('proposer', 'critic', 'verifier', 'judge'))} FROM panel GROUP BY case_id
HAVING count(*) <> 7 OR count(*) FILTER (role = 'proposer') <> 4 OR count(*) FILTER (role = 'critic') <> 1 OR count(*) FILTER (role = 'verifier') <> 1 OR count(*) FILTER (role = 'judge') <> 1"""


def aud12(s, d):
    l = ledger(s, d).withColumn("digest", F.col("job_id").cast("string"))
    r = read(s, d, "customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 10 == 0, "other").otherwise(F.col("c_custkey").cast("string")).alias("digest"))
    return audits.reconcile(l, r, "job_id")


AUD12 = f"""WITH {LEDGER}, a AS (SELECT job_id, count(*) FILTER (status = 'valid_output') > 0 AS ok FROM ledger GROUP BY job_id),
b AS (SELECT coalesce(job_id, c_custkey) AS job_id, coalesce(ok, false) AS ok, c_custkey IS NOT NULL AS res FROM a FULL OUTER JOIN customer c ON job_id = c_custkey)
SELECT job_id, CASE WHEN res AND NOT ok THEN 'result_without_attempt' WHEN NOT res THEN 'attempt_without_result' ELSE 'digest_differs' END AS problem FROM b WHERE (res AND NOT ok) OR (NOT res AND ok) OR (res AND ok AND job_id % 10 = 0)"""


def aud13(s, d):
    return audits.completeness(panel(s, d), "case_id", "slot", 4)


AUD13 = f"WITH {PANEL} SELECT case_id, count(*) AS n_rows, count(DISTINCT slot) AS cases FROM panel GROUP BY case_id HAVING count(*) <> 4 OR count(DISTINCT slot) <> 4"


def aud14(s, d):
    from quorate.plans.ranks import win03

    return win03(s, d).select("event_type", (F.col("peak") <= 20).alias("within_bound"))


def _aud14():
    from quorate.plans.ranks import WIN03

    return f"SELECT event_type, peak <= 20 AS within_bound FROM ({WIN03})"


def aud05(s, d):
    frozen, found = manifests(s, d)
    bad = audits.compare_manifests(frozen, found).where("status <> 'same'")
    return audits.named_checks({"freeze": bad, "slots": panel(s, d).groupBy("case_id", "slot").count().where("count > 1"), "roles": aud11(s, d)})


AUD05 = f"SELECT name, violations, violations = 0 AS passed FROM (SELECT 'freeze' AS name, count(*) AS violations FROM ({AUD01}) WHERE status <> 'same' UNION ALL SELECT 'slots', 0 UNION ALL SELECT 'roles', count(*) FROM ({AUD11}))"


def aud17(s, d):
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("a/__pycache__/x", ".git/x", "x.tmp", "x.py")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    return read(s, d, "part").groupBy(audits.file_class(path).alias("class")).agg(F.count("*").alias("n"))


AUD17 = "SELECT CASE p_partkey % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'hidden' WHEN 2 THEN 'temporary' ELSE 'kept' END AS class, count(*) AS n FROM part GROUP BY 1"


def rep01(s, d):
    """Accuracy and composition of all systems."""
    x = decided(s, d)
    return x.groupBy("method").agg(F.count("*").alias("cases"), F.count_if("exact").alias("exact"), F.count_if("override").alias("overrides"), F.count_if("harmful").alias("harmful"), F.round(F.count_if("exact") / F.count("*"), 9).alias("accuracy"))


def _rep01():
    from quorate.plans.votes import DEC

    parts = " UNION ALL ".join(f"SELECT case_id, '{m}' AS method, plurality, answer, override FROM ({q})" for m, q in DEC.items())
    return f"""WITH t AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority < '3' THEN 'R' ELSE 'N' END || '|' || o_orderstatus AS truth FROM orders), u AS ({parts})
SELECT method, count(*) AS cases, count(*) FILTER (answer = truth) AS exact, count(*) FILTER (override) AS overrides, count(*) FILTER (plurality = truth AND NOT coalesce(answer = truth, false)) AS harmful,
       round(CAST(count(*) FILTER (answer = truth) AS DOUBLE) / count(*), 9) AS accuracy FROM u JOIN t ON u.case_id = t.case_id GROUP BY method"""


REP01 = _rep01()


def rep02(s, d):
    return decided(s, d).groupBy("family", "method").agg(F.count("*").alias("cases"), F.count_if("exact").alias("exact"))


REP02 = f"WITH {SYSTEMS_SQL}, {TRUTH.replace('truth AS (', 'tr AS (', 1)} SELECT family, method, count(*) AS cases, count(*) FILTER (exact) AS exact FROM sys JOIN tr ON sys.case_id = tr.case_id GROUP BY family, method"


def ext_windows(s, d):
    """An extension that the ledgers do not have: events in windows of a day, by type."""
    e = read(s, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")["start"].cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    return e


EXT = "SELECT CAST(CAST(CAST(ts AS DATE) AS TIMESTAMP) AS VARCHAR) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"

QUERIES = {
    "AGG23_subset_search": (agg23, AGG23), "AGG23_forty": (agg23_forty, None), "AGG23_transfer": (agg23_transfer, AGG23_TRANSFER), "EVO01_mutation": (evo01, EVO01), "EVO02_crossover": (evo02, EVO02), "EVO01_generation": (evo03, EVO03), "EVO04_challenge": (evo04, EVO04), "EVO05_champion": (evo05, EVO05), "EVO06_policies": (evo06, EVO06), "EVO06_race": (evo06_race, EVO06_RACE), "EVO06_selectors": (evo06_selectors, EVO06_SELECTORS),
    "AUD01_manifests": (aud01, AUD01), "AUD02_structure": (aud02, AUD02), "AUD04_recompute": (aud04, AUD04), "AUD05_suite": (aud05, AUD05), "AUD07_chain": (aud07, AUD07), "AUD10_cumulative": (aud10, AUD10), "AUD11_roles": (aud11, AUD11), "AUD12_reconcile": (aud12, AUD12),
    "AUD13_completeness": (aud13, AUD13), "AUD14_concurrency": (aud14, _aud14()), "AUD17_file_classes": (aud17, AUD17), "REP01_accuracy": (rep01, REP01), "REP02_families": (rep02, REP02), "EXT_event_windows": (ext_windows, EXT),
}
