"""Statistics over paired document rules and order decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorate.operators import resampling, stats
from quorate.plans.fixtures import read
from quorate.plans.scores import SYSTEMS_SQL, decided

#: Replicates and sign patterns of the queries; the operators' own defaults.
ROUNDS, FLIPS, SEED = stats.REPLICATES, stats.FLIPS, "quorate"


def paired(s, d):
    """Two rules on labelled documents, right (1) or wrong (0): long texts are good; English texts are good."""
    docs = read(s, d, "documents").join(read(s, d, "labels"), "doc_id")
    right = lambda c: F.when(c.cast("int") == F.col("quality"), 1).otherwise(0)
    return docs.select(F.col("doc_id").alias("case_id"), F.col("lang").alias("stratum"), right(F.col("n_chars") > 2000).alias("a"), right(F.col("lang") == "en").alias("b"), "n_chars").withColumn("diff", F.col("b") - F.col("a"))


PAIRED = """pd AS (
  SELECT *, b - a AS diff FROM (
    SELECT doc_id AS case_id, lang AS stratum, CASE WHEN CAST(n_chars > 2000 AS INTEGER) = quality THEN 1 ELSE 0 END AS a, CASE WHEN CAST(lang = 'en' AS INTEGER) = quality THEN 1 ELSE 0 END AS b, n_chars
    FROM documents JOIN labels USING (doc_id)))"""


def _boot_sql(stratum: str = "stratum", metrics=("a", "b")) -> str:
    """CTE bs (replicate, metrics): bootstraps by class counts of pd, a step at a time."""
    names = ", ".join(metrics)
    text = ", ".join(f"coalesce(CAST({m} AS VARCHAR), '')" for m in metrics)
    return f"""cl AS MATERIALIZED (SELECT CAST({stratum} AS VARCHAR) AS stratum, {names}, count(*) AS n FROM pd GROUP BY ALL),
pn AS MATERIALIZED (SELECT stratum, CAST(ceil(sum(n) / {resampling.POOL}) AS BIGINT) AS pools FROM cl WHERE n < {resampling.HEAVY} GROUP BY stratum),
lt AS MATERIALIZED (SELECT cl.*, CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 13) AS BIGINT) % pools AS pool FROM cl JOIN pn ON pn.stratum = cl.stratum WHERE n < {resampling.HEAVY}),
it AS MATERIALIZED (
  SELECT stratum, pool, n, mn, row_number() OVER (PARTITION BY stratum ORDER BY pool, mn) - 1 AS item FROM (
    SELECT stratum, -1 AS pool, n, [{names}] AS mn FROM cl WHERE n >= {resampling.HEAVY} UNION ALL SELECT stratum, pool, CAST(sum(n) AS BIGINT), min([{names}]) FROM lt GROUP BY stratum, pool)),
ce AS MATERIALIZED (SELECT stratum, pool, {names}, row_number() OVER (PARTITION BY stratum, pool ORDER BY {names}) - 1 AS pos FROM (SELECT *, unnest(range(n)) FROM lt)),
dp AS MATERIALIZED (SELECT greatest(1, CAST(floor(log2(greatest(1, max(item)))) AS INTEGER) + CASE WHEN max(item) > 0 THEN 1 ELSE 0 END) AS depth FROM it),
sp AS MATERIALIZED (
  SELECT stratum, level, item >> (depth - level) AS node, sum(CASE WHEN (item >> (depth - level - 1)) & 1 = 0 THEN n ELSE 0 END)::BIGINT AS part, sum(n)::BIGINT AS whole FROM it, dp, range(32) l(level) WHERE level < depth GROUP BY ALL),
st AS MATERIALIZED (SELECT replicate, stratum, k FROM (SELECT stratum, sum(n)::BIGINT AS k FROM it GROUP BY stratum), range({ROUNDS}) t(replicate)),
{resampling.binomial_sql("st", "sp", SEED)},
lf AS MATERIALIZED (SELECT replicate, t.stratum, it.item, it.pool, it.n, it.mn, t.k FROM tree t JOIN dp ON t.level = dp.depth JOIN it ON it.stratum = t.stratum AND it.item = t.node WHERE t.attempt = 0),
dr AS ({resampling.pool_sql("lf", SEED)}),
al AS (
  SELECT replicate, k, {', '.join(f'k * mn[{i + 1}] AS {m}' for i, m in enumerate(metrics))} FROM lf WHERE pool < 0
  UNION ALL SELECT replicate, 1, {names} FROM dr JOIN ce ON ce.stratum = dr.stratum AND ce.pool = dr.pool AND ce.pos = dr.pos),
bs AS (SELECT replicate, {', '.join(f'CAST(sum({m}) AS DOUBLE) / sum(k) AS {m}' for m in metrics)} FROM al GROUP BY replicate)"""


def r9(c):
    return F.round(c, 9).alias(c)


def p9(p):
    """A p rounded; exact tests give sums of powers of a half, and the nudge keeps these off the middle between two roundings."""
    return F.round(p + 1e-12, 9).alias("p")


def stat01(s, d):
    p = F.array(*[F.lit(x) for x in (0.025, 0.25, 0.5, 0.9)])
    got = read(s, d, "documents").groupBy("lang").agg(F.percentile("n_chars", p).alias("q"))
    return got.select("lang", *[F.round(F.get("q", F.lit(i)), 9).alias(n) for i, n in enumerate(("p025", "p25", "p50", "p90"))])


STAT01 = "SELECT lang, " + ", ".join(f"round(quantile_cont(n_chars, {p}), 9) AS {n}" for p, n in ((0.025, "p025"), (0.25, "p25"), (0.5, "p50"), (0.9, "p90"))) + " FROM documents GROUP BY lang"


def stat02(s, d):
    return stats.floor_percentiles(read(s, d, "documents"), "lang", "n_chars", {"p30": 0.3, "p975": 0.975})


STAT02 = "WITH l AS (SELECT lang, list(n_chars ORDER BY n_chars) AS v FROM documents GROUP BY lang) SELECT lang, v[CAST(floor((len(v) - 1) * 0.3) AS BIGINT) + 1] AS p30, v[CAST(floor((len(v) - 1) * 0.975) AS BIGINT) + 1] AS p975 FROM l"


def stat03(s, d):
    return read(s, d, "documents").groupBy("lang").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias("p95"))


STAT03 = "SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY lang"


def boot(s, d):
    return resampling.bootstrap(paired(s, d), ["a", "b"], ROUNDS, SEED)


def stat04(s, d):
    return stats.interval(boot(s, d), "b").select(r9("low"), r9("high"))


STAT04 = f"WITH RECURSIVE {PAIRED}, {_boot_sql()} SELECT round(quantile_cont(b, 0.025), 9) AS low, round(quantile_cont(b, 0.975), 9) AS high FROM bs"


def stat05(s, d):
    return boot(s, d).select("replicate", r9("a"), r9("b"))


STAT05 = f"WITH RECURSIVE {PAIRED}, {_boot_sql()} SELECT CAST(replicate AS INTEGER) AS replicate, round(a, 9) AS a, round(b, 9) AS b FROM bs"


def stat06(s, d):
    both = paired(s, d).withColumn("stratum", F.concat_ws(":", "stratum", (F.col("case_id") % 3).cast("string")))
    return resampling.bootstrap(both, ["diff"], ROUNDS, SEED).select("replicate", r9("diff"))


STAT06 = f"WITH RECURSIVE pd0 AS (WITH {PAIRED} SELECT * FROM pd), pd AS (SELECT * REPLACE (stratum || ':' || (case_id % 3) AS stratum) FROM pd0), {_boot_sql(metrics=('diff',))} SELECT CAST(replicate AS INTEGER) AS replicate, round(diff, 9) AS diff FROM bs"


def stat07(s, d):
    one = paired(s, d).withColumn("stratum", F.lit("all"))
    blocks = paired(s, d).groupBy("stratum").agg(F.sum("diff").alias("diff"), F.count("*").alias("n")).select(F.col("stratum").alias("case_id"), F.lit("blocks").alias("stratum"), "diff", "n")
    whole = resampling.bootstrap(one, ["diff"], ROUNDS, SEED).select("replicate", F.round("diff", 9).alias("by_case"))
    clusters = resampling.bootstrap(blocks, ["diff", "n"], ROUNDS, SEED).select("replicate", F.round(F.col("diff") / F.col("n"), 9).alias("by_block"))
    return whole.join(clusters, "replicate")


STAT07 = f"""WITH x AS (WITH {PAIRED} SELECT * FROM pd),
one AS (WITH RECURSIVE pd AS (SELECT * REPLACE ('all' AS stratum) FROM x), {_boot_sql(metrics=('diff',))} SELECT * FROM bs),
two AS (WITH RECURSIVE pd AS (SELECT stratum AS case_id, 'blocks' AS stratum, sum(diff) AS diff, count(*) AS n0 FROM x GROUP BY x.stratum), {_boot_sql(metrics=('diff', 'n0'))} SELECT * FROM bs)
SELECT CAST(one.replicate AS INTEGER) AS replicate, round(one.diff, 9) AS by_case, round(two.diff / two.n0, 9) AS by_block FROM one JOIN two ON one.replicate = two.replicate"""


def discordant(s, d):
    return paired(s, d).groupBy(F.col("stratum").alias("test")).agg(F.count_if(F.col("diff") < 0).alias("only_a"), F.count_if(F.col("diff") > 0).alias("only_b"))


def stat08(s, d):
    return discordant(s, d).select("test", "only_a", "only_b", p9(stats.mcnemar(F.col("only_a"), F.col("only_b"))))


MCNEMAR = """mc AS (
  SELECT test, only_a, only_b, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END AS p
  FROM (SELECT test, only_a, only_b, only_a + only_b AS n, least(only_a, only_b) AS k FROM (SELECT stratum AS test, count(*) FILTER (diff < 0) AS only_a, count(*) FILTER (diff > 0) AS only_b FROM pd GROUP BY stratum)))"""
STAT08 = f"WITH {PAIRED}, {MCNEMAR} SELECT test, only_a, only_b, round(p + 1e-12, 9) AS p FROM mc"


def stat09(s, d):
    tests = discordant(s, d).select("test", p9(stats.mcnemar(F.col("only_a"), F.col("only_b"))))
    return stats.holm(tests).select("test", "p", r9("adjusted"))


STAT09 = f"""WITH {PAIRED}, {MCNEMAR}, t AS (SELECT test, round(p + 1e-12, 9) AS p FROM mc),
r AS (SELECT test, p, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p) AS w FROM t)
SELECT test, p, round(max(w) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM r"""


def stat10(s, d):
    """Exactly over the sums of blocks, of which there are few by nature, and sampled over all cases."""
    blocks = paired(s, d).groupBy(F.col("stratum").alias("case_id")).agg(F.sum("diff").alias("diff"))
    exact = stats.sign_flip_exact(blocks).select(F.lit("exact").alias("kind"), F.col("patterns").alias("n"), r9("p"))
    sampled = stats.sign_flip_sampled(paired(s, d), FLIPS, SEED).select(F.lit("sampled").alias("kind"), F.col("rounds").alias("n"), r9("p"))
    return exact.union(sampled)


STAT10 = f"""WITH {PAIRED},
o AS (SELECT diff, row_number() OVER (ORDER BY case_id) - 1 AS i FROM (SELECT stratum AS case_id, sum(diff) AS diff FROM pd GROUP BY stratum HAVING sum(diff) <> 0)),
f AS (SELECT p, abs(sum(CASE WHEN (p >> i) % 2 = 1 THEN -diff ELSE diff END)) AS s, abs(sum(diff)) AS t FROM o, (SELECT unnest(range(CAST(pow(2, (SELECT count(*) FROM o)) AS BIGINT))) AS p) GROUP BY p),
z AS (SELECT count(*) AS n, abs(sum(diff)) AS t FROM pd WHERE diff <> 0),
w AS (SELECT n, t, unnest(range((n + 59) // 60)) AS place FROM z),
g AS (
  SELECT r, abs(any_value(n) - 2 * sum(bit_count(CAST('0x' || substr(md5('{SEED}|' || r || '|1.000000|' || place), 1, 15) AS BIGINT) & CASE WHEN n - place * 60 < 60 THEN (1::BIGINT << (n - place * 60)::INTEGER) - 1 ELSE (1::BIGINT << 60) - 1 END))) AS s, any_value(t) AS t
  FROM w, range({FLIPS}) q(r) GROUP BY r)
SELECT 'exact' AS kind, count(*) AS n, round(CAST(count(*) FILTER (s >= t) AS DOUBLE) / count(*), 9) AS p FROM f
UNION ALL SELECT 'sampled', count(*), round(CAST(count(*) FILTER (s >= t) + 1 AS DOUBLE) / (count(*) + 1), 9) FROM g"""


def stat11(s, d):
    b = resampling.bootstrap(paired(s, d), ["diff"], ROUNDS, SEED).withColumn("diff", F.round("diff", 12))
    q = b.agg(*[F.percentile("diff", F.lit(p)).alias(n) for p, n in ((0.025, "low"), (0.975, "high"), (0.05, "low90"), (0.95, "high90"))])
    return q.select(stats.classification(*[F.col(c) for c in ("low", "high", "low90", "high90")]).alias("verdict"))


STAT11 = f"""WITH RECURSIVE {PAIRED}, {_boot_sql(metrics=('diff',))},
q AS (SELECT quantile_cont(round(diff, 12), 0.025) AS l, quantile_cont(round(diff, 12), 0.975) AS h, quantile_cont(round(diff, 12), 0.05) AS l9, quantile_cont(round(diff, 12), 0.95) AS h9 FROM bs)
SELECT CASE WHEN l > 0 OR h < 0 THEN 'superior' WHEN l9 >= -0.1 AND h9 <= 0.1 THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM q"""


def pairs_of_systems(s, d):
    """All pairs of systems over the cases that both decide."""
    names = ["deliberative", "dual", "gated", "judge", "verified"]
    wide = decided(s, d).groupBy("case_id").pivot("method", names).agg(F.max(F.col("exact").cast("int")))
    return stats.contrasts(wide, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]])


def stat12(s, d):
    """The family of all pairs of systems: estimates, exact tests and their joint correction."""
    p = p9(stats.mcnemar(F.col("losses"), F.col("wins")))
    return stats.holm(pairs_of_systems(s, d).withColumn("p", p), key="contrast").select("contrast", r9("estimate"), "wins", "losses", "ties", "p", r9("adjusted"))


_FAMILY = f"""WITH {SYSTEMS_SQL},
c AS (
  SELECT y.method || '-' || x.method AS contrast, CAST(sum(CAST(y.exact AS INTEGER) - CAST(x.exact AS INTEGER)) AS DOUBLE) / count(*) AS estimate, count(*) FILTER (y.exact AND NOT x.exact) AS wins, count(*) FILTER (x.exact AND NOT y.exact) AS losses, count(*) FILTER (x.exact = y.exact) AS ties
  FROM sys x JOIN sys y ON x.case_id = y.case_id AND x.method < y.method GROUP BY 1)"""
STAT12 = f"""{_FAMILY},
p AS (
  SELECT *, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END + 1e-12, 9) AS p
  FROM (SELECT *, wins + losses AS n, least(wins, losses) AS k FROM c)),
r AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, contrast) + 1) * p) AS w FROM p)
SELECT contrast, round(estimate, 9) AS estimate, wins, losses, ties, p, round(max(w) OVER (ORDER BY p, contrast ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM r"""


def stat13(s, d):
    return stats.block_sensitivity(paired(s, d).groupBy("stratum").agg(F.sum("diff").alias("diff"), F.count("*").alias("n")))


STAT13 = f"""WITH {PAIRED}, b AS (SELECT stratum, sum(diff) AS diff, count(*) AS n FROM pd GROUP BY stratum), s AS (SELECT sum(diff) AS net, max(CAST(diff AS DOUBLE) / n) AS hi, min(CAST(diff AS DOUBLE) / n) AS lo, max(abs(diff)) AS most FROM b)
SELECT bool_or((net - diff) * net < 0) AS direction_changes, any_value(most >= 0.75 * abs(net)) AS concentrated, any_value(hi - lo >= 0.3) AS wide_spread FROM b, s"""


def stat14(s, d):
    b = resampling.bootstrap(paired(s, d).withColumn("b", F.col("n_chars")).withColumn("a", F.col("a") + 1), ["a", "b"], ROUNDS, SEED)
    return b.select("replicate", F.round(stats.log_ratio(F.col("a"), F.col("b")), 6).alias("log_ratio"))


STAT14 = f"WITH RECURSIVE pd0 AS (WITH {PAIRED} SELECT * FROM pd), pd AS (SELECT case_id, stratum, a + 1 AS a, n_chars AS b FROM pd0), {_boot_sql()} SELECT CAST(replicate AS INTEGER) AS replicate, round(ln(b / a), 6) AS log_ratio FROM bs"


def stat15(s, d):
    return pairs_of_systems(s, d).select("contrast", r9("estimate"))


STAT15 = f"{_FAMILY} SELECT contrast, round(estimate, 9) AS estimate FROM c"


def stat16(s, d):
    return paired(s, d).groupBy("stratum").agg(F.count_if(F.expr("b > a")).alias("wins"), F.count_if(F.expr("b < a")).alias("losses"), F.count_if(F.expr("a = b")).alias("ties"), F.count_if(F.expr("a = 1 and b = 1")).alias("both"), F.count_if(F.expr("a = 0 and b = 0")).alias("neither"))


STAT16 = f"WITH {PAIRED} SELECT stratum, count(*) FILTER (b > a) AS wins, count(*) FILTER (b < a) AS losses, count(*) FILTER (a = b) AS ties, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 0 AND b = 0) AS neither FROM pd GROUP BY stratum"


def stat17(s, d):
    one = paired(s, d).agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"), F.count_distinct("stratum").alias("k"))
    return stats.checks(one, {"enough_cases": F.col("n") >= 50, "a_above_half": F.col("a") > 0.5, "b_above_a": F.col("b") > F.col("a"), "strata": F.col("k").between(2, 10)})


STAT17 = f"""WITH {PAIRED}, o AS (SELECT count(*) >= 50 AS c1, avg(a) > 0.5 AS c2, avg(b) > avg(a) AS c3, count(DISTINCT stratum) BETWEEN 2 AND 10 AS c4 FROM pd)
SELECT unnest(['enough_cases', 'a_above_half', 'b_above_a', 'strata', 'all']) AS name, unnest([c1, c2, c3, c4, c1 AND c2 AND c3 AND c4]) AS passed FROM o"""

QUERIES = {
    "STAT01_percentile_linear": (stat01, STAT01), "STAT02_percentile_floor": (stat02, STAT02), "STAT03_percentile_nearest": (stat03, STAT03), "STAT04_interval": (stat04, STAT04), "STAT05_stratified_bootstrap": (stat05, STAT05),
    "STAT06_two_way_strata": (stat06, STAT06), "STAT07_cluster_bootstrap": (stat07, STAT07), "STAT08_mcnemar": (stat08, STAT08), "STAT09_holm": (stat09, STAT09), "STAT10_sign_flip": (stat10, STAT10), "STAT11_equivalence": (stat11, STAT11),
    "STAT12_family": (stat12, STAT12), "STAT13_block_sensitivity": (stat13, STAT13), "STAT14_log_ratio": (stat14, STAT14), "STAT15_all_pairs": (stat15, STAT15), "STAT16_wins": (stat16, STAT16), "STAT17_checks": (stat17, STAT17),
}
