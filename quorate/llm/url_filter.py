"""URL filters: rules by host and path, and for all other urls link-graph propagation in DataFrame functions only.

Hosts are nodes. A host has an edge to each host that its pages name in an absolute link, and an edge to and from its
parent domain. Trust is personalised PageRank along the edges from hosts whose urls a rule allows; distrust is
personalised PageRank against the edges from hosts whose urls a rule blocks. A url without a rule is blocked if its
host's distrust exceeds its trust by the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm.common import Workspace, fresh

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, THRESHOLD = 0.85, 1.0
#: Rounds go on until one changes trust and distrust together, of a sum of 2 at most, by less than TOLERANCE; what is still to move
#: is then 6 times that at most. ROUNDS make sure of it, as a round's change is DAMPING times the last one's at most. CHECKED
#: rounds are one plan and one written table.
TOLERANCE = 2e-3
ROUNDS = math.ceil(math.log(TOLERANCE / 4) / math.log(DAMPING))
CHECKED = 4
#: A host with more edges than this sends to them in parts.
HOT = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def path(url: Column) -> Column:
    """What stands after the host up to ? # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits as (verdict, rule), or null; a rule fits its host and all subdomains and paths that begin with its own."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, start = rule.partition("/")[0], "/" + rule.partition("/")[2]
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of rows (__host, html): absolute links in the html, and both ways between a host and its parent domain."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)(?:href|src)\s*=\s*[\"']?(https?://[^\"'\s>]+)"), 1)
    named = pages.where(F.col("__host") != "").select(F.col("__host").alias("src"), F.explode(F.array_distinct(F.transform(links, host))).alias("dst"))
    named = named.where("dst <> '' and dst <> src").distinct()
    hosts = pages.select(F.col("__host").alias("h")).union(named.select("dst")).where("h <> ''").distinct()
    labels = F.split("h", r"\.")
    chain = hosts.select(labels.alias("l"), F.explode(F.sequence(F.lit(1), F.size(labels) - 1)).alias("i")).where(F.size("l") > F.col("i"))
    suffix = lambda i: F.array_join(F.slice("l", i, F.size("l")), ".")
    parent = chain.where("size(l) - i >= 2").select(suffix(F.col("i")).alias("src"), suffix(F.col("i") + 1).alias("dst")).distinct()
    return named.union(parent).union(parent.select("dst", "src")).distinct()


def propagate(graph: DataFrame, seeds: DataFrame, ws: Workspace, damping: float = DAMPING, tolerance: float = TOLERANCE, hot: int = HOT) -> DataFrame:
    """(host, trust, distrust) from (src, dst) and seeds (host, trust, distrust), each of sum 1 or 0.

    Each round sends a host's trust in equal parts along its outgoing edges and its distrust in equal parts against its incoming
    ones; what a host without such edges holds is not sent on. Rounds go on until the summed change is below the
    tolerance, so that hosts are reached however far they are from a seed, while what is beyond them is less than that.
    Contributions are summed by partial aggregates; the edges of a host with more than `hot` are dealt to several keys.
    """
    out_n = graph.groupBy("src").agg(F.count("*").alias("out_n")).withColumnRenamed("src", "o")
    in_n = graph.groupBy("dst").agg(F.count("*").alias("in_n")).withColumnRenamed("dst", "i")
    counted = graph.join(out_n, F.col("src") == F.col("o")).join(in_n, F.col("dst") == F.col("i"))
    arcs = counted.select(F.col("src").alias("from"), F.col("dst").alias("to"), (1 / F.col("out_n")).alias("t"), F.lit(0.0).alias("d"))
    arcs = arcs.union(counted.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (1 / F.col("in_n")).alias("d")))
    arcs = ws.save(arcs.groupBy("from", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "arcs")
    wide = arcs.groupBy("from").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("from").alias("w"), F.ceil(F.col("n") / hot).alias("parts"))
    wide = ws.save(wide, "wide")  # as many rows as there are hot hosts, the edges' number over `hot` at most
    split = wide.limit(1).count() > 0
    if split:
        arcs = arcs.join(wide, F.col("from") == F.col("w"), "left").withColumn("part", F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1)))).drop("w", "parts")
        arcs = ws.save(arcs, "parted")
    base = ws.save(seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust")), "seeds")
    state, k, change, sums = seeds, 0, tolerance, [F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")]
    while change >= tolerance:
        for _ in range(CHECKED):
            last, on = state, F.col("from") == F.col("host")
            if split:
                state = state.join(wide, F.col("host") == F.col("w"), "left").select("host", "trust", "distrust", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("h_part"))
                on &= F.col("part") == F.col("h_part")
            flow = arcs.join(state, on).select(F.col("to").alias("host"), (F.col("t") * F.col("trust") * damping).alias("trust"), (F.col("d") * F.col("distrust") * damping).alias("distrust"))
            flow = flow.union(base)
            state = flow.groupBy("host").agg(*sums)
        k += CHECKED
        # the last round's table has what was before beside it
        old = last.select("host", F.lit(0.0), F.lit(0.0), F.col("trust").alias("old_t"), F.col("distrust").alias("old_d"))
        both = flow.select("*", F.lit(0.0).alias("old_t"), F.lit(0.0).alias("old_d")).union(old).groupBy("host").agg(*sums, F.sum("old_t").alias("old_t"), F.sum("old_d").alias("old_d"))
        both = ws.save(both, f"state-{k}")
        change = both.agg(F.sum(F.abs(F.col("trust") - F.col("old_t")) + F.abs(F.col("distrust") - F.col("old_d")))).first()[0] or 0.0
        state = both.select("host", "trust", "distrust")
        ws.drop(f"state-{k - CHECKED}")
    return state


def judge(pages: DataFrame, ws: Workspace, url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of pages with host, path, rule and verdict.

    Urls that are null or lack :// have empty host and path; they, urls of hosts that propagation never reaches and hosts whose
    distrust equals their trust are allowed. Null or empty html has no links. Repeated rows count in the seeds as often as
    they occur. Columns of pages that are named like results are replaced. A host with a third of all pages is a row of its
    graph once.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    own, bad_host, hit = fresh("host", "bad", "rule")
    named = pages.select("*", host(F.col(url)).alias(own))
    ruled = matched(F.col(own), path(F.col(url)), rules)
    graph = ws.save(edges(named.select(F.col(own).alias("__host"), F.col(html).alias("html"))), "edges")
    seeds = named.select(F.col(own).alias("host"), ruled["verdict"].alias("v")).where("host <> ''").groupBy("host").agg(F.count_if(F.col("v") == "allow").alias("a"), F.count_if(F.col("v") == "block").alias("b"))
    seeds = ws.save(seeds, "seed-counts")
    all_a, all_b = seeds.agg(F.sum("a"), F.sum("b")).first()
    seeds = seeds.select("host", (F.col("a") / max(1, all_a or 0)).alias("trust"), (F.col("b") / max(1, all_b or 0)).alias("distrust"))
    ranks = propagate(graph, seeds, ws)
    bad = ranks.where(F.col("distrust") > F.col("trust") * threshold).select(F.col("host").alias(bad_host))
    bad = ws.save(bad, "bad")
    if bad.count() <= 100_000:  # else Spark's own choice of join
        bad = F.broadcast(bad)
    found = named.join(bad, F.col(own) == F.col(bad_host), "left").withColumn(hit, ruled)
    verdict = F.when(F.col(bad_host).isNotNull(), "block").otherwise("allow")
    return found.select(*[F.col(c) for c in pages.columns], F.col(own).alias("host"), path(F.col(url)).alias("path"), F.col(f"{hit}.rule").alias("rule"), F.coalesce(f"{hit}.verdict", verdict).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, Workspace(spark, "op8")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    start = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS x FROM pages),
q AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
u AS (
  SELECT page_id, html, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM q),
v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS v FROM u),
l AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?(https?://[^"''\s>]+)', 1)) AS link FROM u WHERE host <> ''),
n AS (
  SELECT DISTINCT src, translate(regexp_extract(substr(link, strpos(link, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM l),
nn AS (SELECT src, dst FROM n WHERE dst <> '' AND dst <> src),
hs AS (SELECT DISTINCT h FROM (SELECT host AS h FROM u UNION SELECT dst FROM nn) WHERE h <> ''),
ch AS (SELECT string_split(h, '.') AS l, unnest(range(1, len(string_split(h, '.')) - 1)) AS i FROM hs),
pa AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst FROM ch),
g AS (SELECT src, dst FROM nn UNION SELECT src, dst FROM pa UNION SELECT dst, src FROM pa),
ar AS (
  SELECT src AS f, dst AS t, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS wt, 0.0::DOUBLE AS wd FROM g
  UNION ALL SELECT dst, src, 0.0::DOUBLE, 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) FROM g),
se AS (
  SELECT host, count(*) FILTER (v = 'allow') * 1.0::DOUBLE / greatest(1, sum(count(*) FILTER (v = 'allow')) OVER ()) AS trust,
         count(*) FILTER (v = 'block') * 1.0::DOUBLE / greatest(1, sum(count(*) FILTER (v = 'block')) OVER ()) AS distrust
  FROM v WHERE host <> '' GROUP BY host),
z(k, host, trust, distrust) AS (
  SELECT 0, host, trust, distrust FROM se
  UNION ALL
  SELECT k + 1, host, sum(trust), sum(distrust) FROM (
    SELECT z.k, ar.t AS host, ar.wt * z.trust * {d} AS trust, ar.wd * z.distrust * {d} AS distrust FROM ar JOIN z ON ar.f = z.host WHERE z.k < {n}
    UNION ALL SELECT q.k, se.host, se.trust * {e}, se.distrust * {e} FROM se, (SELECT DISTINCT k FROM z WHERE k < {n}) q) GROUP BY k, host)"""
    end = f"""
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.v, CASE WHEN z.distrust > z.trust * {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN (SELECT * FROM z WHERE k = {ROUNDS}) z ON v.host = z.host
"""
    return start.replace("{n}", str(ROUNDS)).replace("{d}", f"{DAMPING}::DOUBLE").replace("{e}", f"{1 - DAMPING}::DOUBLE") + end


SQL = _sql()
