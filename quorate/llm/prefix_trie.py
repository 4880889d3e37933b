"""Prefix trie of conversations: distinct beginnings as nodes, with sums over subtrees by tree contraction.

A turn's place in its conversation comes from a range sort and counts by part, a beginning's identity from running sums of digests of
(place, turn), again by part, so that a conversation with any share of all turns is spread over tasks. Texts are read once, into
a digest and a length.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm.common import Workspace
from quorate.llm.tree_contraction import subtree_sums

#: Conversations take their first turns, fewer than SHARED, from the one whose number is theirs rounded down to GROUP.
GROUP, SHARED = 100, 6
_KEY = ["depth", "k0", "k1", "k2", "k3"]
_OWN = ["o0", "o1", "o2", "o3"]


def ordered(conversations: DataFrame, ws: Workspace, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, place, digest, chars): each turn's place from 1; parts are numbered in order, and a conversation may have several."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.substring(role_, 1, 32).alias("head"), digest.alias("digest"), F.char_length(text_).cast("long").alias("chars"))
    rows = ws.save(rows.repartitionByRange("conv", "turn", "head", "digest").withColumn("part", F.spark_partition_id()), "turns")
    within = F.row_number().over(Window.partitionBy("conv", "part").orderBy("turn", "head", "digest"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("conv", "part").agg(F.count("*").alias("n")).select("conv", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.withColumn("within", within).join(parts, ["conv", "part"])
    return placed.select("conv", "part", (F.col("before") + F.col("within")).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation's first turns come from the one that it shares them with.

    Conversations are (conv, length); turns (conv, part, depth, digest, chars, length), the shared ones in part -1.
    """
    sizes = ws.save(turns.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    share = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    base = sizes.where(F.col("conv") % GROUP == 0).toDF("base", "base_n")
    convs = sizes.select("conv", "n", share.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("of")).join(base, F.col("of") == F.col("base"), "left")
    convs = convs.withColumn("got", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = ws.save(convs.select("conv", "of", "h", "got", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    heads = turns.where((F.col("conv") % GROUP == 0) & (F.col("place") < SHARED)).select(F.col("conv").alias("of"), "place", "digest", "chars")
    first = heads.join(convs, "of").where(F.col("place") <= F.col("got")).select("conv", F.lit(-1).alias("part"), F.col("place").alias("depth"), "digest", "chars", "length")
    own = turns.join(convs, "conv").where(F.col("place") > F.col("h")).select("conv", "part", (F.col("got") + F.col("place") - F.col("h")).alias("depth"), "digest", "chars", "length")
    return ws.save(first.union(own), "rebuilt"), convs.select("conv", "length")


def beginnings(turns: DataFrame, convs: DataFrame, ws: Workspace) -> DataFrame:
    """(conv, last, chars, depth, k0 to k3, o0 to o3): a row per conversation and depth from 0; k name the beginning, k less o its parent.

    k are running sums of four 32-bit digests of (place, turn), 128 bits in all, which differ for different beginnings of one length.
    """
    hashes = [F.xxhash64(F.lit(i), F.col("depth"), F.col("digest")) for i in range(2)]
    lanes = [lane for h in hashes for lane in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    rows = turns.select("conv", "part", "depth", "chars", "length", *[lane.alias(o) for lane, o in zip(lanes, _OWN, strict=True)])
    inside = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv", "part").agg(*[F.sum(o).alias(o) for o in _OWN]).select("conv", "part", *[F.coalesce(F.sum(o).over(earlier), F.lit(0)).alias(f"before_{o}") for o in _OWN])
    summed = rows.select("*", *[F.sum(o).over(inside).alias(f"within_{o}") for o in _OWN]).join(parts, ["conv", "part"])
    keys = [(F.col(f"before_{o}") + F.col(f"within_{o}")).alias(k) for o, k in zip(_OWN, _KEY[1:], strict=True)]
    below = summed.select("conv", (F.col("depth") == F.col("length")).alias("last"), "chars", F.col("depth").cast("long").alias("depth"), *keys, *_OWN)
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", (F.col("length") == 0).alias("last"), zero.alias("chars"), zero.alias("depth"), *[zero.alias(c) for c in (*_KEY[1:], *_OWN)])
    return ws.save(below.union(roots), "beginnings")


def ends(rows: DataFrame, nodes: DataFrame, ws: Workspace) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: the digest of their numbers in order, joined by commas.

    A node's conversations are range sorted and joined to text by part; parts are hashed one after another, so that a task holds one of
    them at a time. A digest needs its bytes in order, so the parts of one node are read by one task, as a stream.
    """
    found = rows.where("last").join(nodes.select("node", *_KEY), _KEY).select("node", "conv")
    found = ws.save(found.repartitionByRange("node", "conv").withColumn("part", F.spark_partition_id()), "ends")
    texts = found.groupBy("node", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    several = Window.partitionBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    texts = ws.save(texts.withColumn("parts", F.count("*").over(several)), "end-texts")

    def hashed(batches):
        node, state = None, None
        for pdf in batches:
            for n, ids in zip(pdf.node.to_numpy(), pdf.ids, strict=True):
                if n != node:
                    if state is not None:
                        yield pd.DataFrame({"node": [node], "ends_sha256": [state.hexdigest()]})
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield pd.DataFrame({"node": [node], "ends_sha256": [state.hexdigest()]})

    long = texts.where("parts > 1").repartition("node").sortWithinPartitions("node", "part").select("node", "ids")
    return texts.where("parts = 1").select("node", F.sha2("ids", 256).alias("ends_sha256")).union(long.mapInPandas(hashed, "node long, ends_sha256 string"))


def trie(conversations: DataFrame, ws: Workspace, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per distinct beginning of the rebuilt conversations, with its members, its children and sums over its subtree.

    Turns are in order of turn, null first, then role, then SHA-256 of the turn's role and text; equal rows are turns of their
    own. Null role and text are empty. Rows without a conversation are left out; a conversation whose turns all are replaced by
    none ends at the root. An empty table has no root. Other columns aren't read. Texts of any length are read whole, one row at a
    time. A conversation, a turn or a beginning may hold any share of the rows.
    """
    turns, convs = rebuilt(ws.save(ordered(conversations, ws, conv, turn, role, text), "ordered"), ws)
    rows = beginnings(turns, convs, ws)
    nodes = rows.groupBy(*_KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *[F.max(o).alias(o) for o in _OWN])
    nodes = ws.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    up = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), *[F.col(k).alias(f"p_{k}") for k in _KEY])
    on = (F.col("depth") - 1 == F.col("p_depth")) & F.expr(" and ".join(f"{k} - {o} = p_{k}" for k, o in zip(_KEY[1:], _OWN, strict=True)))
    tree = ws.save(nodes.join(up, on, "left").select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "chars"), "edges")
    kids = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "of")
    tree = tree.join(kids, F.col("node") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tree = ws.save(tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")), "tree")
    sums = subtree_sums(tree, ["n_leaves", "saved_tokens"], ws).withColumnRenamed("node", "of")
    out = tree.drop("n_leaves", "saved_tokens").join(sums, F.col("node") == F.col("of")).drop("of")
    out = out.join(ends(rows, nodes, ws).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Workspace(spark, "op12"))


SQL = r"""
WITH RECURSIVE shifts(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM shifts WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM shifts WHERE k = 8),
tu AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
dg AS (SELECT c, turn, role, sha256(length(role) || ':' || role || text) AS dig, length(text) AS chars FROM tu),
o AS (SELECT c, dig, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role[1:32], dig) AS pos FROM dg),
cv AS (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM o GROUP BY c),
crc(c, s, k, v) AS (
  SELECT c, s, 1, CAST(4294967295 AS BIGINT) FROM cv
  UNION ALL SELECT c, s, k + 1, xor(v >> 8, t[CAST(xor(v, ascii(s[k])) & 255 AS BIGINT) + 1]) FROM crc, tab WHERE k <= length(s)),
hh AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = length(s) + 1),
g AS (SELECT cv.c, cv.n, h, cv.c - cv.c % 100 AS b, least(h, coalesce(bs.n, 0)) AS got FROM cv JOIN hh ON hh.c = cv.c LEFT JOIN cv bs ON bs.c = cv.c - cv.c % 100),
rb AS (
  SELECT g.c, o.pos AS d, o.dig, o.chars FROM g JOIN o ON o.c = g.b AND o.pos <= g.got
  UNION ALL SELECT g.c, g.got + o.pos - g.h, o.dig, o.chars FROM g JOIN o ON o.c = g.c AND o.pos > g.h),
pr AS (
  SELECT c, d, chars, list(dig) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS key, d = max(d) OVER (PARTITION BY c) AS last FROM rb
  UNION ALL SELECT c, 0, 0, [], c NOT IN (SELECT c FROM rb) FROM cv),
nd AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM pr GROUP BY key, d),
ed AS (SELECT nd.*, p.conv_id AS parent FROM nd LEFT JOIN nd p ON nd.d > 0 AND p.d = nd.d - 1 AND p.key = nd.key[:nd.d - 1]),
kd AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM ed WHERE d > 0 GROUP BY ALL),
tr AS (SELECT ed.*, coalesce(n_children, 0) AS n_children FROM ed LEFT JOIN kd USING (conv_id, d)),
su AS (
  SELECT a.conv_id, a.d, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved
  FROM tr u JOIN pr ON pr.c = u.conv_id AND pr.d <= u.d JOIN tr a ON a.d = pr.d AND a.key = pr.key GROUP BY ALL)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM tr JOIN su USING (conv_id, d)
"""
