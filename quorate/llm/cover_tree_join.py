"""Near duplicates among embeddings: a cover tree, traversed in pairs.

Equal vectors of a label are one point. A label's points are a node; a node with more points than a block holds is divided among
centres that a net of halving radii gives on a bounded sample of it, and so on level by level in Spark, until each node is
a block. Every node has a covering ball, from its blocks' true radii upwards. Pairs of nodes are then descended level by
level from the top: a pair whose balls are farther apart than the threshold is dropped, any other goes on to the pairs of its
children. Pairs of blocks are descended by trees of their own, the same levels continued: a pair of nodes too far apart
for their radii is dropped, a pair close enough for all their points is taken whole, any other goes on to its children, and
points meet by their cosine in the end. Samples and centres decide only how much is pruned; the pairs are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm.common import Workspace, components

COSINE = 0.93
#: Points of a block, children of a node at most, rows that a node's centres are picked from, and of a node that one task deals out.
BLOCK, FAN, SAMPLE, PART = 2000, 64, 1200, 50_000
#: Radii of the levels on the unit sphere; below the last one each point is a node.
RADII = (2.0, 1.0, 0.5, 0.25, 0.125)
#: Distances are computed with an error well below this; bounds give way by it, so that cosines decide.
MARGIN = 1e-6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ v.T)))


def apart(a: str, b: str) -> Column:
    """Distance of two columns' vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def net(d: np.ndarray, radius: float, first: list[int]) -> list[int]:
    """Centres among points with distances d, `first` included, such that each point is within radius of one and later ones are apart."""
    centres, open_ = list(first), np.ones(len(d), bool)
    for c in first:
        open_ &= d[c] > radius
    while open_.any():
        c = int(open_.argmax())
        centres.append(c)
        open_ &= d[c] > radius
    return centres


class Tree:
    """A cover tree of a block of unit vectors, as one array per level.

    centres[l]: points that are centres of level l, those of the level above among them; node[l][i]: the centre, by place, that
    point i belongs to; parent[l]: place of each centre's node one level up; radius[l]: its farthest point's distance.
    A last level has every point as a node.
    """

    def __init__(self, u: np.ndarray, radii=RADII):
        n = len(u)
        d = distances(u, u)
        self.centres, self.node, self.parent, self.radius = [], [], [], []
        up = np.zeros(n, int)  # the node above of each point
        held: list[int] = []
        for r in (*radii, 0.0):
            if r == 0.0:
                held, node = list(range(n)), np.arange(n)
            else:
                held = net(d, r, held)
                near = d[:, held]
                if self.centres:  # a point stays within the node above, unless no centre there covers it
                    own = up[held]
                    near = np.where(own[None, :] == up[:, None], near, near + 8.0)
                node = near.argmin(axis=1)
            c = np.array(held)
            self.centres.append(c)
            self.node.append(node)
            self.parent.append(up[c])
            away = d[np.arange(n), c[node]] if r else np.zeros(n)
            size = np.zeros(len(c))
            np.maximum.at(size, node, away)
            self.radius.append(size)
            up = node


def links(a: np.ndarray, ua: np.ndarray, ta: Tree, b: np.ndarray, ub: np.ndarray, tb: Tree, cosine: float = COSINE) -> np.ndarray:
    """Which points of block a link with which of block b: both trees are descended level by level."""
    far = math.sqrt(2 - 2 * cosine)
    out = np.zeros((len(a), len(b)), bool)
    alive = np.ones((1, 1), bool)
    for level in range(len(ta.centres)):
        ca, cb = ta.centres[level], tb.centres[level]
        here = alive[np.ix_(ta.parent[level], tb.parent[level])] if level else np.ones((len(ca), len(cb)), bool)
        rows, cols = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
        if not len(rows):
            return out
        last = level == len(ta.centres) - 1
        part = here[np.ix_(rows, cols)]
        if last:
            x, y = a[ca[rows]], b[cb[cols]]
            cos = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
            out[np.ix_(ca[rows], cb[cols])] |= part & (cos >= cosine)
            return out
        d = distances(ua[ca[rows]], ub[cb[cols]])
        reach = ta.radius[level][rows][:, None] + tb.radius[level][cols][None, :]
        taken = part & (d + reach <= far - MARGIN)
        if taken.any():
            whole = np.zeros_like(here)
            whole[np.ix_(rows, cols)] = taken
            out |= whole[np.ix_(ta.node[level], tb.node[level])]
        alive = np.zeros_like(here)
        alive[np.ix_(rows, cols)] = part & ~taken & (d - reach <= far + MARGIN)
    return out


def spanning(m: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links, by row and column, that connect what the matrix connects: the first of each row and of each column's rest."""
    found = set()
    rows = np.flatnonzero(m.any(axis=1))
    cols = np.flatnonzero(m.any(axis=0))
    found |= {(int(i), int(j)) for i, j in zip(rows, m[rows].argmax(axis=1), strict=True)}
    found |= {(int(i), int(j)) for i, j in zip(m[:, cols].argmax(axis=0), cols, strict=True)}
    # rows that share a column but start elsewhere: walk the classes that are found so far and join those a link crosses
    label = np.arange(m.shape[0] + m.shape[1])

    def top(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    off = 0 if same else m.shape[0]
    for i, j in found:
        label[top(j + off)] = top(i)
    roots = np.array([top(x) for x in range(len(label))])
    for i in rows:
        js = np.flatnonzero(m[i])
        other = js[roots[js + off] != roots[i]]
        for j in other:
            if top(int(j) + off) != top(int(i)):
                label[top(int(j) + off)] = top(int(i))
                found.add((int(i), int(j)))
    return sorted(found)


def pick(sample: np.ndarray, most: int, radii=RADII) -> np.ndarray:
    """Centres among sampled unit vectors: those of the first level of halving radii that has `most` or more, and these `most` at most."""
    d, held = distances(sample, sample), [0]
    for r in radii:
        more = net(d, r, held)
        held = more[:most]
        if len(more) >= most:
            break
    return sample[held]


def grown(points: DataFrame, ws: Workspace, block: int) -> tuple[DataFrame, int]:
    """(points with path, depth): a node is a label and a path of child numbers, and no node has more than `block` points.

    A level's big nodes are dealt out in parts of bounded size, each together with its node's centres. Where a sample gives
    one centre only, all points being nearly alike, they are divided by hash, so that every level makes nodes smaller.
    """
    names = ["label", "vec", "point", "n", "hash", "path"]
    open_, done, depth = ws.save(points.select(*names[:-1], F.array().cast("array<int>").alias("path")), "level-0"), [], 0
    while True:
        sizes = ws.save(open_.groupBy("label", "path").agg(F.count("*").alias("c")).toDF("s_label", "s_path", "c"), f"sizes-{depth}")
        both = open_.join(sizes, (F.col("label") == F.col("s_label")) & (F.col("path") == F.col("s_path")))
        done.append(both.where(F.col("c") <= block).select(*names))
        if not sizes.where(F.col("c") > block).limit(1).count():
            break
        big = both.where(F.col("c") > block).withColumn("parts", F.ceil(F.col("c") / PART))
        few = big.where(F.pmod(F.xxhash64("hash", F.lit(depth)), F.lit(1_000_000)) < F.ceil(F.lit(1e6 * SAMPLE) / F.col("c")))

        def centred(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("hash").iloc[: 2 * SAMPLE]  # a sample by hash has about SAMPLE rows
            c = pick(unit(np.stack(pdf.vec.to_numpy()).astype(float)), max(2, min(FAN, math.ceil(2 * pdf.c.iloc[0] / block))))
            return pd.DataFrame({"c_label": [pdf.label.iloc[0]], "c_path": [pdf.path.iloc[0]], "parts": [pdf.parts.iloc[0]], "centres": [c.ravel().tolist()]})

        centres = few.groupBy("label", "path").applyInPandas(centred, "c_label string, c_path array<int>, parts long, centres array<double>")
        centres = centres.select("c_label", "c_path", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("c_part"))

        def dealt(pdf: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pdf.reindex(columns=names)
            u = unit(np.stack(pdf.vec.to_numpy()).astype(float))
            centres = np.array(c.centres.iloc[0]).reshape(-1, u.shape[1]) if len(c) else u[:1]
            if len(centres) > 1:
                at = (u @ centres.T).argmax(axis=1)
            else:
                mixed = (pdf.hash.to_numpy().astype(np.uint64) + np.uint64(len(pdf.path.iloc[0]) + 1) * _ODD) * _ODD  # another number on each level
                at = (mixed >> np.uint64(33)) % np.uint64(max(2, math.ceil(2 * pdf.c.iloc[0] / block)))
            pdf["path"] = [[*p, int(k)] for p, k in zip(pdf.path, at, strict=True)]
            return pdf[names]

        parted = big.withColumn("part", F.pmod(F.xxhash64("hash", F.lit(-1)), F.col("parts")))
        open_ = parted.groupBy("label", "path", "part").cogroup(centres.groupBy("c_label", "c_path", "c_part")).applyInPandas(dealt, "label string, vec array<double>, point long, n long, hash long, path array<int>")
        depth += 1
        open_ = ws.save(open_, f"level-{depth}")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out, depth


def balls(blocks: DataFrame, depth: int, ws: Workspace) -> list[DataFrame]:
    """Per level from the top (label, path, block, centre, radius): its nodes, and blocks that end above it, with covering balls; only blocks have a block."""
    levels = [ws.save(blocks.select("label", "path", "block", "centre", "radius"), f"balls-{depth}")]
    for k in reversed(range(depth)):
        kids = levels[0].withColumn("up", F.slice("path", 1, k))
        middle = kids.groupBy("label", "up").agg(F.min_by("centre", "path").alias("middle"), F.count("*").alias("kids"), F.max(F.size("path")).alias("steps"))
        middle = middle.toDF("m_label", "m_up", "middle", "kids", "steps")
        both = kids.join(middle, (F.col("label") == F.col("m_label")) & (F.col("up") == F.col("m_up")))
        here = both.groupBy("label", "up").agg(F.max(F.when(F.size("path") <= k, F.col("block"))).alias("block"), F.min_by("middle", "path").alias("centre"), F.max(apart("centre", "middle") + F.col("radius")).alias("radius"))
        levels.insert(0, ws.save(here.select("label", F.col("up").alias("path"), "block", "centre", "radius"), f"balls-{k}"))
    return levels


def near_pairs(levels: list[DataFrame], ws: Workspace, cosine: float) -> DataFrame:
    """(block, block_, dims, whole): the pairs of a label's blocks, each with itself too, whose balls come within the threshold.

    Pairs of nodes become pairs of their children and are pruned level by level, so that what has been pruned above is never
    looked at below. `whole` are pairs so close that all their points link.
    """
    far = math.sqrt(2 - 2 * cosine)
    reach, gap = F.col("radius") + F.col("radius_"), apart("centre", "centre_")
    pairs = levels[0].select("label", F.col("path").alias("a"), F.col("path").alias("b"))
    top = levels[0].select(*[F.col(c).alias(f"{c}_") for c in levels[0].columns])
    got = levels[0].join(top, (F.col("label") == F.col("label_")) & (F.col("path") == F.col("path_")))
    for k, nodes in enumerate(levels[1:]):
        kids = nodes.withColumn("up", F.slice("path", 1, k))
        other = kids.select(*[F.col(c).alias(f"{c}_") for c in kids.columns])
        left = pairs.withColumnRenamed("label", "in").join(kids, (F.col("in") == F.col("label")) & (F.col("a") == F.col("up")))
        met = (F.col("label") == F.col("label_")) & (F.col("b") == F.col("up_")) & ((F.col("a") != F.col("b")) | (F.col("path") <= F.col("path_")))
        got = ws.save(left.join(other, met).where(gap - reach <= far + MARGIN).select(*nodes.columns, *[f"{c}_" for c in nodes.columns]), f"pairs-{k + 1}")
        pairs = got.select("label", F.col("path").alias("a"), F.col("path_").alias("b"))
    return ws.save(got.where(gap - reach <= far + MARGIN).select("block", "block_", F.size("centre").alias("dims"), (gap + reach <= far - MARGIN).alias("whole")), "pairs")


def near_duplicates(vectors: DataFrame, ws: Workspace, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: (key, n_links, component_id, kept).

    Rows with a null label or key, or whose vector is null, zero, empty or holds a null or a non-finite number, link with nothing;
    vectors of different length do not link. n_links counts other rows, equal vectors among them. Rows that share a key
    count as one for the components. Extra columns are not read. No label, node or group of copies is ever in one task.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("vec"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    good = rows.where(F.coalesce(fine, F.lit(False)))
    # -0.0 and 0.0 are the same number; the label's text and the vector's length keep apart what must not meet
    clean = F.transform("vec", lambda x: x + F.lit(0.0))
    points = good.groupBy(F.concat_ws(":", F.size("vec"), F.col("label").cast("string")).alias("label"), clean.alias("vec")).agg(F.min("id").alias("point"), F.count("*").alias("n"))
    points = ws.save(points.withColumn("hash", F.xxhash64("vec")), "points")
    if not points.limit(1).count():
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    placed, depth = grown(points, ws, block)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point")
        x = np.stack(pdf.vec.to_numpy())
        u = unit(x)
        c = u.mean(axis=0)
        far = float(np.linalg.norm(u - c, axis=1).max())
        narrow = x.astype(np.float32)
        return pd.DataFrame({"label": [pdf.label.iloc[0]], "path": [pdf.path.iloc[0]], "block": [int(pdf.point.min())], "centre": [c.tolist()], "radius": [far], "points": [pdf.point.tolist()], "ns": [pdf.n.tolist()], "dims": [x.shape[1]], "x": [(narrow if (narrow == x).all() else x).tobytes()]})

    blocks = placed.groupBy("label", "path").applyInPandas(packed, "label string, path array<int>, block long, centre array<double>, radius double, points array<long>, ns array<long>, dims int, x binary")
    blocks = ws.save(blocks, "blocks")
    pairs = near_pairs(balls(blocks, depth, ws), ws, cosine)
    # blocks so close that all their points link are not descended: their sizes count, and one point of each connects them
    whole = pairs.where("whole").select("block", "block_")
    ends = whole.union(whole.where("block <> block_").select("block_", "block")).toDF("w_block", "with")
    sizes = blocks.select(F.col("block").alias("with"), F.aggregate("ns", F.lit(0).cast("long"), lambda s, n: s + n).alias("size"))
    held = ends.join(sizes, "with").groupBy("w_block").agg(F.sum("size").alias("size"), F.bool_or(F.col("w_block") == F.col("with")).alias("own"))
    each = blocks.join(held, F.col("block") == F.col("w_block")).select("block", "size", "own", F.explode(F.arrays_zip("points", "ns")).alias("p"))
    taken = each.select(F.col("p.points").alias("a"), F.col("block").alias("b"), (F.col("size") - F.when(F.col("own"), F.col("p.ns")).otherwise(0)).alias("k"))
    taken = taken.union(whole.where("block <> block_").select(F.col("block").alias("a"), F.col("block_").alias("b"), F.lit(0).cast("long").alias("k")))
    pairs = pairs.where("not whole").drop("whole")
    side = lambda end: blocks.select(*[F.col(c).alias(f"{c}{end}") for c in ("block", "points", "ns", "x")])
    both = pairs.join(side(""), "block").join(side("_"), "block_")

    def joined(batches):
        trees: dict[int, tuple] = {}

        def tree(name, x, n, dims):
            if name not in trees:
                if len(trees) > 8:
                    trees.clear()
                a = np.frombuffer(x, np.float32 if len(x) == 4 * n * dims else np.float64).reshape(n, dims).astype(float)
                u = unit(a)
                trees[name] = a, u, Tree(u)
            return trees[name]

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                same = r.block == r.block_
                p, q, m, n = np.array(r.points), np.array(r.points_), np.array(r.ns), np.array(r.ns_)
                a, ua, ta = tree(r.block, r.x, len(p), r.dims)
                b, ub, tb = tree(r.block_, r.x_, len(q), r.dims)
                found = links(a, ua, ta, b, ub, tb, cosine)
                if same:
                    found |= found.T
                    np.fill_diagonal(found, False)
                count = found @ n
                edges = spanning(found, same)
                yield pd.DataFrame({"a": p, "b": p, "k": count})[count > 0]
                if not same:
                    back = m @ found
                    yield pd.DataFrame({"a": q, "b": q, "k": back})[back > 0]
                yield pd.DataFrame({"a": [p[i] for i, _ in edges], "b": [q[j] for _, j in edges], "k": 0}, dtype="int64")

    results = ws.save(both.repartition("block", "block_").mapInPandas(joined, "a long, b long, k long").union(taken), "results")
    own = results.groupBy("a").agg(F.sum("k").alias("k")).withColumnRenamed("a", "c_point")
    cc = components(results.where("a <> b").select("a", "b"), ws)
    by = points.select(F.col("label").alias("p_label"), F.col("vec").alias("p_vec"), "point", "n")
    of = good.select("id", F.concat_ws(":", F.size("vec"), F.col("label").cast("string")).alias("label"), clean.alias("vec"))
    of = of.join(by, (F.col("label") == F.col("p_label")) & (F.col("vec") == F.col("p_vec"))).select("id", "point", "n")
    of = of.join(own, F.col("point") == F.col("c_point"), "left").join(cc.withColumnRenamed("node", "c_node"), F.col("point") == F.col("c_node"), "left")
    of = of.select("id", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    rest = rows.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return of.unionByName(rest).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op10"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r(vec_id, reach) AS (SELECT a, a FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
m AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id)
SELECT v.vec_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, coalesce(m.component_id, v.vec_id) AS component_id, coalesce(m.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN m USING (vec_id)
"""
