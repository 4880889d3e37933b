"""Sums over all subtrees of a forest by parallel tree contraction.

Each round splices out nodes of unary chains (compress) and takes off leaves (rake), by an aggregate and two joins, so that a
forest of n nodes is gone after a number of rounds that grows with log n, however deep it is. What was taken off is then put
back in reverse order, which gives every node's sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import Workspace


def _priority(node: Column, k: int) -> Column:
    return F.xxhash64(node, F.lit(k))


def subtree_sums(tree: DataFrame, sums: list[str], ws: Workspace, node: str = "node", parent: str = "parent", name: str = "tree") -> DataFrame:
    """(node, *sums): for each node the sums of the columns over its subtree, itself included.

    Nodes are distinct longs. A node whose parent is null or isn't in the table is a root. Null values count as 0. An empty
    table gives an empty one. Rows that aren't a forest, as they hold a cycle, raise ValueError.

    A node's row holds `v`, what it and its removed descendants sum up to, and `e`, what the nodes spliced out between it and its
    present parent do. A node with one child is spliced out if its number, drawn for the round, is above its child's and its parent's,
    so that no two neighbours are: a third of a long chain each round. A leaf's v is its sum, and goes with its e to its parent.
    """
    vs, es, adds = ([f"{k}{i}" for i in range(len(sums))] for k in ("v", "e", "a"))
    zero = F.lit(0).cast("long")
    start = tree.select(F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"), *[F.coalesce(F.col(c).cast("long"), zero).alias(v) for c, v in zip(sums, vs, strict=True)])
    now = ws.save(start.select("*", *[zero.alias(e) for e in es], F.lit(1).cast("long").alias("kids"), F.lit(None).cast("long").alias("spliced"), *[zero.alias(a) for a in adds]), f"{name}-0")
    rounds: list[DataFrame] = []
    left = now.limit(1).count()
    while left:
        k = len(rounds) + 1
        inner, leaf = F.col("kids") > 0, F.col("kids") == 0
        below = now.groupBy("parent").agg(F.count_if(inner).alias("n"), F.min(F.when(inner, F.col("node"))).alias("kid"), *[F.sum(F.when(leaf, F.col(v) + F.col(e))).alias(f"s_{v}") for v, e in zip(vs, es, strict=True)])
        below = below.withColumnRenamed("parent", "up")
        alive = now.where(inner).join(below, F.col("node") == F.col("up"), "left")
        alive = alive.select("node", "parent", *[(F.col(v) + F.coalesce(f"s_{v}", zero)).alias(v) for v in vs], *es, F.coalesce("n", zero).alias("kids"), "kid")
        mine = _priority(F.col("node"), k)
        chosen = (F.col("kids") == 1) & F.col("parent").isNotNull() & (mine > _priority(F.col("kid"), k)) & (mine > _priority(F.col("parent"), k))
        out = alive.where(chosen).select(F.col("node").alias("spliced"), F.col("parent").alias("grand"), *[F.col(v).alias(f"m_{v}") for v in vs], *[F.col(e).alias(f"m_{e}") for e in es])
        rest = alive.where(~F.coalesce(chosen, F.lit(False))).join(out, F.col("parent") == F.col("spliced"), "left")
        moved = [(F.col(e) + F.coalesce(F.col(f"m_{v}") + F.col(f"m_{e}"), zero)).alias(e) for v, e in zip(vs, es, strict=True)]
        # a spliced node's sum will be its only child's and this
        kept = [F.coalesce(F.col(f"m_{v}") + F.col(e), zero).alias(a) for v, e, a in zip(vs, es, adds, strict=True)]
        now = ws.save(rest.select("node", F.coalesce("grand", "parent").alias("parent"), *vs, *moved, "kids", "spliced", *kept), f"{name}-{k}")
        left, raked = now.agg(F.count_if(inner), F.count_if(leaf)).first()
        if not raked:
            raise ValueError("rows with a cycle are not a forest")
        rounds.append(now)
    known = start.select("node", *vs).limit(0)
    for k in reversed(range(len(rounds))):
        base = known.union(rounds[k].where("kids = 0").select("node", *vs))
        again = rounds[k].where("spliced is not null").select("spliced", F.col("node").alias("kid"), *adds)
        again = again.join(base, F.col("kid") == F.col("node")).select(F.col("spliced").alias("node"), *[(F.col(v) + F.col(a)).alias(v) for v, a in zip(vs, adds, strict=True)])
        known = ws.save(base.union(again), f"{name}-sums-{k}")
        ws.drop(f"{name}-{k + 1}", f"{name}-sums-{k + 1}")
    return known.select("node", *[F.col(v).alias(c) for v, c in zip(vs, sums, strict=True)])
