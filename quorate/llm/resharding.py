"""Minimum-cost-flow resharding.

Rows lie in old shards; each shard's rows fall into blocks by a hash of their id. From the old shards' bytes and the new
shards' capacities a minimum-cost flow gives how many bytes each old shard sends to each new one so that the fewest bytes
move: a byte that stays costs 0, one that moves costs 1. Whole blocks are then dealt out to meet that flow, and only the
files of blocks that move are written anew. The flow and the dealing out see shards and blocks only, whose number is a
parameter and not the number of rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm.common import Workspace, fresh

OLD_SHARDS, NEW_SHARDS = 32, 40
#: Blocks of an old shard; each is about a thousandth of it, so that new shards differ by less than that.
BLOCKS = 1024
ROW_BYTES = 16


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus ROW_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def flow(old: dict[int, int], new: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from old to new shards that fill the capacities `new` from the supplies `old` at the least cost.

    Successive shortest paths with potentials; an arc i to i costs 0, any other 1. The capacities must be at least the
    supplies in sum.
    """
    source, sink = ("s",), ("t",)
    arcs: dict = defaultdict(dict)  # from: {to: [capacity left, cost]}
    for i, n in old.items():
        arcs[source]["o", i] = [n, 0]
        arcs["o", i][source] = [0, 0]
        for j in new:
            arcs["o", i]["n", j] = [n, int(i != j)]
            arcs["n", j]["o", i] = [0, -int(i != j)]
    for j, n in new.items():
        arcs["n", j][sink] = [n, 0]
        arcs[sink]["n", j] = [0, 0]
    height: dict = defaultdict(int)
    left = sum(old.values())
    while left > 0:
        far, via, heap = {source: 0}, {}, [(0, 0, source)]
        done, ticket = set(), 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for v, (room, cost) in arcs[u].items():
                to = d + cost + height[u] - height[v]
                if room > 0 and v not in done and to < far.get(v, 1 << 60):
                    far[v], via[v], ticket = to, u, ticket + 1
                    heapq.heappush(heap, (to, ticket, v))
        if sink not in far:
            raise ValueError("the capacities are too small")
        most = max(far.values())
        for u in list(arcs):
            height[u] += far.get(u, most)
        path, v = [], sink
        while v != source:
            path.append((via[v], v))
            v = via[v]
        step = min(left, *(arcs[u][v][0] for u, v in path))
        for u, v in path:
            arcs[u][v][0] -= step
            arcs[v][u][0] += step
        left -= step
    return {(i, j): arcs["n", j]["o", i][0] for i in old for j in new if arcs["n", j]["o", i][0] > 0}


def deal(blocks: list[tuple[int, int, int]], sent: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """New shard of each block (old shard, block): per old shard, largest blocks first to where most of the flow is open.

    What has been put in too much or too little is carried on to the next old shard, so that errors do not add up.
    """
    by_shard: dict[int, list] = defaultdict(list)
    for i, b, n in blocks:
        by_shard[i].append((n, b))
    over: dict[int, int] = defaultdict(int)  # bytes dealt to a new shard beyond the flow so far
    out = {}
    for i in sorted(by_shard):
        heap = [(-(n - over[j]), j != i, j) for (a, j), n in sent.items() if a == i]
        for _, _, j in heap:
            over[j] = 0
        heapq.heapify(heap)
        for n, b in sorted(by_shard[i], key=lambda x: (-x[0], x[1])):
            need, moves, j = heapq.heappop(heap)
            out[i, b] = j
            heapq.heappush(heap, (need + n, moves, j))
        for need, _, j in heap:
            over[j] += need
    return out


def plan(placed: DataFrame, new_shards: int) -> DataFrame:
    """From (old_shard, block, size): one row per block with its shard, rows, bytes and the slot at which its rows start."""
    spark = placed.sparkSession
    sums = placed.groupBy("old_shard", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    total = sum(r["size"] for r in sums)
    old: dict[int, int] = defaultdict(int)
    for r in sums:
        old[r["old_shard"]] += r["size"]
    new = {j: total // new_shards + (j < total % new_shards) for j in range(new_shards)}
    shard = deal([(r["old_shard"], r["block"], r["size"]) for r in sums], flow(dict(old), new))
    at: dict[int, int] = defaultdict(int)
    rows = []
    for r in sorted(sums, key=lambda r: (r["old_shard"], r["block"])):
        j = shard[r["old_shard"], r["block"]]
        rows.append((r["old_shard"], r["block"], j, at[j], r["n"], r["size"]))
        at[j] += r["n"]
    return spark.createDataFrame(rows, "old_shard int, block int, shard int, slot_from long, n_rows long, bytes long")


def reshard(docs: DataFrame, ws: Workspace, old_shard: Column, new_shards: int = NEW_SHARDS, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, plan): all rows of docs with old_shard, block, shard and slot_from; rows that move are read back from their new files.

    New shards' bytes are equal up to a block, unless single rows are larger than a shard's share; no law here asks that
    equal texts stay together, and they do not. Null texts have ROW_BYTES bytes; a row without an id falls into a block by its
    text; repeated rows are rows each. Columns of docs that are named like results are replaced. Files are written for moved
    blocks only, by new shard; all others stay where they are. An empty table gives no rows.
    """
    docs = docs.drop("old_shard", "block", "shard", "slot_from")
    block = F.pmod(F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(key))), F.lit(blocks)).cast("int")
    placed = docs.select(old_shard.cast("int").alias("old_shard"), block.alias("block"), row_bytes(F.col(text)).alias("size"))
    to = ws.save(plan(placed, new_shards).coalesce(1), "plan")
    p_old, p_block = fresh("old", "block")
    to_small = F.broadcast(to.select(F.col("old_shard").alias(p_old), F.col("block").alias(p_block), "shard", "slot_from"))  # shards x BLOCKS rows at most
    named = docs.select("*", old_shard.cast("int").alias("old_shard"), block.alias("block"))
    named = named.join(to_small, (F.col("old_shard") == F.col(p_old)) & (F.col("block") == F.col(p_block))).drop(p_old, p_block)
    moved = named.where("shard <> old_shard")
    path = f"{ws.path}/shards"
    moved.repartition("shard", "block").write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.schema(moved.schema).parquet(path).select(*moved.columns)
    rows = named.where("shard = old_shard").unionByName(back)
    return rows, to


def slots(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds slot to rows of reshard(): a shard's rows count from 0 without gaps, by old shard, block and then by `order`.

    Numbers run within a block, from the plan's start of that block, so that no shard is in one task.
    """
    w = Window.partitionBy("old_shard", "block").orderBy(*order)
    return rows.withColumn("slot", F.col("slot_from") + F.row_number().over(w) - 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    old = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(OLD_SHARDS))
    rows, _ = reshard(docs, Workspace(spark, "op1"), old)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    narrow = rows.select("doc_id", "old_shard", "block", "shard", "slot_from", row_bytes(F.col("text")).alias("size"), crc.alias("text_crc32"))
    placed = slots(narrow, F.col("doc_id"), F.col("text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
