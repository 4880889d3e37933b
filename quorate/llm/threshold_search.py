"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors of similar direction and size go into blocks; in a block each dimension has a list of the rows in order of their
component. A query reads each list from the end that its own component's sign favours, scores whatever it meets for the first time, and
stops as soon as the sum of what the lists have come down to is below its kth score: no row that it hasn't met can reach more.
What a query has found in its nearest block bounds it in all others; a block whose lists' ends sum up to less isn't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm.common import Workspace, small_batches

SCALE, K, EVERY = 1024, 10, 100
#: Rows of a block, numbers of a block, queries that go to a block together, and centres, all at most; keys that a batch of blocks is dealt to.
BLOCK, NUMBERS, CHUNK, CENTRES = 4096, 1 << 20, 256, 1024
SALT = 8
#: Rows that a query reads of each list before it compares bounds for the first time; then it reads twice as many.
FIRST = 8
#: Sums of products below this are exact as doubles.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def lists(x: np.ndarray) -> np.ndarray:
    """For each dimension the rows in ascending order of their component."""
    return np.argsort(x, axis=0, kind="stable").T.astype(np.int32)


def exact(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether doubles give the inner products of rows of x and y exactly."""
    return not x.size or not y.size or float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < _EXACT


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q; objects, if they don't fit doubles exactly."""
    if exact(x, q[None, :]):
        return x @ q
    whole = [int(b) for b in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x], object)


def best(found: list[tuple], k: int) -> list[tuple]:
    """The first k of (score, vec_id, row) by score, the highest first, then by vec_id and row."""
    return sorted(found, key=lambda f: (-f[0], f[1], f[2]))[:k]


def search(x: np.ndarray, order: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple]:
    """The block's k best (score, vec_id, row) for q other than the row `own`, as far as they reach `floor`; by the threshold algorithm."""
    n, dims = x.shape
    if not dims:
        return best([(0, int(i), int(r)) for i, r in zip(ids, rows, strict=True) if r != own], k) if floor <= 0 else []
    met, found, at, step = np.zeros(n, bool), [], 0, FIRST
    up = q > 0
    live = np.flatnonzero(q != 0)  # a zero component adds nothing, whatever the row's is
    whole = exact(x, q[None, :])
    least = floor
    while at < n:
        to = min(n, at + step)
        if len(live):
            ends = np.where(up[live, None], order[live][:, ::-1][:, at:to], order[live][:, at:to])
            new = np.unique(ends[~met[ends]])
        else:
            new, to = np.flatnonzero(~met), n
        met[new] = True
        if len(new):
            got = scores(x[new], q)
            here = np.flatnonzero((got >= least) & (rows[new] != own))
            if len(here) > k and whole:  # ties with the kth stay
                kth = np.partition(got[here], len(here) - k)[len(here) - k]
                here = here[got[here] >= kth]
            found = best([*found, *((int(got[i]), int(ids[new[i]]), int(rows[new[i]])) for i in here)], k)
            if len(found) == k:
                least = max(least, found[-1][0])
        at, step = to, to
        if at < n and len(live):
            last = np.where(up[live], order[live, n - at], order[live, at - 1])
            bound = float(x[last, live] @ q[live]) if whole else sum(int(a) * int(b) for a, b in zip(x[last, live], q[live], strict=True))
            if bound < least or met.all():
                break
    return found


def bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What no score of a row of q with any vector between low and high exceeds."""
    return np.maximum(q, 0) @ high + np.minimum(q, 0) @ low


def _array(cells: pd.Series, dims: int) -> np.ndarray:
    return np.stack(cells.to_numpy()).astype(float).reshape(len(cells), dims) if dims else np.zeros((len(cells), 0))


def blocks(points: DataFrame, ws: Workspace, block: int = BLOCK) -> DataFrame:
    """(block, dims, n, low, high, centre, ids, rows, x, lists): points by nearest of some centres, in blocks of bounded size.

    Centres are points, picked by hash; which ones decides only how tight the blocks' bounds are. A centre with more points than a
    block holds has several blocks, its points dealt out by hash.
    """
    sizes = {r.dims: r.n for r in points.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # a row per length of vectors
    most = {d: max(64, min(block, NUMBERS // max(1, d))) for d in sizes}
    centres = {}
    for d, n in sizes.items():
        want = min(CENTRES, NUMBERS // max(1, d) or 1, math.ceil(n / most[d]))
        picked = points.where(F.col("dims") == d).orderBy(F.xxhash64("row"), "row").limit(want).select("vec").collect() if want > 1 else []
        centres[d] = np.array([r.vec for r in picked], float).reshape(len(picked), d)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int64)
            for d in pdf.dims.unique():
                of, c = np.flatnonzero(pdf.dims == d), centres[d]
                if len(c):
                    x = _array(pdf.vec.iloc[of], d)
                    size = max(1.0, float(np.abs(x).max()), float(np.abs(c).max()))  # no square overflows
                    x, c = x / size, c / size
                    cell[of] = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            yield pdf.assign(cell=cell)

    placed = ws.save(points.mapInPandas(near, "id long, row long, dims int, vec array<double>, cell long"), "placed")
    counts = placed.groupBy("dims", "cell").agg(F.count("*").alias("n")).toDF("c_dims", "c_cell", "n")
    # as many parts that chance fills none beyond twice its share; a full part is cut by `packed`
    limit = F.create_map(*[F.lit(v) for d, m in most.items() for v in (d, m)]) if most else F.lit(None).cast("map<int,int>")
    parts = counts.select("c_dims", "c_cell", F.ceil(F.col("n") / limit[F.col("c_dims")]).alias("parts"))
    dealt = placed.join(F.broadcast(parts), (F.col("dims") == F.col("c_dims")) & (F.col("cell") == F.col("c_cell"))).withColumn("part", F.pmod(F.xxhash64("row", F.lit(7)), "parts"))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "row"])
        x = _array(pdf.vec, int(pdf.dims.iloc[0]))
        return pd.DataFrame({
            "dims": [x.shape[1]], "n": [len(x)], "low": [x.min(axis=0).tolist()], "high": [x.max(axis=0).tolist()], "centre": [x.mean(axis=0).tolist()],
            "ids": [pdf.id.to_numpy(np.int64).tobytes()], "rows": [pdf.row.to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "lists": [lists(x).tobytes()],
        })

    out = dealt.groupBy("dims", "cell", "part").applyInPandas(packed, "dims int, n int, low array<double>, high array<double>, centre array<double>, ids binary, rows binary, x binary, lists binary")
    return ws.save(out.withColumn("block", F.monotonically_increasing_id()), "blocks")


def plan(queries: DataFrame, heads: DataFrame, every: bool) -> DataFrame:
    """(row, block, floor): the pairs of queries and blocks to search.

    Each query's nearest block of a batch by the product with its centre, or else (`every`) all but its nearest whose bound reaches
    its floor. Queries come in chunks and meet the blocks' summaries in batches, as products of matrices; a batch goes to SALT keys.
    """
    salts = F.sequence(F.lit(0), F.lit(SALT - 1))
    sides = heads.groupBy("dims", "batch", "batches").agg(F.collect_list(F.struct("block", "low", "high", "centre")).alias("blocks"))
    batches = sides.select(F.col("dims").alias("b_dims"), "batches").distinct()
    sides = sides.drop("batches").withColumn("salt", F.explode(salts))
    asks = queries.groupBy("dims", "chunk").agg(F.collect_list(F.struct("row", "vec", "floor", "near")).alias("asks"))
    asks = asks.join(batches, F.col("dims") == F.col("b_dims")).withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)))
    both = asks.withColumn("salt", F.pmod("chunk", F.lit(SALT)).cast("int")).join(sides, ["dims", "batch", "salt"]).select("dims", "asks", "blocks")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q = np.array([a["vec"] for a in r.asks], float).reshape(len(r.asks), r.dims)
                row, name = np.array([a["row"] for a in r.asks], np.int64), np.array([b["block"] for b in r.blocks], np.int64)
                if every:
                    low, high = (np.array([b[c] for b in r.blocks], float).reshape(len(name), r.dims).T for c in ("low", "high"))
                    floor, near = (np.array([a[c] for a in r.asks]) for c in ("floor", "near"))
                    top = bounds(low, high, q)
                    slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)) + 1)  # sums of doubles
                    i, j = np.nonzero(~(top + slack < floor[:, None]) & (near[:, None] != name[None, :]))  # NaN isn't below
                    yield pd.DataFrame({"row": row[i], "block": name[j], "floor": floor[i]})
                else:
                    c = np.array([b["centre"] for b in r.blocks], float).reshape(len(name), r.dims).T
                    near = q @ c
                    j = near.argmax(axis=1)
                    yield pd.DataFrame({"row": row, "block": name[j], "floor": near[np.arange(len(row)), j]})

    return both.mapInPandas(met, "row long, block long, floor double")


def searched(pairs: DataFrame, queries: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """(row, hits): what each pair of query and block finds; a block goes to a task with a chunk of its queries."""
    asks = pairs.join(queries.select(F.col("row").alias("q_row"), "vec", "chunk"), F.col("row") == F.col("q_row"))
    asks = asks.groupBy("block", "chunk").agg(F.collect_list(F.struct("row", "floor", "vec")).alias("asks"))
    both = asks.join(packed.select("block", "dims", "n", "ids", "rows", "x", "lists"), "block")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, order = np.frombuffer(r.x).reshape(r.n, r.dims), np.frombuffer(r.lists, np.int32).reshape(r.dims, r.n)
                ids, rows = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64)
                out = [(a["row"], s, i, w) for a in r.asks for s, i, w in search(x, order, ids, rows, np.array(a["vec"], float), a["row"], k, a["floor"])]
                # beyond a long's range a score's sign and order are all that a double keeps
                yield pd.DataFrame({"row": [o[0] for o in out], "score": [max(-_LONG - 1, min(_LONG, o[1])) for o in out], "vec_id": [o[2] for o in out], "hit": [o[3] for o in out]}, dtype="int64")

    return both.mapInPandas(find, "row long, score long, vec_id long, hit long")


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query, with rank; tasks keep k a query before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "hit"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search_all(vectors: DataFrame, ws: Workspace, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every` the k rows with the highest inner products.

    Components count as floor(scale * component). A row isn't compared with itself, but with others of the same key or
    vector; ties go to the smaller key. Rows with a null key or vector, a null or non-finite component, or one that isn't
    finite when scaled, take no part; vectors of different length don't meet; vectors without components score 0. With fewer than k
    other rows a query has all of them; an empty table gives no row. Inner products are exact; those beyond a long's range
    are returned as its end. Other columns aren't read. No task holds more than a block and a chunk of queries.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double") * F.lit(float(scale)))
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("vec")).where("id is not null and vec is not null")
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(fine).select("id", F.monotonically_increasing_id().alias("row"), F.size("vec").alias("dims"), "vec")

    def floored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["vec"] = [np.floor(np.asarray(v, float)) + 0.0 for v in pdf.vec]
            yield pdf

    points = ws.save(rows.mapInPandas(floored, "id long, row long, dims int, vec array<double>"), "points")
    packed = blocks(points, ws, block)
    per = {r.dims: (r.n, max(16, NUMBERS // (3 * max(1, r.dims)))) for r in packed.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    batches = F.create_map(*[F.lit(c) for d, (n, size) in per.items() for c in (d, math.ceil(n / size))])[F.col("dims")] if per else F.lit(1)
    heads = packed.select("block", "dims", "low", "high", "centre", batches.cast("long").alias("batches"))
    heads = ws.save(heads.withColumn("batch", F.pmod(F.xxhash64("block"), "batches")), "heads")
    none = F.lit(-float("inf"))
    asked = points.where(F.col("id") % every == 0)
    chunk = F.pmod(F.xxhash64("row"), F.lit(max(1, math.ceil(asked.count() / CHUNK)))).alias("chunk")
    asked = asked.select("row", "id", "dims", "vec", chunk, none.alias("floor"), F.lit(-1).cast("long").alias("near"))
    with small_batches(ws.spark, 8):  # a row is a block
        near = plan(asked, heads, False)
        near = ws.save(near.groupBy("row").agg(F.max_by("block", F.struct("floor", "block")).alias("block")), "nearest")
        first = ws.save(top(searched(near.withColumn("floor", none), asked, packed, k), k).drop("rank"), "first")
        # a floor is a little below the kth score, so that rounding to a double doesn't lift it
        kth = F.min("score").cast("double")
        floors = first.groupBy("row").agg(F.when(F.count("*") == k, kth - F.abs(kth) * 1e-15).alias("f")).withColumnRenamed("row", "f_row")
        asked = asked.drop("floor", "near").join(floors, F.col("row") == F.col("f_row"), "left").join(near.select(F.col("row").alias("n_row"), F.col("block").alias("near")), F.col("row") == F.col("n_row"))
        asked = ws.save(asked.select("row", "id", "dims", "vec", "chunk", F.coalesce("f", none).alias("floor"), "near"), "asked")
        pairs = ws.save(plan(asked, heads, True), "pairs")
        rest = ws.save(searched(pairs, asked, packed, k), "rest")
    named = top(rest.union(first), k).join(asked.select(F.col("row").alias("q_row"), F.col("id").alias("query_id")), F.col("row") == F.col("q_row"))
    return named.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_all(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op11"))


SQL = r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, q.r, v.vec_id, v.r AS vr, CAST(CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, v.e) END AS BIGINT) AS score
  FROM v q JOIN v ON q.r <> v.r AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, vr) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""
