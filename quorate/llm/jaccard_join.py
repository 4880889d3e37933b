"""Similarity join on word shingles by a size-aware split into small and large sets.

Two texts link when 100 x |intersection| >= 80 x |union| of their shingle sets. Texts with equal sets are one node. A pair
of small sets must share a subset of fixed size (the intersection that the threshold asks of their two sizes), so
small sets meet by enumerated subsets. A pair with a large set meets in inverted lists of shingles: of each set only the
shingles that come first in one order, rarest first, have postings, and a pair that shares too few of them is dropped
without a look at the texts. The size that divides small from large is the one for which the keys to be written cost the
least, by the corpus's own sizes.

Pairs are wanted for components only. Before the lists are scanned, texts are compared with the smallest of those that
share minima of their sets under several permutations, so that a large group of near copies is one component already, and
the lists give pairs of different components alone. All pairs that link are found: a pair whose ends are connected already
adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm.common import Workspace, components, give_back, small_batches

SHINGLE, PERCENT = 5, 80
PERMUTATIONS = 8
#: Sets up to this size can be small.
MOST_SMALL = 12
#: Counters of the frequency sketch, and the part of it that one row carries.
SKETCH_BITS, CHUNK_BITS = 22, 14

_M = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The set of a text's word shingles as sorted 64-bit hashes.

    A-Z count as a-z; words stand between spaces and \\t to \\r. A text of fewer words than k, but not none, has one shingle.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    n = min(k, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = s * _M + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(s))


def least_size(n: int, percent: int = PERCENT) -> int:
    """The smallest set that can link with one of size n."""
    return -(-n * percent // 100)


def overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """How many elements sets of sizes a and b must share."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    """So many of n elements, first in one order for all sets, have one in common with any set that links."""
    return n - least_size(n, percent) + 1


def subset_sizes(n: int, most: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a small set of size n shares with small sets of the sizes that can link with it."""
    partners = [m for m in range(least_size(n, percent), most + 1) if least_size(m, percent) <= n]
    return sorted({overlap(n, m, percent) for m in partners})


def boundary(sizes: dict[int, int], list_length: float, most: int = MOST_SMALL, percent: int = PERCENT) -> int:
    """The largest size that counts as small: the one for which keys written and pairs met in lists cost the least.

    sizes: how many sets there are of each size up to `most`; list_length: the mean number of postings of a shingle, each
    of which a further posting meets. Sets just above the boundary have both kinds of keys.
    """

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= x:
                total += count * sum(math.comb(n, c) for c in subset_sizes(n, x, percent))
            if n > x or least_size(x + 1, percent) <= n:
                total += count * prefix(n, percent) * (1 + list_length)
        return total

    return min(range(most + 1), key=cost)


def _each(column: pa.Array) -> Iterator:
    """A column's values one by one, so that a batch's texts are not all copied at once."""
    return (x.as_py() for x in column)


def _batched(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """int64 lists from arrays of 64-bit numbers."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _narrow(x: np.ndarray) -> bytes:
    """Counts in the smallest unsigned kind that holds them."""
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if x.max() <= np.iinfo(t).max)).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(x) >> CHUNK_BITS]).astype(np.int64)


def signatures(docs: DataFrame, k: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """Of rows (id, t), in one pass over the texts, two kinds of rows.

    Without chunk, one per text: (id, n, h1, h2, minima), the set's size, a 128-bit hash of it, and minima under
    permutations. With chunk: (chunk, counts), how often shingles occur in a partition by the low bits of their hash, in
    2 ** SKETCH_BITS counters of which a row carries 2 ** CHUNK_BITS.
    """
    odd = np.random.default_rng(7).integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["id", "n", "h1", "h2", "minima", "chunk", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            n, h, minima = [], [], []
            for t in _each(batch.column(1)):
                s = shingles(t, k)
                n.append(len(s))
                h.append(xxhash.xxh128_digest(s.tobytes()))
                minima.append(np.array([_mix(s * o).min() for o in odd], np.uint64) if len(s) else s)
                np.add.at(counts, (s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), 1)
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            own = [batch.column(0), pa.array(n, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), _lists(minima)]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(n), t) for t in kinds[5:]]], names)
        _words.clear()  # the worker lives on
        if counts.any():
            for c, x in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds[:5]], pa.array([c], pa.int32()), pa.array([_narrow(x)])], names)
        give_back()

    return docs.mapInArrow(signed, "id long, n long, h1 long, h2 long, minima array<long>, chunk int, counts binary")


def frequency_sketch(parts: DataFrame) -> np.ndarray:
    """How often shingles occur in all texts, by the low bits of their hash: a logarithm in one byte, from rows (chunk, counts).

    Chunks are added up as they stream in, first in eight places each, then in one. The result has 2 ** SKETCH_BITS bytes
    however large the corpus is.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(_each(batch.column(0)), _each(batch.column(1)), strict=True):
                sums[c] = sums[c] + _wide(x) if c in sums else _wide(x)
        for c, x in sums.items():
            yield _batched(("chunk", pa.array([c], pa.int32())), ("counts", pa.array([_narrow(x)], pa.binary())))

    kind = "chunk int, counts binary"
    chunks = parts.repartition("chunk", F.floor(F.rand(7) * 8)).mapInArrow(added, kind).repartition("chunk").mapInArrow(added, kind)
    out = np.zeros((1 << SKETCH_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8)
    with small_batches(parts.sparkSession):
        found = chunks.collect()  # as many rows as the sketch has chunks
    for c, x in found:
        out[c] = np.frexp(_wide(x).astype(np.float64))[1]
    return out.ravel()


def keys(docs: DataFrame, sketch: np.ndarray, small: int, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, listed, subsets) of rows (id, t): the shingles that have postings, and hashes of the subsets of small sets."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)  # 2 ** SKETCH_BITS bytes
    edge = least_size(small + 1, percent)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            listed, subsets = [], []
            for t in _each(batch.column(1)):
                s = shingles(t, k)
                r = rank[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                listed.append(s[np.lexsort((s, r))][: prefix(len(s), percent)] if len(s) >= edge else s[:0])
                sizes = subset_sizes(len(s), small, percent) if 0 < len(s) <= small else ()
                subsets.append(np.array([xxhash.xxh64_intdigest(np.array(x, np.uint64).tobytes(), seed=c) for c in sizes for x in combinations(s.tolist(), c)], np.uint64))
            yield _batched(("id", batch.column(0)), ("listed", _lists(listed)), ("subsets", _lists(subsets)))
        _words.clear()
        give_back()

    return docs.mapInArrow(keyed, "id long, listed array<long>, subsets array<long>")


def verified(pairs: DataFrame, docs: DataFrame, ws: Workspace, name: str, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (a, b) of ids those whose texts link, as a written table."""
    left = pairs.join(docs.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    both = left.join(docs.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            keep = []
            for ta, tb in zip(_each(batch.column(2)), _each(batch.column(3)), strict=True):
                if tb not in held:
                    if len(held) > 200:
                        held.clear()
                    held[tb] = shingles(tb, k)
                x, y = shingles(ta, k), held[tb]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and len(x) > 0)
            yield _batched(("a", batch.column(0)), ("b", batch.column(1))).filter(pa.array(keep, pa.bool_()))
        held.clear()
        _words.clear()
        give_back()

    return ws.save(both.mapInArrow(linked, "a long, b long").distinct(), name)


def shared(posts: DataFrame, by: str) -> DataFrame:
    """The keys s that postings of more than one `by` have; partial aggregates hold two numbers a key."""
    return posts.groupBy("s").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo <> hi").select("s")


def join(docs: DataFrame, ws: Workspace, key: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: (key, n_shingles, component_id), component_id the smallest key that links reach.

    Null texts and texts without words have 0 shingles and link with nothing; equal sets always link. Rows that share a key
    count as one document for the components; a row with a null key has no component. Whole texts count, and hot shingles,
    large groups of copies and very long texts are handled like all others. Extra columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    both = ws.save(signatures(rows, k), "signatures")
    signed = both.where("chunk is null").drop("chunk", "counts")
    sets = signed.where("n > 0 and id is not null")
    nodes = ws.save(sets.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("minima").alias("minima")), "nodes")

    # near copies of one text, compared with the smallest of those that share minima
    minima = nodes.select("node", F.posexplode("minima").alias("p", "m"))
    hubs = minima.groupBy("p", "m").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1").select(F.col("p").alias("hp"), F.col("m").alias("hm"), "hub")
    near = minima.join(hubs, (F.col("p") == F.col("hp")) & (F.col("m") == F.col("hm"))).where("node <> hub")
    near = near.groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("c")).where(F.col("c") >= max(1, PERMUTATIONS * 3 // 8)).select("a", "b")
    first = verified(ws.save(near, "near"), rows, ws, "first", k, percent)
    joined = ws.save(components(first, ws, name="first-cc"), "first-components")
    placed = nodes.select("node", "n").join(joined.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    placed = ws.save(placed.select("node", "n", F.coalesce("component", "node").alias("comp")), "placed")

    # keys of small and large sets
    few = {r["n"]: r["c"] for r in nodes.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count("*").alias("c")).collect()}
    sketch = frequency_sketch(both.where("chunk is not null").select("chunk", "counts"))
    small = boundary(few, float((2.0 ** sketch[sketch > 0]).mean()) if sketch.any() else 0.0)
    keyed = ws.save(keys(rows, sketch, small, k, percent), "keys")
    pairs = None
    for kind in ("listed", "subsets"):
        posts = keyed.where("id is not null").select(F.posexplode(kind).alias("pos", "s"), "id")
        live = posts.join(shared(posts, "id"), "s", "left_semi")
        live = ws.save(live.join(placed, F.col("id") == F.col("node")).select("s", "pos", "node", "n", "comp").dropDuplicates(["s", "node"]), f"live-{kind}")
        own = Window.partitionBy("node")  # a set's own postings
        live = live.join(shared(live, "comp"), "s", "left_semi").select("s", "node", "comp", F.col("n").cast("int").alias("n"), F.row_number().over(own.orderBy("pos")).alias("u"), F.count("*").over(own).cast("int").alias("all"))
        live = ws.save(live, f"met-{kind}-posts")
        other = live.select(*[F.col(c).alias(f"{c}_") for c in live.columns])
        fits = (F.col("s") == F.col("s_")) & (F.col("comp") != F.col("comp_")) & (F.col("node") > F.col("node_"))
        fits &= F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent
        need = F.lit(1)
        if kind == "listed":
            # what two sets share beyond their common postings is at most what one of them has without a posting; all shared
            # postings stand in one order, so the first of k is followed by k - 1 on both sides
            beyond = lambda n: F.ceil(n * percent / 100) - 1
            need = F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("n_")) * percent / (100 + percent)) - F.greatest(beyond(F.col("n")), beyond(F.col("n_"))))
            fits &= (F.greatest("n", "n_") > small) & (F.col("all") - F.col("u") + 1 >= need) & (F.col("all_") - F.col("u_") + 1 >= need)
        found = live.join(other, fits).select(F.col("node").alias("a"), F.col("node_").alias("b"), need.alias("need")).distinct()
        if kind == "listed":
            lists = ws.save(live.groupBy("node").agg(F.collect_list("s").alias("l")), "lists")  # written, so that a hot node's join can be split
            for end in ("a", "b"):
                found = found.join(lists.select(F.col("node").alias(f"n{end}"), F.col("l").alias(f"l{end}")), F.col(end) == F.col(f"n{end}"))
            found = found.where(F.size(F.array_intersect("la", "lb")) >= F.col("need"))
        found = ws.save(found.select("a", "b"), f"met-{kind}")
        pairs = found if pairs is None else pairs.union(found)
    second = verified(pairs.distinct(), rows, ws, "second", k, percent)
    final = ws.save(components(first.union(second), ws), "components")
    ws.drop("keys", "near", "lists", *[f"{x}-{kind}{y}" for kind in ("listed", "subsets") for x, y in (("live", ""), ("met", "-posts"), ("met", ""))])

    # back to rows: a row's node, the node's component, the smallest id of rows in it
    by_set = nodes.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "node")
    linked = sets.select("id", "h1", "h2").join(by_set, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where("id <> node")
    copies = linked.select(F.col("id").alias("a"), F.col("node").alias("b")).distinct()
    component = final.select(F.col("node").alias("b_"), "component")
    of_copies = copies.join(component, F.col("b") == F.col("b_"), "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
    every = final.unionByName(of_copies).groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    every = ws.save(every, "every")
    if every.where("component <> other").limit(1).count():  # ids with several texts connect what these belong to
        chained = ws.save(components(final.select(F.col("node").alias("a"), F.col("component").alias("b")).union(of_copies.select("node", "component")), ws, name="chain"), "chained")
        every = chained.select("node", "component")
    found = signed.join(every.select(F.col("node").alias("v"), "component"), F.col("id") == F.col("v"), "left")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join(docs, Workspace(spark, "op9"))


def one_of_each(docs: DataFrame, ws: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key is their component's smallest, one row for each such key, and all rows with a null key."""
    kept = join(docs, ws, key, text).where((F.col(key) == F.col("component_id")) | F.col(key).isNull())
    kept = kept.where(F.col(key).isNotNull()).select(F.col(key).alias("__key")).distinct()
    first = docs.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col("__key"), "left_semi").dropDuplicates([key])
    return first.unionByName(docs.where(F.col(key).isNull()))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.c >= 80 * (x.n + y.n - o.c)),
r(doc_id, reach) AS (SELECT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
