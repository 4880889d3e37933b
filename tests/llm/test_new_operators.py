"""Threshold search, prefix trie, tree contraction, radix sort and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import importance, prefix_trie, threshold_search
from quorate.llm.common import Workspace
from quorate.llm.radix_sort import ranked
from quorate.llm.tree_contraction import subtree_sums

CLASHING = ("node", "row", "block", "part", "depth", "conv", "id", "score", "rank", "weight", "n_features", "dims", "vec", "n", "chunk", "digest", "kids")


@pytest.fixture()
def ws(spark):
    return Workspace(spark, "test")


def widened(df):
    for c in CLASHING:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# threshold search


def brute_top(rows, k, every=100):
    fine = []
    for at, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * 1024) for x in v):
            fine.append((at, i, [math.floor(1024.0 * x) for x in v]))
    out = []
    for at, i, q in fine:
        if i % every == 0:
            hits = [(-sum(a * b for a, b in zip(q, v, strict=True)), j, w) for w, j, v in fine if w != at and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def vectors(n, dims, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))
    return [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_threshold_search_is_exact(spark, ws):
    rows = vectors(900, 12)
    rows += [(100, rows[5][1]), (200, rows[6][1]), (1000, None), (1001, [1.0, None] * 6), (1100, [float("nan")] * 12), (None, rows[0][1]), (1200, [0.0] * 12), (1300, [1e306] * 12), (1400, [1.0, 2.0]), (1401, [2.0, 1.0]), (1500, []), (1501, []), (-100, [-x for x in rows[7][1]])]
    rows += [(2000 + i, rows[3][1]) for i in range(300)]  # copies: ties at the kth place
    df = widened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = threshold_search.search_all(df, ws, block=64)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 10)


def test_threshold_search_of_large_numbers_is_exact(spark, ws):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e5, 1e5) for _ in range(5)]) for i in range(150)]
    got = threshold_search.search_all(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ws, every=10, k=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 4, 10)
    huge = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 1.0])]
    got = threshold_search.search_all(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), Workspace(spark, "huge"))
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_threshold_search_of_nothing(spark, ws):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert threshold_search.search_all(none, ws).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0]), (7, None)], "vec_id long, embedding array<float>")
    assert threshold_search.search_all(alone, Workspace(spark, "alone")).count() == 0


def test_a_block_stops_before_its_lists_end():
    rng = np.random.default_rng(4)
    x = np.floor(rng.exponential(size=(4000, 2)) * 1024)
    order, ids = threshold_search.lists(x), np.arange(4000)
    scored = []
    real = threshold_search.scores
    threshold_search.scores = lambda a, q: (scored.append(len(a)), real(a, q))[1]
    try:
        q = np.array([700.0, 900.0])
        got = threshold_search.search(x, order, ids, ids, q, -1, 10, -math.inf)
    finally:
        threshold_search.scores = real
    want = sorted((-int(s), i) for i, s in enumerate(x @ q))[:10]
    assert [(-s, i) for s, i, _ in got] == want
    assert sum(scored) < 1000
    assert (threshold_search.bounds(x.min(axis=0)[:, None], x.max(axis=0)[:, None], q[None, :])[0, 0]) >= -want[0][0]


# tree contraction and prefix trie


def brute_sums(parents, value):
    kids = defaultdict(list)
    for v, p in parents.items():
        kids[p].append(v)
    order, out = [v for v, p in parents.items() if p is None or p not in parents], {}
    for v in order:
        order.extend(kids[v])
    for v in reversed(order):
        out[v] = value[v] + sum(out[k] for k in kids[v])
    return out


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar", "forest"])
def test_subtree_sums(spark, ws, shape):
    rng, n = random.Random(shape), 300
    parents = {0: None}
    for i in range(1, n):
        parents[i] = {"chain": i - 1, "star": 0, "random": rng.randrange(i), "caterpillar": i - 1 if i % 2 else max(0, i - 2), "forest": None if i % 50 == 0 else rng.randrange(i // 50 * 50, i)}[shape]
    names = rng.sample(range(10**6), n)
    parents = {names[v]: None if p is None else names[p] for v, p in parents.items()}
    parents[-5] = 10**9  # its parent isn't there
    value = {v: rng.randrange(-3, 10) for v in parents}
    df = spark.createDataFrame([(v, p, value[v], None) for v, p in parents.items()], "node long, parent long, x long, y long").coalesce(2)
    got = subtree_sums(df, ["x", "y"], ws).collect()
    assert {r.node: r.x for r in got} == brute_sums(parents, value)
    assert {r.y for r in got} == {0} and len(got) == len(parents)


def test_subtree_sums_of_cycles_and_nothing(spark, ws):
    with pytest.raises(ValueError, match="cycle"):
        subtree_sums(spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1)], "node long, parent long, x long").coalesce(1), ["x"], ws)
    assert subtree_sums(spark.createDataFrame([], "node long, parent long, x long"), ["x"], Workspace(spark, "none")).count() == 0


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role[:32], hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[4:] for t in sorted(x)] for c, x in convs.items()}
    new = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - math.fmod(c, 100)
        new[c] = turns.get(int(base), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in new.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        inside = [x for x in members if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(new[c]) == len(k)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in inside if x)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[x] for x in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 12), *range(100, 130), 205, 317, -3, 400]:
        for t in range(rng.choice([1, 2, 4, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello there", "ok", "naïve 😀", ""])))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(40) for t in range(7)]  # a group of copies
    rows += [(700, t, None, f"deep {t}") for t in range(60)]
    rows += [(800, None, "user", "no turn"), (800, 3, "user", "b"), (800, 3, "user", "a"), (800, 3, None, None), (800, 3, "user", "a"), (None, 1, "user", "no conversation"), (900, 0, "user", "x" * 100_000), (999, 0, "r" * 50, "y")]
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_prefix_trie(spark, ws, partitions):
    rows = conversations()
    df = widened(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(partitions)
    got = prefix_trie.trie(df, ws)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == sorted(brute_trie(rows), key=lambda r: r[:2])


def test_a_node_whose_ends_lie_in_several_parts(spark, ws):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, 0, "user", "same") for c in range(300)]
        got = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ws).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(brute_trie(rows), key=lambda r: r[:2])


def test_prefix_trie_of_nothing(spark, ws):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), ws).count() == 0


# radix sort and importance resampling


@pytest.mark.parametrize(("bits", "block_bits"), [(10, 13), (3, 4), (1, 2)])
def test_radix_ranks(spark, ws, bits, block_bits):
    rng = random.Random(6)
    rows = [(rng.choice([None, -5, 0, 3, 3, 70]), rng.choice([None, 1, -2, 9])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5).withColumn("place", F.lit(1)).withColumn("rank", F.lit("old"))
    got = ranked(df, [("a", True), ("b", False)], ws, bits=bits, block_bits=block_bits).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 201))
    first = lambda x, down: (x is None, 0 if x is None else -x if down else x)
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (first(r[0], True), first(r[1], False)))


def test_radix_ranks_over_the_whole_range_of_longs(spark, ws):
    rng = random.Random(7)
    rows = [(rng.choice([2**63 - 1, -(2**63), 0, rng.randrange(-(2**63), 2**63)]), i) for i in range(60)]
    for down in (False, True):
        got = ranked(spark.createDataFrame(rows, "a long, b long"), [("a", down), ("b", False)], Workspace(spark, "wide"), bits=16).orderBy("rank").collect()
        assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (-r[0] if down else r[0], r[1]))
    assert ranked(spark.createDataFrame([], "a long"), [("a", False)], ws).count() == 0
    same = ranked(spark.createDataFrame([(4,)] * 50, "a long"), [("a", False)], Workspace(spark, "same"))
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 51))


def brute_sample(docs, target, percent=10, least=20, longest=1, buckets=10_000):
    def feats(t):
        w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return w, [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in feats(x)[1]), Counter(b for x in target for b in feats(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in s}
    out = []
    for i, x in docs:
        w, f = feats(x)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = rank + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_resampling(spark, ws, longest):
    rng = random.Random(8)
    vocabulary = [f"Wort{i}" for i in range(300)] + ["naïve", "日本語", "A1b2", "x-y"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 19, 20, 21, 60, 200])))) for i in range(300)]
    docs += [(7, docs[7][1]), (9, "other text under a known id " * 5), (None, "no id " * 12), (1000, None), (1001, ""), (1002, ",;!"), (1003, "long " * 60_000), (-4, "minus " * 30)]
    docs += [(2000 + i, "a copy of one text " * 6) for i in range(150)]
    target = [" ".join(vocabulary[:40]), None, "", "Wort1 wort2 WORT3"]
    df = widened(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, ws, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_sample(docs, target, longest=longest)


def test_importance_of_nothing(spark, ws):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.select("text"), ws).count() == 0
    one = spark.createDataFrame([(1, "word " * 25)], "doc_id long, text string")
    got = importance.resample(one, none.select("text"), Workspace(spark, "one"), percent=100).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in got] == [(1, 25, 1)]
