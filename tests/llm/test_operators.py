"""The operators against brute force and round trips, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorate.llm import common, cover_tree_join, decontamination, jaccard_join, language_id, mixing, resharding, token_files, token_rollups, toxicity, url_filter
from quorate.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, n)) for n in (3, 5, 6, 8, 12, 40, 120, 300)]
    out = []
    for b in base:
        w = b.split()
        out += [b, b.upper(), b + "  "]
        for k in (1, 2, 5):
            c = list(w)
            for at in rng.integers(0, len(c), min(k, len(c))):
                c[at] = "changed"
            out.append(" ".join(c))
        out.append(" ".join([*w, "more"]))
    return [*out, None, "", "   \t", "a", "a", "word " * 3000, "x" * 50_000]


def rows():
    return [(i, t, "en" if i % 3 else None, "ab"[i % 2] if i % 5 else None, len(t or "")) for i, t in enumerate(texts())]


def docs(spark, extra=True):
    df = spark.createDataFrame([*rows(), (7, "repeated id", "en", "a", 1), (None, "no id at all here", None, None, None), (3, rows()[3][1], "en", "a", 1)], DOCS)
    if extra:  # names that operators use themselves
        for c in ("block", "shard", "size", "n", "node", "component", "scan", "language", "mix_size", "h", "host", "rule", "k", "t", "id", "comp", "s", "label", "point"):
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture()
def ws(spark):
    return Workspace(spark, "test")


def test_components(spark, ws):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (20, 19), (19, 18), (18, 17), (17, 16), (3, 30)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 10: 10, 11: 10, 16: 16, 17: 16, 18: 16, 19: 16, 20: 16}
    assert common.components(spark.createDataFrame([], "a long, b long"), ws, name="none").count() == 0


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(items):
    up = {i: i for i, _ in items}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in items]
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            a_, b_ = sorted((top(i), top(j)))
            up[b_] = a_
    return {i: top(i) for i, _ in items}, dict((i, len(s)) for i, s in sets)


def test_jaccard_join(spark, ws):
    df = spark.createDataFrame(rows(), DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, ws).collect()}
    comp, n = brute_components([(r[0], r[1]) for r in rows()])
    assert got == {i: (n[i], comp[i]) for i in comp}


def test_jaccard_join_edges(spark, ws):
    got = jaccard_join.join(docs(spark), ws).collect()
    assert len(got) == len(rows()) + 3
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = jaccard_join.one_of_each(docs(spark), Workspace(spark, "one"))
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(ids.values()) == 1 and None in ids
    assert jaccard_join.join(docs(spark).limit(0), Workspace(spark, "none")).count() == 0


def test_jaccard_bounds():
    for n in range(1, 60):
        for m in range(1, 60):
            need = jaccard_join.overlap(n, m)
            assert all((100 * c >= 80 * (n + m - c)) == (c >= need) for c in range(min(n, m) + 1))
            if n <= m and 100 * n >= 80 * m and m <= 12:
                assert need in jaccard_join.subset_sizes(n, 12) and need in jaccard_join.subset_sizes(m, 12)
    assert jaccard_join.boundary({}, 2.0) in range(13)


def test_all_boundaries_agree(spark, ws, monkeypatch):
    df = spark.createDataFrame(rows(), DOCS)
    want = None
    for small in (0, 4, 12):
        monkeypatch.setattr(jaccard_join, "boundary", lambda *a, small=small: small)
        got = sorted(tuple(r) for r in jaccard_join.join(df, Workspace(spark, "b")).collect())
        want = want or got
        assert got == want


def test_decontamination(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, ""), (4, None), (None, "id less item"), (1, "same id again")]
    inside = "Zero ONE two, three four-five six seven eight nine TEN! and a short item. same id again"
    d = [(1, inside), (2, None), (3, ""), (4, "nothing"), (5, "short  item short item"), (6, "é one two three four five six seven eight nine ten eleven " * 50), (7, "an id-less item")]
    df = spark.createDataFrame(d, "doc_id long, text string").withColumn("scan", F.lit("x"))
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r["found"] for r in decontamination.scan(df, it, out="found").collect()}
    assert got[1]["items"] == [1, 2] and len(got[1]["hit"]) == 15 and got[1]["n_words"] == 18
    assert [inside[s["start"] : s["end"]] for s in got[1]["spans"]] == ["ONE two, three four-five six seven eight nine TEN", "short item. same id again"]
    assert got[5]["items"] == [2] and len(got[5]["hit"]) == 4 and got[7]["hit"] == [1, 2, 3] and got[7]["items"] == []
    assert len(got[6]["hit"]) == 550 and not got[2]["hit"] and not got[3]["n_words"] and not got[4]["hit"]
    blocks = {r.doc_id: r["found"] for r in decontamination.scan(df, it, out="found", most_words=3).collect()}
    assert blocks == got
    clash = df.withColumn("scan__0", F.lit(1)).withColumn("__scan", F.lit(2))
    assert decontamination.scan(clash, it, most_words=3).columns == ["doc_id", "text", "scan__0", "__scan", "scan"] and decontamination.clean(clash, it).columns == clash.columns
    over = spark.createDataFrame([(1, "one two three"), (2, "three four five")], "item_id long, text string")
    for most in (1, 100):
        (row,) = decontamination.scan(spark.createDataFrame([("one two three four five",)], "text string"), over, most_words=most).collect()
        assert [tuple(x) for x in row.scan.spans] == [(0, 23)] and row.scan.hit == [0, 1, 2, 3, 4]
    assert sorted(r.doc_id for r in decontamination.clean(df, it).collect()) == [2, 3, 4]
    assert decontamination.clean(df, it.limit(0)).count() == 7 and decontamination.scan(df.limit(0), it).count() == 0


def shared_targets(sizes):
    """Share, cap, share again."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    open_, left, want = set(sizes), 1.5 * sum(sizes.values()), {}
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return want | {s: left * weight[s] / w for s in open_}
        for s in over:
            want[s] = 2.0 * sizes[s]
        left -= sum(want[s] for s in over)
        open_ -= over


@pytest.mark.parametrize("sizes", [{"a": 3000, "b": 1000}, {"a": 900, "b": 1000, "c": 2000, "d": 900}, {"a": 0, "b": 0}, {"a": 0, "b": 7}, {"a": 3, "b": 1, "c": 2, None: 3}, {None: 5}, {"a": 10**9, "b": 1, "c": 1, "d": 10**9, "e": 333, "f": 2}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == {s: pytest.approx(t) for s, t in shared_targets(sizes).items()}


def test_mixing_sql(spark, tmp_path):
    """The SQL against the query where sources tie, ids are null or repeated, and a source has no words."""
    rows = [(i if i % 7 else None, " ".join(["w"] * (1 + i % 9)) + f" {i}", "en", ("a", "b", "c", "d")[i % 4], 0) for i in range(400)]
    rows += [(500, None, "en", "empty", 0), (500, "x", "en", None, 0), (501, "same", "en", "a", 0), (501, "same", "en", "a", 0)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.query(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.SQL).df()
    key = lambda df: sorted(map(str, df[["doc_id", "size", "source_size", "target", "taken"]].astype(float).values.tolist()))
    assert key(got) == key(want)


def test_mixing_many_null_ids(spark, ws):
    rows = [(None, f"word {i} " + "x " * (i % 5), "en", "ab"[i % 2], 0) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), ws).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect()
    assert len(got) == 2 and all(abs(r.taken - r.target) <= 7 for r in got)


def test_mixing(spark, ws):
    got = [r.asDict() for r in mixing.mix(docs(spark), ws).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()]
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        targets[r["source"]] = r["mix_target"]
        assert 0 <= r["mix_copies"] <= 2
    want = shared_targets(sizes)
    assert {s: pytest.approx(t) for s, t in want.items()} == targets
    assert all(abs(taken[s] - targets[s]) <= 3000 / 2 + 1 for s in sizes)  # half of the longest document
    again = [r.asDict() for r in mixing.mix(docs(spark).repartition(7), Workspace(spark, "again")).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.repeat(mixing.mix(docs(spark), Workspace(spark, "rep")), ["doc_id", "text"])
    assert out.count() == sum(r["mix_copies"] for r in got)
    assert mixing.mix(docs(spark).limit(0), Workspace(spark, "none")).count() == 0


def test_resharding(spark, ws):
    old = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4))
    df = docs(spark).withColumn("p_old", F.lit(1)).withColumn("p_block", F.lit(1))
    moved, plan = resharding.reshard(df, ws, old, new_shards=5, blocks=16)
    out = resharding.slots(moved, F.col("doc_id"), F.crc32(F.col("text").cast("binary"))).collect()
    assert len(out) == df.count()
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, ((r.doc_id, r.text) for r in df.collect())))
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert resharding.reshard(df.limit(0), Workspace(spark, "none"), old)[0].count() == 0


def test_resharding_law_and_moves(spark, tmp_path):
    """The query: shards' bytes nearly equal, and hardly more bytes moved than any assignment must move."""
    rng = np.random.default_rng(8)
    rows = [(int(i) if i % 50 else None, "é" * int(n)) for i, n in enumerate(rng.integers(0, 300, 12_000))] + [(7, None), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = resharding.query(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want and {r.law for r in got} == {"bytes"}
    size, held, slots = Counter(), Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        held[r.old_shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    share = sum(size.values()) / 40
    assert max(abs(n - share) for n in size.values()) < 700  # about the largest row; a block has less
    moved = sum(r["size"] for r in got if r.shard != r.old_shard)
    least = sum(held.values()) - sum(min(held[j], share) for j in range(40))  # what stands above a shard's share must move
    assert abs(moved - least) <= 40 * 700


def test_flow_moves_least():
    old = {0: 100, 1: 40, 2: 60}
    new = {0: 50, 1: 50, 2: 50, 3: 50}
    f = resharding.flow(old, new)
    assert all(sum(v for (i, _), v in f.items() if i == a) == n for a, n in old.items())
    assert all(sum(v for (_, j), v in f.items() if j == a) == n for a, n in new.items())
    assert sum(v for (i, j), v in f.items() if i != j) == 60  # what stands above capacity
    with pytest.raises(ValueError):
        resharding.flow({0: 10}, {0: 5})


def test_language_id(spark):
    en = ["the quick brown fox jumps over the lazy dog and runs home", "this is a house with a garden and many things in it", "what they said was that there is nothing to do"]
    de = ["der schnelle braune fuchs springt über den faulen hund", "das ist ein haus mit einem garten und vielen dingen darin", "was sie sagten war dass es nichts zu tun gibt"]
    df = spark.createDataFrame([("en", x) for x in en * 3] + [("de", x) for x in de * 3] + [(None, "x y z"), ("en", None), ("fr", "")], "lang string, text string")
    langs, p = language_id.prototypes(df)
    assert {"en", "de"} <= set(langs)
    probe = [("the garden of the house is there", "en"), ("der garten und das haus sind schnell", "de"), (None, "und"), ("", "und"), ("123 !!", "und"), ("the thing " * 5000, "en")]
    got = language_id.identify(spark.createDataFrame(probe, "text string, want string").withColumn("language", F.lit(1)), langs, p).collect()
    assert all(r.language.lang == r.want and 0 <= r.language.score <= 1 for r in got)
    none, q = language_id.prototypes(df.limit(0))
    assert none == [] and language_id.identify(df.limit(2), none, q).select("language.lang").distinct().collect()[0][0] == "und"
    empty = language_id.identify(spark.createDataFrame(probe, "text string, want string").limit(0), langs, p)
    assert empty.count() == 0
    twice = language_id.identify(spark.createDataFrame([("das haus",), ("das haus",)], "text string"), langs, p).select("language").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    # the prototypes summed the plain way: square roots of trigram counts by bound vectors, less the mean, of length 1
    plain = []
    for lang in langs:
        n = Counter()
        for t in (r.text for r in df.where(F.col("lang") == lang).collect()):
            n.update(language_id.trigrams(t or "").tolist())
        v = sum((np.sqrt(c) * language_id.gram_vectors(np.array([g]))[0] for g, c in sorted(n.items())), np.zeros(language_id.DIMENSIONS))
        plain.append(v / max(np.linalg.norm(v), 1e-12))
    plain = np.array(plain) - np.mean(plain, axis=0)
    assert np.allclose(p, plain / np.linalg.norm(plain, axis=1, keepdims=True), atol=1e-5)
    v = language_id.gram_vectors(np.array([5, 5, 900]), 256)  # binding is fixed and nearly orthogonal
    assert (v[0] == v[1]).all() and abs(int(v[0].astype(int) @ v[2])) < 100


def test_token_rollups(spark, ws):
    d = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None), (2, "x", "en", "s"), (3, "p-q r", "en", "s")], "doc_id long, text string, lang string, source string")
    d = d.withColumn("tokens", F.lit("x")).withColumn("docs", F.lit("x")).withColumn("tokenizer", F.lit("x")).withColumn("n_tokens", F.lit("x")).withColumn("batch", F.lit("x"))
    one = token_rollups.counted(d, "words_v1")
    none = one.limit(0)
    r = token_rollups.Rollup(spark, f"{ws.path}/r", every=2)
    assert r.totals().count() == 0 and r.batches() == [] and not r.compact()
    assert r.commit("a/1 _x.y", token_rollups.deltas(none, one)) and not r.commit("a/1 _x.y", token_rollups.deltas(none, one))
    assert r.commit("b", token_rollups.deltas(one.where("doc_id = 1"), none))
    assert common.children(spark, f"{r.path}/snapshots") == ["000000000001"]
    assert r.commit("c", token_rollups.deltas(one.where("doc_id = 3"), token_rollups.counted(d.where("doc_id = 3"), "words_v2")))
    assert r.commit("empty", token_rollups.deltas(none, none))
    want = {("s", "en", "words_v1"): (1, 1), (None, None, "words_v1"): (1, 0), ("s", "en", "words_v2"): (1, 4)}
    totals = lambda: {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert totals() == want and r.batches() == ["a/1 _x.y", "b", "c", "empty"]
    assert not r.commit("b", token_rollups.deltas(none, one)) and totals() == want
    assert r.commit("d", token_rollups.deltas(none, one.where("doc_id = 1"))) and r.compact()
    assert totals() == want | {("s", "en", "words_v1"): (2, 3)}


def test_writers_of_one_batch_count_once(spark, ws):
    from concurrent.futures import ThreadPoolExecutor

    changes = spark.createDataFrame([("s", "en", "t", 1, 5)], "source string, lang string, tokenizer string, docs long, tokens long")
    for k in range(3):
        path = f"{ws.path}/r{k}"
        with ThreadPoolExecutor(4) as pool:
            won = list(pool.map(lambda _: token_rollups.Rollup(spark, path, every=1).commit("same", changes), range(4)))  # noqa: B023
            mixed = list(pool.map(lambda i: token_rollups.Rollup(spark, path, every=1).commit(f"own-{i}", changes), range(4)))  # noqa: B023
        assert sorted(won) == [False, False, False, True] and all(mixed)
        assert [tuple(x) for x in token_rollups.Rollup(spark, path).totals().collect()] == [("s", "en", "t", 5, 25)]
        assert common.children(spark, f"{path}/attempts") == []


def test_rollup_of_tokenizer_ids(spark, ws, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    got = token_rollups.counted(docs(spark), token_rollups.BPE).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in docs(spark).collect())
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    want = defaultdict(lambda: [0, 0])
    for r in docs(spark).collect():
        k = None if r.doc_id is None else r.doc_id % 10
        if k != 0:
            again = k is not None and 1 <= k <= 4
            n = len(tok.encode(r.text or "", add_special_tokens=False).ids) if again else len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            sums = want[r.source, r.lang, token_rollups.BPE if again else "words_v1"]
            sums[0], sums[1] = sums[0] + 1, sums[1] + n
    assert {tuple(r)[:3]: [*tuple(r)[3:]] for r in token_rollups.query(spark, str(tmp_path)).collect()} == dict(want)


def test_items_may_have_any_id(spark):
    d = spark.createDataFrame([(1, "one two three"), (2, "nothing"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("mmlu/1", "two three"), ("mmlu/10", "one"), (None, "nothing"), ("mmlu/2", "absent words")], "item_id string, text string")
    got = {r.doc_id: (r.scan["items"], len(r.scan.hit)) for r in decontamination.scan(d, items).collect()}
    assert got == {1: (["mmlu/1", "mmlu/10"], 3), 2: ([], 1), 3: ([], 0)}
    assert [r.doc_id for r in decontamination.clean(d, items, most_words=1).collect()] == [3]


def test_labels_in_the_documents_are_not_read(spark):
    d = spark.createDataFrame([(i, f"text {i}", 5) for i in range(30)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    got = toxicity.training_rows(d, labels)
    assert got.columns == ["text", "toxic"] and {r.toxic for r in got.collect()} == {0, 1}


def test_token_files(spark, ws, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_TOKENS", 5000)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 20_000)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    manifest = token_files.write(docs(spark), ws, token_files.default_tokenizer(), length=128)
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs(spark).collect()), key=lambda x: (x is not None, x))
    by = defaultdict(list)
    for r in docs(spark).collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        by[r.doc_id].append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by[r.doc_id]
        by[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    f = manifest.orderBy("part", "k").first()
    reader = token_files.open_file(f.folder, f.file)
    ids, mask = token_files.sequence(reader, 0)
    assert len(ids) == len(mask) == 128 and not ids.flags.owndata and mask.to_pylist()[0]
    last, tail = token_files.sequence(reader, f.n_sequences - 1)
    assert sum(tail.to_pylist()) == f.n_tokens - 128 * (f.n_sequences - 1) and isinstance(reader, pa.ipc.RecordBatchFileReader)
    assert token_files.read(token_files.write(docs(spark).limit(0), Workspace(spark, "none"), token_files.default_tokenizer())).count() == 0


def test_encoder_equals_tokenizer():
    e = token_files.Encoder(token_files.default_tokenizer())
    assert e.by_piece
    x = ["", " a", "a ", "a  b", "a\n b c", "x <|endoftext|> y", "it's, don't. 's 12ab!!", "a\tb c", "日本 語, é. x", ". . ., a.", "a b\n\nc d\n", "a\u00a0 b c", "a\n \nb", "a \nb", " \n", "a   b", "w" * 300 + " " + "v" * 300 + ".", "a's' 'b' _c_ 1.5 x$$$ y.***", "\u00b2. x\u2160, \u0e01."] * 2
    rng = np.random.default_rng(11)
    parts = [" ", " ", "\n", "\t", "a", "Bc", "é", "1", ".", ",", "'s", "'", "$", "_", "\u00a0", "語", "-"]
    x += ["".join(rng.choice(parts, n)) for n in range(1, 60) for _ in range(5)]
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, e.kind).tobytes() for t in x]
    assert e.encode(pa.array(x)) == want and e.encode(pa.array(x)) == want and max(map(len, e.later)) <= token_files.LONGEST
    e.held = token_files.MEMORY + 1
    assert e.encode(pa.array(x[:9])) == want[:9] and 0 < e.held < 10_000
    assert e.encode(pa.array([], pa.string())) == []
    e.by_piece = False
    assert e.encode(pa.array(x)) == want


def test_chunks():
    t = ["a" * n for n in (3, 0, 50, 4, 4, 4, 0, 9, 1, 30, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(t[a:b], pa.string())], ["k", "t"]) for a, b in ((0, 1), (1, 1), (1, 5), (5, 9), (9, 11))]
    got = list(token_files.chunks(iter(batches), 10))
    assert [i for k, _ in got for i in k.to_pylist()] == list(range(11)) and [x for _, c in got for x in c.to_pylist()] == t
    assert all(len(c) == 1 or sum(map(len, c.to_pylist())) <= 10 for _, c in got) and list(token_files.chunks(iter([]), 10)) == []


def judge(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_filter(spark, ws):
    urls = ["http://A.Example.NET/en/1", "https://x.net/", "https://x.net", "ftp://example.com/de/?q", "http://example.com/dex", "https://a.org/fr/x#y", None, "", "no scheme", "x://", "http://xnet/", "http://u@h:80/p?a/b", "http://good.example.com/a", "http://good.example.com/a"]
    html = [None, "", '<a href="http://x.net/q">', "<a href='https://GOOD.example.com'>"] * 4
    df = spark.createDataFrame([(i, u, html[i % 4]) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("verdict", F.lit(0))
    for r in url_filter.judge(df, ws).collect():
        host, path, best = judge(r.url)
        assert (r.host, r.path) == (host, path) and r.rule == (best[1] if best else None) and r.verdict in ("allow", "block")
        assert not best or r.verdict == best[0]
    assert url_filter.judge(df.limit(0), Workspace(spark, "none")).count() == 0


def test_url_filter_clashing_names(spark, ws):
    df = spark.createDataFrame([(1, "http://a.com/x", None), (2, None, None)], "page_id long, url string, html string")
    for c in ("bad_host", "__host", "__rule", "v", "h", "from", "to", "src", "trust", "w"):
        df = df.withColumn(c, F.lit("x"))
    got = url_filter.judge(df, ws)
    assert got.columns == [*df.columns, "host", "path", "rule", "verdict"] and got.count() == 2


def test_propagation(spark):
    """Distrust flows against links: who links to a blocked host is distrusted, however many links away."""
    chain = [("fan", "bad"), ("good", "friend")] + [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", "bad"), ("friend", "n0")]
    g = spark.createDataFrame(chain, "src string, dst string")
    s = spark.createDataFrame([("good", 1.0, 0.0), ("bad", 0.0, 1.0)], "host string, trust double, distrust double")
    out, into = defaultdict(list), defaultdict(list)
    for a, b in chain:
        out[a].append(b)
        into[b].append(a)
    trust, distrust = {"good": 1.0}, {"bad": 1.0}
    for _ in range(300):
        new_t, new_d = Counter({"good": 0.15}), Counter({"bad": 0.15})
        for h, x in trust.items():
            for b in out[h]:
                new_t[b] += 0.85 * x / len(out[h])
        for h, x in distrust.items():
            for b in into[h]:
                new_d[b] += 0.85 * x / len(into[h])
        trust, distrust = new_t, new_d
    for hot in (100_000, 1):  # all edges in one part, each in a part of its own
        got = {r.host: r for r in url_filter.propagate(g, s, Workspace(spark, "p"), tolerance=1e-6, hot=hot).collect()}
        assert got["n0"].distrust > 0 and got["friend"].trust > 0 and not got["fan"].trust
        for h in {x for e in chain for x in e}:
            assert abs((got[h].trust if h in got else 0) - trust[h]) < 1e-5 and abs((got[h].distrust if h in got else 0) - distrust[h]) < 1e-5


def test_cover_tree_join(spark, ws, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base + rng.normal(scale=0.1, size=base.shape), base + rng.normal(scale=0.25, size=base.shape), base[:5], 2 * base[5:8]]).astype(np.float32)
    v = [(i, [float(a) for a in r], int(i % 3)) for i, r in enumerate(x)]
    v += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None] + [0.0] * 6, 1), (203, [float("nan")] * 8, 1), (204, v[0][1], None), (205, [float("inf")] * 8, 0), (206, [], 0), (207, [1.0], 0), (208, [2.0], 0)]
    want, links = {}, defaultdict(set)
    for (i, a, la), (j, b, lb) in combinations(v, 2):
        if la is None or la != lb or not a or not b or len(a) != len(b) or None in a or None in b:
            continue
        p, q = np.array(a), np.array(b)
        if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any() and p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.93:
            links[i].add(j)
            links[j].add(i)
    for i, _, _ in v:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = (len(links[i]), min(seen), min(seen) == i)
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").withColumn("point", F.lit(1)).withColumn("cell", F.lit(1))
    for block, sample, part in ((2000, 1200, 50_000), (7, 1200, 5), (14, 0, 50_000)):  # without a sample nodes are divided by hash
        monkeypatch.setattr(cover_tree_join, "SAMPLE", sample)
        monkeypatch.setattr(cover_tree_join, "PART", part)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree_join.near_duplicates(df, Workspace(spark, "tree"), block=block).collect()}
        assert got == want
    assert cover_tree_join.near_duplicates(df.limit(0), ws).count() == 0


def test_cover_tree_of_one_direction(spark):
    """Vectors of one direction are at no distance from one another: no centre divides them, and all link."""
    v = [(i, [float(i + 1), 2.0 * (i + 1)], 0) for i in range(60)]
    got = cover_tree_join.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>, label int"), Workspace(spark, "line"), block=7).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)} and sum(r.kept for r in got) == 1


def test_cover_tree_prunes(spark):
    """Clusters: nearly all pairs of blocks are pruned."""
    share = {}
    for n in (40, 160):
        rng = np.random.default_rng(6)
        centres = rng.normal(size=(n, 16))
        x = np.repeat(centres, 25, axis=0) + rng.normal(scale=0.05, size=(25 * n, 16))
        df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
        ws = Workspace(spark, "prune")
        got = cover_tree_join.near_duplicates(df, ws, block=50)
        assert got.where("kept").count() == n
        blocks, pairs = spark.read.parquet(f"{ws.path}/blocks").count(), spark.read.parquet(f"{ws.path}/pairs").count()
        assert blocks >= 25 * n / 50 and pairs <= blocks * (blocks + 1) / 2
        share[n] = pairs / (blocks * (blocks + 1) / 2)
    assert max(share.values()) < 0.25


def test_cover_tree_radii():
    u = cover_tree_join.unit(np.random.default_rng(1).normal(size=(200, 4)))
    t = cover_tree_join.Tree(u)
    for level, (c, node, r) in enumerate(zip(t.centres, t.node, t.radius, strict=True)):
        away = np.linalg.norm(u - u[c[node]], axis=1)
        assert (away <= r[node] + 1e-6).all()
        if level:
            assert set(t.centres[level - 1]) <= set(c) and (t.parent[level][node] == t.node[level - 1]).all()


def toxic_texts():
    rng = np.random.default_rng(2)
    words = [a + b + c for a in ("re", "to", "an", "ing") for b in ("th", "er", "on") for c in ("al", "is", "ed")]
    clean = [" ".join(rng.choice(words, 20)) for _ in range(200)]
    return clean, [x + " stupid idiot bad " + x[:30] for x in clean[:60]]


def test_toxicity(spark):
    clean, bad = toxic_texts()
    model = toxicity.language_model(spark.createDataFrame([(x,) for x in clean + bad] + [(None,)], "text string"))
    for w in ("stup1d", "5tupid", "stuuuupid", "s.t.u.p.i.d", "s...t...u...p...i...d", "sstupid", "$$tupid", "$tup1d"):
        assert toxicity.read_word(w, model)[-1] == "stupid", w
    assert [toxicity.read_word(w, model)[-1] for w in ("1d1ot", "idiot!!", "iidiot", "idiott")] == ["idiot"] * 4
    reader = toxicity.Reader(model, None)
    for t in ("an I D I O T here", "x i  d  i  o  t", "i\nd\ni\no\nt", "i-d i*o.t!", "b a d", "b.a.d, no", "so i d i o t a"):
        assert {"=idiot", "=bad"} & set(reader.of_text(t)), t
    assert "idiot" in toxicity.restore_text("an I D I O T here", model)
    rows = [(x, 0) for x in clean[60:]] + [(x, 1) for x in bad] + [(None, 1), ("x", None)]
    c = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), model)
    probe = [("an 1d10t and stup1d one", 1), (clean[70], 0), ("ing i d i o t, s t u p i d ed", 1), ("", 0), (None, 0), ("a" * 20_000, 0), (clean[70], 0), ("!1|" * 3000, 0)]
    df = spark.createDataFrame(probe, "text string, want int").withColumn("toxicity", F.lit("x")).withColumn("y", F.lit("x"))
    got = toxicity.score(df, model, c).collect()
    assert len(got) == len(probe) and [int(r.toxicity >= 0.5) for r in got] == [y for _, y in probe]
    assert toxicity.score(df.limit(0), model, c).count() == 0
    again = toxicity.fit(spark.createDataFrame([*rows[::-1], *rows[:9]], "text string, toxic int").repartition(3), model)  # order and copies tell nothing
    assert again.number == c.number and np.allclose(again.sums, c.sums)
    one = toxicity.fit(spark.createDataFrame(rows[:5], "text string, toxic int"), model)
    assert 0 <= one.score(Counter()) < 0.5
    assert 0 <= toxicity.fit(spark.createDataFrame([], "text string, toxic int"), model).score(Counter()) <= 1


def test_viterbi_equals_enumeration(spark):
    """The decoded word has the best score of all paths through the lattice."""
    clean, bad = toxic_texts()
    model = toxicity.language_model(spark.createDataFrame([(x,) for x in clean + bad], "text string"))

    def score(path):
        total, a, b = 0.0, 0, 0
        for text, cost in path:
            total += cost
            if text:
                s = int(language_id._table()[ord(text)])
                total, a, b = total + model(a, b, s), b, s
        return total + model(a, b, 0)

    words = ["stup1d", "5tupid", "sttuupiid", "1!1|", "6ooddd", "a", "", "x.y-8", "b4d", "ll", "é€3"]
    for w in words:
        paths = list(product(*[toxicity.options(w, i) for i in range(len(w))]))
        best = max(map(score, paths))
        got = toxicity.restore(w, model)
        assert any("".join(t for t, _ in p) == got and score(p) >= best - 1e-4 for p in paths), (w, got)
    flat = toxicity.Model(np.array([1]), np.array([1.0]))  # nearly all letters alike: equal paths, and still one answer
    assert toxicity.restore("11", flat) == toxicity.restore("11", flat)


def test_logistic_weights():
    rng = np.random.default_rng(4)
    x = rng.random((300, 6)) < 0.3
    x[:, 5] = x[:, 4]  # equal columns
    y = (rng.random(300) < 1 / (1 + np.exp(-(4.0 * x[:, 0] - 3.0 * x[:, 1] - 1)))).astype(float)
    w = toxicity.weights([np.flatnonzero(r).tolist() for r in x], y, 6, 0.1)
    full = np.column_stack([x, np.ones(300)])
    slope = full.T @ (y - 1 / (1 + np.exp(-full @ w))) - np.array([0.1] * 6 + [0.01]) * w
    assert np.abs(slope).max() < 1e-2 and w[0] > 2 and w[1] < -1 and np.isclose(w[4], w[5])


def test_toxicity_query(spark, tmp_path):
    """The registered query on a small fixture: ids, flags, and held-out rows right."""
    clean, bad = toxic_texts()
    rows = [(i, t) for i, t in enumerate(clean + bad)] + [(900, None), (901, ""), (None, bad[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(260)] + [(900, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {i for i, _ in rows}
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 260 and r.held_out:
            assert r.predicted == int(r.doc_id >= 200)


def test_item_digest_is_hex(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
