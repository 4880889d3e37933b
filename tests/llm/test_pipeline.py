"""The pipeline's stages: columns, and what each keeps, against brute force on a small table."""

import shutil

import numpy as np
import pytest

import corpus_pipeline
from quorate.llm import decontamination

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(9)
    vocabulary = [a + b + c for a in ("re", "to", "an", "ing", "ou") for b in ("th", "er", "on") for c in ("al", "is", "ed")]
    items = [" ".join(rng.choice(vocabulary, 14)) for _ in range(4)]
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(vocabulary, 30))
        if i % 10 == 3:
            t = rows[-1][1]  # an exact copy
        if i % 10 == 6:
            t = rows[-1][1] + " end"  # a near copy
        if i % 17 == 5:
            t += " " + items[i % 4]
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
    rows += [(500, "123 !!", "en", "src0", 6), (501, None, "en", "src0", None), (502, "", None, None, 0)]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    yield str(d), rows, items
    shutil.rmtree(d)


def test_stages(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        path = f"{d}/out-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in kept["language"].collect()} == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    text = {r[0]: r[1] for r in rows}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in text.items() if i < 500}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {k: min(a, b) if v in (a, b) else v for k, v in group.items()}
    left = {r.doc_id for r in kept["near_duplicates"].collect()}
    assert left == {i for i, g in group.items() if i == g}
    number, a = decontamination.automaton(list(enumerate(items)), 10)
    clean = {i for i in left if not decontamination.scan_text(text[i], number, a)["hit"]}
    assert {r.doc_id for r in kept["decontamination"].collect()} == clean and clean < left
    mixed = [r.doc_id for r in kept["mix"].collect()]
    assert set(mixed) <= clean and max(map(mixed.count, mixed)) <= 2
    assert sorted(r.doc_id for r in kept["tokens"].collect()) == sorted(mixed)


def test_run(spark, folder):
    d = folder[0]
    assert corpus_pipeline.run(spark, d).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
