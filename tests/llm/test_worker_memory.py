"""What Python workers hold: batches of rows while a pipeline's stage runs, and what is left when a task has ended."""

import pyarrow as pa
import pytest

import corpus_pipeline
from quorate.llm import token_files
from quorate.llm.common import Workspace

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def default_batches(spark):
    before = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    yield
    spark.conf.set(KEY, before)


def largest_batch(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return max(r.n for r in df.mapInArrow(sizes, "n long").collect())


@pytest.mark.parametrize("name", ["language", "decontamination", "tokens"])
def test_stage_bounds_what_its_caller_runs(spark, tmp_path, default_batches, name):
    docs = spark.createDataFrame([(i, "some words of a text", "en", "src0", 20) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, "other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.count() == 3
    assert largest_batch(spark.range(0, 1000, 1, 1)) <= corpus_pipeline.BATCH


def test_encoder_forgets_at_the_end_of_a_task(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word', id, ' next', id * 7) AS text")
    manifest = token_files.write(docs, Workspace(spark, "forgets"), token_files.default_tokenizer())
    assert token_files.read(manifest).count() == 400

    def held(batches):
        for _ in batches:
            pass
        kept = token_files._kept.values()
        yield pa.RecordBatch.from_arrays([pa.array([len(kept)]), pa.array([sum(len(e.later) + len(e.first) for e in kept)])], ["encoders", "pieces"])

    rows = spark.range(0, 8, 1, 8).mapInArrow(held, "encoders long, pieces long").collect()
    assert any(r.encoders for r in rows)  # a worker that encoded was asked
    assert all(r.pieces == 0 for r in rows)
