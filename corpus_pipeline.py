"""A corpus pipeline in stages; each takes (spark, docs, sf_dir) and is written before the next one reads it.

Language identification drops documents without a language; the n-gram Jaccard join leaves one document of each group of
near duplicates; decontamination drops documents in which a window of a benchmark item occurs; mixing repeats documents to
target weights; the last stage writes token ids and returns a row per document of the files.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import decontamination, jaccard_join, language_id, mixing, token_files
from quorate.llm.common import Workspace, at_most, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document below this cosine to every language's prototype, or without a letter, is rejected.
LEAST_COSINE = 0.02
#: Rows of a batch for Python: workers live on from stage to stage, so that what one stage's batches need adds to the next one's.
BATCH = 250


def in_small_batches(stage: Callable) -> Callable:
    """The stage, with the session's batches bounded from then on: its caller runs what it returns, after it has ended."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        at_most(spark, BATCH)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the prototypes are learned from the stage's own labelled documents."""
    langs, p = language_id.prototypes(docs.where(~language_id.held_out()).select("lang", "text"))
    found = language_id.identify(docs.select(*COLUMNS), langs, p)
    return found.where((F.col("language.lang") != language_id.UNDETERMINED) & (F.col("language.score") >= LEAST_COSINE)).select(*COLUMNS)


@in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS), Workspace(spark, "stage-near"))


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights holds it."""
    return mixing.repeat(mixing.mix(docs, Workspace(spark, "stage-mix")), COLUMNS)


@in_small_batches
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and from these a row per document with its place and checksum."""
    return token_files.read(token_files.write(docs, Workspace(spark, "stage-tokens"), token_files.default_tokenizer()))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: No stage's model or tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark, BATCH):
        for name, stage in STAGES:
            docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
