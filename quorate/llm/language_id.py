"""Language identification by hyperdimensional profiles.

Each of 128 symbols (separator, a to z, further letters by code point) has three random +-1 vectors that are rotations of
one another, one per place in a trigram. Their product binds a trigram. A text's trigrams, each weighted by the square root of
how often it occurs so that the commonest do not drown the others, are summed to bundle its profile; a language's prototype
bundles the counts of all its training texts alike. A text goes to the prototype with the largest cosine, of equal ones to the
first language in order; prototypes are compared without what all of them share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import small_batches

DIMENSIONS = 1024
SEED = 20240229
UNDETERMINED = "und"
_SYMBOLS = 128
_GRAMS = _SYMBOLS**3
_cache: dict = {}


def _table() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 1 to 26 for a to z, a number by code point for other letters."""
    if "table" not in _cache:
        t = np.fromiter((27 + c % 101 if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint8, 0x110000)
        t[0x61:0x7B] = np.arange(1, 27)
        _cache["table"] = t
    return _cache["table"]


def trigrams(text: str) -> np.ndarray:
    """Numbers of a text's trigrams over lower-cased letters; runs of anything else count as one separator."""
    c = _table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    c = np.concatenate(([0], c, [0]))
    c = c[np.concatenate(([True], (c[1:] > 0) | (c[:-1] > 0)))]
    return (c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:] if len(c) > 2 else c[:0]


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row per trigram: its letters' vectors, permuted by place and bound by multiplication."""
    if ("letters", dimensions) not in _cache:
        _cache["letters", dimensions] = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (_SYMBOLS, dimensions))
    v = _cache["letters", dimensions]
    if ("places", dimensions) not in _cache:
        _cache["places", dimensions] = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v
    a, b, c = _cache["places", dimensions]
    return a[grams // _SYMBOLS**2] * b[grams // _SYMBOLS % _SYMBOLS] * c[grams % _SYMBOLS]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language of one partition's texts, sent on whenever 12 languages are in hand."""

    def out():
        for lang, n in held.items():
            g = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n[g].astype(np.int64))], ["lang", "gram", "n"])
        held.clear()

    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            if lang not in held and len(held) >= 12:
                yield from out()
            if lang not in held:
                held[lang] = np.zeros(_GRAMS, np.int32)
            g = trigrams(text)
            if len(g) > 200_000:
                held[lang] += np.bincount(g, minlength=_GRAMS).astype(np.int32)
            else:
                np.add.at(held[lang], g, 1)
    yield from out()


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a unit vector for each, bundled from all rows (lang, text) without nulls.

    The counts of all texts are summed in Spark; the rows that reach one task or the driver are bounded by the trigram
    alphabet and the number of languages.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(dimensions)
        for i in range(0, len(pdf), 4096):
            part = pdf.iloc[i : i + 4096]
            v += np.sqrt(part.n.to_numpy()) @ gram_vectors(part.gram.to_numpy(), dimensions).astype(np.float32)
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "v": [v]})

    with small_batches(labelled.sparkSession):
        rows = counts.groupBy("lang").applyInPandas(bundle, "lang string, v array<double>").collect()  # one per language
    found = sorted((r.lang, r.v) for r in rows)
    langs = [x for x, _ in found]
    p = np.array([v for _, v in found]).reshape(len(langs), dimensions)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        p -= p.mean(axis=0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return langs, p


def compare(texts: list[str | None], langs: list[str], p: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Per text the language of the nearest prototype and the cosine, 0 where it is negative."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not langs:
        return names, scores
    for at in range(0, len(texts), 256):
        grams = [trigrams(x) if x else np.zeros(0, np.int32) for x in texts[at : at + 256]]
        has = [i for i, g in enumerate(grams) if len(g) and (g > 0).any()]
        if not has:
            continue
        every = np.concatenate([grams[i] for i in has])
        seen = np.flatnonzero(np.bincount(every, minlength=_GRAMS))
        place = _cache.setdefault("place", np.zeros(_GRAMS, np.int32))
        place[seen] = np.arange(len(seen))
        doc = np.repeat(np.arange(len(has)), [len(grams[i]) for i in has])
        n = np.bincount(doc * len(seen) + place[every], minlength=len(has) * len(seen)).reshape(len(has), len(seen))
        h = np.sqrt(n).astype(np.float32) @ gram_vectors(seen, p.shape[1]).astype(np.float32)
        cos = (h @ p.T.astype(np.float32)) / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
        best = cos.argmax(axis=1)
        for k, i in enumerate(has):
            names[at + i], scores[at + i] = langs[best[k]], min(1.0, max(0.0, float(cos[k, best[k]])))
    return names, scores


_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, text: str = "text", out: str = "language") -> DataFrame:
    """All rows of docs with a column `out`: (lang, score).

    Null texts and texts without a letter are `und` with score 0, as are all texts if nothing was learned. Whole texts
    count, however long. Equal texts get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast((langs, p))

    def predicted(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for at in range(0, len(texts), 256):
            some = compare(texts.slice(at, 256).to_pylist(), *sent.value)
            names += some[0]
            scores += some[1].tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    predicted.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.withColumn(out, F.arrow_udf(predicted, kind).asNondeterministic()(F.col(text)))


def held_out(key: str = "doc_id"):
    """Whether a row is not learned from: crc32 of the id as text mod 5 is 0; so are rows without id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    langs, p = prototypes(docs.where(~held_out()).select("lang", "text"))
    return identify(docs.drop("lang"), langs, p).select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
