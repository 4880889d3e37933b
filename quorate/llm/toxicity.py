"""Toxicity of texts whose words may be disguised: a noisy channel restores them, then restored words are scored.

A character trigram model is counted over all texts. A word with a letter's stand-in, with marks inside or with equal
letters side by side, and single characters with separators between, are lattices: each character stands for itself, for
the letters it can replace, or for nothing. The Viterbi path with the best sum of channel and language model is the
restored word, and channel and model decide whether anything changes. A logistic regression over words and word beginnings
of restored texts, fitted on a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.common import Workspace, small_batches
from quorate.llm.language_id import _SYMBOLS, _counted, _table, held_out

#: Labelled rows that the classifier is fitted on at most, but for chance.
MOST_LABELLED = 20_000
#: A feature is in so many toxic texts at least, and its share of them so many times its share of others.
LEAST_TOXIC, LEAST_LIFT = 3, 3.0
RIDGE = 0.05
PREFIXES = (3, 4, 5, 6)
#: Up to so many words with a feature are told apart.
MOST_LEVEL = 3
#: What a character can stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "%": "x", "&": "e",
}
#: Channel log probabilities: a letter as itself, a stand-in, one of two and one of more equal letters (or an equal stand-in) that
#: stands for nothing, a mark that does, any other stand-in that does.
AS_IS, STAND_IN, DOUBLED, REPEATED, MARK, DROPPED = 0.0, -1.0, -4.0, -0.5, -0.3, -14.0
MEMORY = 500_000

#: Three or more single characters with separators between, of any kind and number.
_SPACED = re.compile(r"(?<!\S)[\w@$!|+(€](?:[\s.\-_*]+[\w@$!|+(€]){2,}(?![^\s.,;:!?])")
_SEPARATORS = re.compile(r"[\s.\-_*]+")
_EDGE = "\"'.,;:?#*%&|()[]{}<>~`^=/\\!-_"
_EQUAL = re.compile(r"(.)\1")
_OTHER_STANDS = re.compile("[" + re.escape("".join(x for x in STANDS_FOR if not x.isdigit())) + "]")
_kept: dict = {}


class Model:
    """Log probabilities of a symbol after two others, interpolated with shorter contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        n = np.zeros(_SYMBOLS**3, np.float32)
        n[grams] = counts
        n = n.reshape((_SYMBOLS,) * 3)
        one = n.sum(axis=(0, 1)) + 0.1
        one /= one.sum()
        two = n.sum(axis=0)
        two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
        for a in range(_SYMBOLS):
            n[a] = (n[a] + 5 * two) / (n[a].sum(axis=1, keepdims=True) + 5)
        self.logs = np.log(n, out=n)

    def flat(self) -> memoryview:
        """The logs as one row of numbers: after a and b, c is at (a * 128 + b) * 128 + c."""
        return memoryview(self.logs).cast("B").cast("f")

    def __call__(self, a: int, b: int, c: int) -> float:
        return float(self.logs[a, b, c])


def options(word: str, i: int) -> list[tuple[str, float]]:
    """What character i of a lower-case word can stand for, with channel log probabilities."""
    c = word[i]
    if c.isalpha():
        if word[i - 1 : i] != c:
            return [(c, AS_IS)]
        return [(c, AS_IS), ("", REPEATED if word[i + 1 : i + 2] == c or word[max(0, i - 2) : i] == c + c else DOUBLED)]
    found = [(x, STAND_IN) for x in STANDS_FOR.get(c, "")]
    return [*found, ("", MARK if not found else REPEATED if word[i - 1 : i] == c else DROPPED)]


def restore(word: str, model: Model) -> str:
    """The best path through a disguised word's lattice; of equal paths the one that was found first, options in their order."""
    table, logs = _table(), model.flat()
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last two symbols
    for i in range(len(word)):
        after: dict[int, tuple[float, tuple | None]] = {}
        for text, cost in options(word, i):
            if text:
                symbol = int(table[ord(text)])
                for pair, (score, back) in states.items():
                    total, key = score + cost + logs[pair * _SYMBOLS + symbol], pair % _SYMBOLS * _SYMBOLS + symbol
                    if key not in after or total > after[key][0]:
                        after[key] = (total, (back, text))
            else:
                for key, (score, back) in states.items():
                    if key not in after or score + cost > after[key][0]:
                        after[key] = (score + cost, back)
        states = after
    _, back = max(((score + logs[pair * _SYMBOLS], back) for pair, (score, back) in states.items()), key=lambda x: x[0])
    out = []
    while back is not None:
        back, text = back
        out.append(text)
    return "".join(reversed(out))


def disguised(word: str) -> bool:
    """Whether a lower-case word without marks at its ends can be another: letters with equal ones side by side, or a stand-in or mark among letters."""
    if word.isalpha():
        return bool(_EQUAL.search(word))
    return any(c.isalpha() for c in word) or bool(_OTHER_STANDS.search(word))


def bare(word: str) -> str:
    """The word without marks at its ends that stand for no letter."""
    return word.lstrip(_EDGE.replace("!", "").replace("|", "")).rstrip(_EDGE)


def read_word(word: str, model: Model) -> list[str]:
    """The words that a lower-case token stands for: itself without marks, and its restored form if it looks disguised."""
    plain = word.strip(_EDGE)
    if plain.isalpha() and not _EQUAL.search(plain) and not _OTHER_STANDS.search(word[:1]):
        return [plain]
    found = [plain] if plain else []
    x = bare(word)
    return [*found, restore(x, model)] if x and disguised(x) else found


def restore_text(text: str, model: Model) -> str:
    """The whole text, lower-cased, with spaced words joined and disguised words restored; other white space stays."""

    def joined(m: re.Match) -> str:
        return restore(_SEPARATORS.sub("", m[0]), model)

    def word(m: re.Match) -> str:
        x = bare(m[0])
        return m[0].replace(x, restore(x, model), 1) if x and disguised(x) else m[0]

    return re.sub(r"\S+", word, _SPACED.sub(joined, text.lower()))


def features(word: str) -> list[str]:
    return ["=" + word, *["^" + word[:k] for k in PREFIXES if len(word) > k]] if word else []


def levels(counts: Counter) -> Iterator[str]:
    """A text's features: those of its distinct words, and again with the number before them where 2 or 3 words or more have one."""
    for f, n in counts.items():
        yield f
        for k in range(2, min(n, MOST_LEVEL) + 1):
            yield f"{k}{f}"


class Reader:
    """Counts in how many distinct words of a text each feature is, of all features or of those with a number; remembers words."""

    def __init__(self, model: Model, number: dict[str, int] | None):
        self.model, self.number, self.held = model, number, {}

    def of_word(self, word: str) -> tuple:
        if word not in self.held:
            if len(self.held) > MEMORY:
                self.held.clear()
            found = {f for w in read_word(word, self.model) for f in features(w)}
            self.held[word] = tuple(found) if self.number is None else tuple(self.number[f] for f in found if f in self.number)
        return self.held[word]

    def of_text(self, text: str | None) -> Counter:
        if not text:
            return Counter()
        text = text.lower()
        words = set(text.split())
        for m in _SPACED.finditer(text):
            whole = _SEPARATORS.sub("", m[0])
            words |= {whole, whole[1:], whole[:-1], whole[1:-1]}  # the first and the last may be words of one letter
        held, found = self.held, []
        for w in words:
            x = held.get(w)
            if x is None:
                x = self.of_word(w)
            if x:
                found += x
        return Counter(found)


def language_model(docs: DataFrame, text: str = "text") -> Model:
    """The character model of all texts; what reaches the driver is bounded by the alphabet's trigrams."""
    rows = docs.where(F.col(text).isNotNull()).select(F.lit("all").alias("lang"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    return Model(counts.gram.to_numpy(dtype=int), counts.n.to_numpy(dtype=float))


class Classifier:
    """Weights by feature, and an intercept."""

    def __init__(self, names: list[str], weights: np.ndarray, intercept: float):
        own = dict(zip(names, weights.tolist(), strict=True))
        self.number = {f: i for i, f in enumerate(sorted({f.lstrip("23456789") for f in names}))}
        self.sums = [np.cumsum([own.get(f, 0.0), *[own.get(f"{k}{f}", 0.0) for k in range(2, MOST_LEVEL + 1)]]).tolist() for f in self.number]  # by how many words have it
        self.intercept = intercept

    def score(self, counts: Counter) -> float:
        z = self.intercept + math.fsum(self.sums[f][min(n, MOST_LEVEL) - 1] for f, n in counts.items())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def surprise(n1: Column, n0: Column, all1: int, all0: int) -> Column:
    """G of the two by two table of texts with and without a feature, toxic and others; about a chi-square of one degree by chance."""
    n, whole = n1 + n0, all1 + all0
    part = lambda seen, rows, cols: F.when(seen > 0, seen * F.log(seen * whole / (rows * cols))).otherwise(0.0)
    none = F.lit(float(whole)) - n
    return 2 * (part(n1, n, all1) + part(n0, n, all0) + part(all1 - n1, none, all1) + part(all0 - n0, none, all0))


def weights(found: list, y: np.ndarray, d: int, ridge: float = RIDGE) -> np.ndarray:
    """d weights and an intercept of a ridge logistic regression by Newton's method, its steps by conjugate gradients; found: the features of each row."""
    row, col = np.repeat(np.arange(len(y)), [len(x) for x in found]), np.concatenate([np.zeros(0, int), *[np.asarray(x, int) for x in found]])
    times = lambda w: np.bincount(row, w[col], len(y)) + w[-1]
    back = lambda r: np.append(np.bincount(col, r[row], d), r.sum())
    loss = lambda w: np.logaddexp(0.0, (1 - 2 * y) * times(w)).sum() + (penalty * w * w).sum() / 2
    w = np.zeros(d + 1)
    w[-1] = np.log(y.sum() / (len(y) - y.sum()))
    penalty = np.append(np.full(d, ridge), ridge / 10)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        v = np.maximum(p * (1 - p), 1e-5)
        rest = back(y - p) - penalty * w
        step, way, size = np.zeros(d + 1), rest, rest @ rest
        for _ in range(200):
            if size < 1e-12:
                break
            bent = back(v * times(way)) + penalty * way
            far = size / (way @ bent)
            step, rest = step + far * way, rest - far * bent
            size, before = rest @ rest, size
            way = rest + size / before * way
        while np.abs(step).max() >= 1e-4 and loss(w + step) > loss(w):  # too far: the curvature is another there
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(labelled: DataFrame, model: Model) -> Classifier:
    """A classifier from rows (text, toxic), of which training_rows() gives a bounded number, chosen by a hash of the id.

    Every feature of every distinct text is counted. Those seen in LEAST_TOXIC toxic texts at least are candidates, and of these all
    are used whose share in toxic texts exceeds that in others LEAST_LIFT times and whose G is so large that among so many
    candidates about one would reach it by chance.
    """
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and toxic is not null").select("text", (F.col("toxic") > 0).cast("int").alias("y")).dropDuplicates()  # copies tell nothing more
    sent = spark.sparkContext.broadcast(model)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = Reader(sent.value, None), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[y].update(levels(reader.of_text(text.as_py())))
        for y in (0, 1):
            names = list(n[y])
            counts = [pa.array([n[y][f] for f in names], pa.int64()), pa.array(np.zeros(len(names), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts[:: 1 if y else -1]], ["f", "n1", "n0"])

    size = {r["y"]: r["c"] for r in rows.groupBy("y").agg(F.count("*").alias("c")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Classifier([], np.zeros(0), float(np.log(share / (1 - share))))
    counts = rows.mapInArrow(seen, "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = Workspace(spark, "toxicity").save(counts.where(F.col("n1") >= LEAST_TOXIC), "features")
    lift = (F.col("n1") + 0.5) * (n0 + 1) / ((F.col("n0") + 0.5) * (n1 + 1))
    told = counts.where((lift > LEAST_LIFT) & (surprise(F.col("n1").cast("double"), F.col("n0").cast("double"), n1, n0) > 2 * math.log(1 + counts.count())))
    names = sorted(r["f"] for r in told.select("f").collect())  # features of the bounded sample
    known = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    bases = spark.sparkContext.broadcast({f: f for f in (x.lstrip("23456789") for x in names)})

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, number = Reader(sent.value, bases.value), known.value
        for batch in batches:
            found = [sorted(number[f] for f in levels(reader.of_text(t.as_py())) if f in number) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["y", "found"])

    data = sorted((r["y"], list(r["found"])) for r in rows.mapInArrow(hits, "y int, found array<int>").collect())  # rows of the bounded sample, in whatever order they come
    w = weights([x for _, x in data], np.array([y for y, _ in data], float), len(names))
    return Classifier(names, w[:-1], float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, key: str = "doc_id") -> DataFrame:
    """(text, toxic) of labelled documents that may be learned from, about `most` at most, chosen by a hash of the id."""
    own = labels.where(~held_out(key)).where("toxic is not null").select(F.col(key).alias("__k"), "toxic")
    share = min(1.0, most / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("__k", F.lit(4)), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(key).alias("__d"), "text")  # docs may have a column of labels themselves
    return texts.join(F.broadcast(own), F.col("__d") == F.col("__k")).select("text", "toxic")  # about `most` rows


def score(docs: DataFrame, model: Model, classifier: Classifier, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All rows of docs with a column `out`: the score, 0 to 1. Whole texts count; null and empty texts get the score of no words.

    Equal texts get equal scores, and repeated rows one each. An empty table gives no rows; a column named `out` is replaced.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast((model, classifier)), uuid.uuid4().hex

    def scored(texts: pa.Array) -> pa.Array:
        model, classifier = sent.value
        if name not in _kept:
            _kept.clear()
            _kept[name] = Reader(model, classifier.number)
        reader = _kept[name]
        return pa.array([classifier.score(reader.of_text(t)) for t in texts.to_pylist()], pa.float64())

    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(scored, T.DoubleType()).asNondeterministic()(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = language_model(docs)
    found = score(docs, model, fit(training_rows(docs, labels), model))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
