"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, scanning each text once.

Texts are normalised to words: A-Z lower-cased, a word being a run of 0-9, a-z and anything beyond ASCII. A window is
`window` consecutive words of an item; an item with fewer words, but not none, is one window. The automaton's letters are
word numbers of the items' vocabulary, so that a match is a run of whole words; its ends give the words hit, and for texts
with hits the words' places give offsets in the original text.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quorate.llm.common import fresh

WINDOW = 10
#: So many words of items at most go into one automaton and one broadcast; more items make more automata.
MOST_WORDS = 2_000_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_HITS = {kind: pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(t))]) for kind, t in (("long", pa.int64()), ("string", pa.string()))}
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_built: dict = {}


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def automaton(items: list[tuple], window: int):
    """(word numbers, automaton); the automaton's values are (length, ids of the items that have the window)."""
    number: dict[bytes, int] = {}
    owners: dict[tuple, set] = {}
    for item, text in items:
        w = [number.setdefault(x, len(number) + 1) for x in words(text)]
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + window]), set()).add(item)
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in owners.items():
        a.add_word(key, (len(key), ids))
    if owners:
        a.make_automaton()
    return number, a if owners else None


def scan_text(text: str | None, number: dict, a) -> dict:
    """Words, numbers of the hit words, and items with occurring windows."""
    w = words(text) if text else []
    hit: set[int] = set()
    items: set = set()
    if a is not None and w:
        for end, (length, ids) in a.iter(tuple(map(number.get, w, repeat(0)))):
            hit.update(range(end - length + 1, end + 1))
            items |= ids
    return {"n_words": len(w), "hit": sorted(hit), "items": sorted(x for x in items if x is not None)}


def spans(text: str | None, hit: list[int] | None) -> list[dict]:
    """Offsets in the original text of the runs of hit words, whose numbers are in order."""
    found: list[dict] = []
    if hit:
        places = [m.span() for m in _WORD.finditer(text)]
        for k, i in enumerate(hit):
            if k and hit[k - 1] == i - 1:
                found[-1]["end"] = places[i][1]
            else:
                found.append({"start": places[i][0], "end": places[i][1]})
    return found


def id_kind(items: DataFrame, key: str) -> str:
    return "long" if dict(items.select(key).dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else "string"


def item_blocks(items: DataFrame, key: str, text: str, most_words: int) -> list[list[tuple]]:
    """The items in blocks whose words are bounded; they come to the driver one partition at a time. Ids are longs, or strings where they aren't whole numbers."""
    blocks, n = [[]], 0
    for item, x in items.where(F.col(text).isNotNull()).select(F.col(key).cast(id_kind(items, key)), text).toLocalIterator():
        size = len(words(x))
        if n and n + size > most_words:
            blocks.append([])
            n = 0
        blocks[-1].append((item, x))
        n += size
    return blocks


def _hits_udf(sent, this: str, k: int, kind: str):
    """The function of a text column that scans with automaton k of one scan."""

    def hits(texts: pa.Array) -> pa.Array:
        if (this, k) not in _built:
            for old in [x for x in _built if x[0] != this]:
                del _built[old]
            _built[this, k] = automaton(*sent.value)
        number, a = _built[this, k]
        return pa.array([scan_text(x.as_py(), number, a) for x in texts], _HITS[kind])

    hits.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(hits, from_arrow_type(_HITS[kind])).asNondeterministic()


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, most_words: int = MOST_WORDS, out: str = "scan") -> DataFrame:
    """All rows of docs with a column `out`: n_words, hit (numbers of the hit words), items, spans (character offsets).

    Null and empty texts have no words and no hits. Null item texts and items without words have no windows; items that
    share an id count as one item; an item without id makes hits but is not listed; ids that aren't whole numbers are strings. Items up to MOST_WORDS words are one
    automaton; more are several, each scanned in turn, whose hits and items are united before spans are made of them. A
    worker holds all automata of a scan. Repeated rows are scanned each; a column of docs named like `out` is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    blocks = item_blocks(items, item_key, item_text, most_words)
    names = [fresh("scan")[0] for _ in blocks]
    this = uuid.uuid4().hex
    found = docs
    for k, (block, column) in enumerate(zip(blocks, names, strict=True)):
        found = found.withColumn(column, _hits_udf(spark.sparkContext.broadcast((block, window)), this, k, id_kind(items, item_key))(F.col(text)))

    def placed(texts: pa.Array, hit: pa.Array) -> pa.Array:
        return pa.array([spans(x.as_py() if len(h) else None, h) for x, h in zip(texts, hit.to_pylist(), strict=True)], _SPANS)

    placed.__annotations__ = {"texts": pa.Array, "hit": pa.Array, "return": pa.Array}
    parts = [F.col(c) for c in names]
    both = lambda c: parts[0][c] if len(parts) == 1 else F.array_sort(F.array_distinct(F.concat(*[p[c] for p in parts])))
    at = F.arrow_udf(placed, from_arrow_type(_SPANS))(F.col(text), both("hit"))
    return found.select(*[F.col(c) for c in docs.columns], F.struct(parts[0]["n_words"].alias("n_words"), both("hit").alias("hit"), both("items").alias("items"), at.alias("spans")).alias(out))


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no window of an item occurs."""
    (own,) = fresh("scan")
    return scan(docs, items, out=own, **options).where(F.size(f"{own}.hit") == 0).select(*[F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("scan.items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), F.size("scan.hit").cast("long").alias("n_hit"), F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size("scan.hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS p FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.r, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
nh AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hits) GROUP BY r),
ni AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(nh.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(ni.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ni.names, '')) AS items_sha256, coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh ON d.r = nh.r LEFT JOIN ni ON d.r = ni.r
"""
