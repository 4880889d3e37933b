"""Token ids in Arrow files of fixed-size-list batches.

Each file is an Arrow IPC file whose batches hold sequences of equal length: `ids`, a fixed-size list of unsigned 16-bit
numbers (32-bit for larger vocabularies), and `mask`, a fixed-size list of booleans that are false in the padding at a
file's end. All batches of a file but the last have the same number of sequences, so sequence k is row k % BATCH of batch
k // BATCH, and a memory map gives it without a copy. Files follow one another in document order; a manifest has a row
per file with its documents and their lengths.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.llm.common import Workspace, give_back

LENGTH, BATCH = 2048, 64
FILE_TOKENS, FILE_DOCS = 8_000_000, 200_000
END = 0
#: A range of documents that one task encodes, in bytes of text, and how many ranges there are at most: beyond, ranges grow
#: and a task writes more files.
RANGE_BYTES, MOST_RANGES = 24_000_000, 20_000
#: Bytes of encoded pieces that a worker remembers before it starts afresh, what an entry costs besides its own bytes, and the
#: longest piece that is remembered beyond its batch.
MEMORY, ENTRY, LONGEST = 80_000_000, 220, 64

#: So many bytes of text are encoded at once, unless a text is longer.
CHUNK = 2_000_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_kept: dict = {}


class Encoder:
    """Encodes texts exactly as the tokenizer does, remembering the ids of pieces between single spaces.

    A byte-level tokenizer with the usual split into words never joins what stands before a single space with what stands
    from it on, unless white space follows that space; so the ids of a text are those of its pieces, each with the space
    before it. Texts in which white space or the end follows a space go to the tokenizer whole, as do all texts of a
    tokenizer of another kind. Pieces are remembered up to MEMORY bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # a token's bytes; its letters stand for one each
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)
        parts = json.loads(self.tokenizer.to_str())
        split, added = parts["pre_tokenizer"] or {}, parts["added_tokens"]
        self.by_piece = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        self.by_piece &= not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in added)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces after a space, encoded as running text and cut where the tokens' bytes add up to the pieces' bytes."""
        runs = [" " + " ".join(pieces[at : at + 500]) for at in range(0, len(pieces), 500)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)), self.kind)
        at = np.concatenate(([0], np.cumsum(self.size[flat])))
        sizes = np.fromiter((len(p) if p.isascii() else len(p.encode("utf-8")) for p in pieces), np.int64, len(pieces)) + 1
        cuts = (np.searchsorted(at, np.concatenate(([0], np.cumsum(sizes)))) * self.kind().itemsize).tolist()
        data = flat.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, pieces: list[str]) -> list[str]:
        """Ids of pieces that a space precedes; returns those that are too long to be remembered.

        Marks after a letter are words of their own, so a piece that ends in marks is put together.
        """
        later, ended, plain = self.later, [], set()
        for p in pieces:
            if p in later:
                continue
            head = p.rstrip(_MARKS)
            if head != p and "A" <= head[-1:] < "\u2000" and head[-1].isalpha() and not self.special.search(p):
                ended.append((p, head, p[len(head) :]))
                p = head
            if p not in later:
                plain.add(p)
        plain = list(plain)
        later.update(zip(plain, self._ids_of_pieces(plain), strict=True))
        tails = list({t for _, _, t in ended if t not in self.tails})
        self.tails.update(zip(tails, self._ids(tails), strict=True))
        for p, head, tail in ended:
            later[p] = later[head] + self.tails[tail]
        new = [*plain, *(p for p, _, _ in ended)]
        self.held += sum(map(len, new)) * 2 + sum(map(len, tails)) * 2 + ENTRY * (len(new) + len(tails))
        return [p for p in new if len(p) > LONGEST]

    def forget(self) -> None:
        self.first.clear()
        self.later.clear()
        self.tails.clear()
        self.held = 0

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Per text the bytes of its ids in self.kind; texts without nulls.

        Distinct pieces are looked up once; their ids are gathered by the pieces' numbers.
        """
        if not self.by_piece:
            return self._ids(texts.to_pylist())
        if not len(texts):
            return []
        if self.held > MEMORY:
            self.forget()
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        firsts = pc.list_element(lists, 0).dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        words, starts = coded.dictionary.to_pylist(), firsts.dictionary.to_pylist()
        at[ends[:-1]] = len(words) + firsts.indices.to_numpy()  # the first piece of a text has no space before it
        bad = np.fromiter((not w or w[0].isspace() for w in words), bool, len(words))
        used = np.zeros(len(words) + len(starts), bool)
        used[at] = True
        known = [w if u and not b else "" for w, u, b in zip(words, used.tolist(), bad.tolist(), strict=False)]
        long = self._learn([w for w in known if w])
        new = [w for w in starts if w not in self.first]
        self.first.update(zip(new, self._ids(new), strict=True))
        self.held += sum(map(len, new)) * 2 + ENTRY * len(new)
        ids = [*map(self.later.get, known, repeat(b"")), *map(self.first.__getitem__, starts)]
        width = self.kind().itemsize
        pool, sizes = np.frombuffer(b"".join(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)) // width
        first = np.cumsum(sizes) - sizes
        n = sizes[at]
        upto = np.cumsum(n)
        data = pool[np.arange(upto[-1]) + np.repeat(first[at] - upto + n, n)].tobytes()
        cuts = (np.concatenate(([0], upto))[ends] * width).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        places = np.flatnonzero(np.concatenate((bad, np.zeros(len(starts), bool)))[at])
        whole = np.unique(np.searchsorted(ends, places, "right") - 1).tolist()
        for i, x in zip(whole, self._ids([texts[i].as_py() for i in whole]), strict=True):
            out[i] = x
        for held, names in ((self.later, long), (self.first, [w for w in new if len(w) > LONGEST])):
            for w in names:
                self.held -= 2 * len(w) + ENTRY
                del held[w]
        return out


def encoder(path: str) -> Encoder:
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


class _File:
    """One file while it is written."""

    def __init__(self, folder: str, name: str, kind, length: int):
        filesystem, path = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(path, recursive=True)
        self.name, self.kind, self.length = name, kind, length
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = filesystem.open_output_stream(f"{path}/{name}")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.bytes = self.tokens = self.sequences = 0
        self.docs: list = []
        self.lengths: list[int] = []

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // self.kind().itemsize
        self.held.append(ids)
        self.bytes += len(ids)
        self.tokens += n
        self.docs.append(doc)
        self.lengths.append(n)
        if self.bytes >= self.length * BATCH * self.kind().itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.kind)
        step = self.length * BATCH
        end = len(flat) if last else len(flat) // step * step
        for at in range(0, end, step):
            ids = flat[at : min(at + step, end)]
            n = -(-len(ids) // self.length)
            full, mask = np.full(n * self.length, END, self.kind), np.zeros(n * self.length, bool)
            full[: len(ids)], mask[: len(ids)] = ids, True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.sequences += n
        self.held = [flat[end:].tobytes()]
        self.bytes = len(self.held[0])

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Batches of (key, text) put together or cut, so that each has about `size` bytes of text; a longer text is one by itself."""
    held, n = [], 0
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) + n
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(upto, size, "right")), at if held else at + 1)
            if end > at:
                held.append(batch.slice(at, end - at))
            if end < batch.num_rows:
                yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))
                held, upto = [], upto - (upto[end - 1] if end else n)
            at = end
        n = int(upto[-1]) if batch.num_rows else n
    if held:
        yield tuple(pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1))


MANIFEST = "part int, k int, file string, n_sequences long, n_tokens long, docs array<long>, lengths array<long>"


def write(docs: DataFrame, ws: Workspace, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Encodes all rows in ascending order of key (null first; ties by the text's hash) and writes the files; returns the manifest.

    Every text is encoded whole and END follows it; null and empty texts give END alone. Rows are dealt to tasks by range
    of key, each task writes files of its own, and a file begins a new sequence. A task that is run again writes new
    files; the manifest names those of the run that Spark committed. An empty table gives an empty manifest. Of extra
    columns nothing is read.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    folder = f"{ws.path}/files"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file, k = encoder(tokenizer), None, 0
        end = np.array([END], enc.kind).tobytes()
        part = TaskContext.get().partitionId()

        def row():
            file.close()
            values = [[part], [k], [file.name], [file.sequences], [file.tokens], [file.docs], [file.lengths]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

        for keys, texts in chunks(batches):
            for doc, ids in zip(keys.to_pylist(), enc.encode(texts), strict=True):
                if file is None:
                    file = _File(folder, f"{part:06d}-{k:06d}-{uuid.uuid4().hex[:8]}.arrow", enc.kind, length)
                file.add(doc, ids + end)
                if file.tokens >= FILE_TOKENS or len(file.docs) >= FILE_DOCS:
                    yield row()
                    file, k = None, k + 1
        if file is not None:
            yield row()
        file = None
        enc.forget()  # the worker lives on
        give_back()

    ranges = min(MOST_RANGES, max(1, -(-total // RANGE_BYTES)))
    ordered = rows.repartitionByRange(ranges, F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"))
    manifest = ws.save(ordered.mapInArrow(written, MANIFEST), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


def open_file(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """A file's reader: by a memory map where the folder is local, so that what is read of it is not copied."""
    filesystem, path = fs.FileSystem.from_uri(folder)
    local = isinstance(filesystem, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(f"{path}/{name}") if local else filesystem.open_input_file(f"{path}/{name}"))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.Array]:
    """Sequence k of a file: its ids as a view of the file, and its mask."""
    batch = reader.get_batch(k // BATCH)
    ids, mask = batch.column("ids"), batch.column("mask")
    n, row = ids.type.list_size, k % BATCH
    return ids.values.to_numpy(zero_copy_only=True)[row * n : (row + 1) * n], mask.values.slice(row * n, n)


def read(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the number of ids by range of documents is ordered in one task.
    """
    by_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.unboundedPreceding
    base = by_part.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(earlier, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("k").rowsBetween(earlier, -1)), F.lit(0))
    placed = manifest.withColumn("inner", inner).join(base, F.col("part") == F.col("p")).select("folder", "file", "docs", "lengths", (F.col("base") + F.col("inner")).alias("start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader, docs, starts, crcs = open_file(r["folder"], r["file"]), r["docs"], [], []
                flat, b, start = np.zeros(0, np.uint32), 0, r["start"]
                for n in r["lengths"]:
                    parts, need, crc = [], n, 0
                    while need:
                        if not len(flat):
                            flat, b = reader.get_batch(b).column("ids").values.to_numpy(zero_copy_only=True), b + 1
                        parts, flat = flat[:need], flat[need:]
                        crc, need = zlib.crc32(parts.astype("<u4").tobytes(), crc), need - len(parts)
                    starts.append(start)
                    crcs.append(crc)
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(F.col("file")).mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, Workspace(spark, "op5"), default_tokenizer()))
