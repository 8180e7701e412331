"""Token ids as directly addressable codes (operator 10).

An id is split into chunks from the lowest bits up.  Level 0 has one chunk of every
id and a continuation bit; level 1 has the next chunk of those whose bit is set, and
so on.  A rank directory (set bits before each block of 512) finds an id's place on
the next level, so any id is read without decoding others.

File: magic, header, document table, then for each level chunks, bitmap, directory.
Files are written in ascending ``doc_id`` order (nulls first; rows of one id by their text's hash),
each through a name of its own and then renamed, so that a repeated task leaves whole files only; a manifest
of the files that count is written by Spark.

Nulls: a null text is the empty text; a null ``doc_id`` is written as null.  Empty
texts have the end id only; very long texts fill a file of their own; repeated rows
are written each; an empty table gives no files and no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import bounded_batches, shared_dir, slices, texts_of
from .tok import encoder, forget

MAGIC = b"DACIDS01"
WIDTHS = (8, 8, 8, 8)
BLOCK = 512
#: Ids after which a file is closed (whole documents); bounds what a task holds.
FILE_TOKENS = 1_500_000
_HEADER = struct.Struct("<8sqqqqq")  # magic, group, number in group, documents, ids, levels


def encode_levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks (a byte each), packed continuation bits and directory of every level."""
    out, rest = [], ids.astype(np.uint64)
    for width in widths:
        chunk = (rest & np.uint64((1 << width) - 1)).astype(np.uint8)
        rest = rest >> np.uint64(width)
        more = rest > 0
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
        padded[: len(more)] = more
        ones = padded.reshape(-1, BLOCK).sum(1)
        out.append((chunk, np.packbits(padded, bitorder="little"), (np.cumsum(ones) - ones).astype(np.uint32)))
        rest = rest[more]
        if not len(rest):
            break
    return out


class Codes:
    """Ids in the levels' arrays; any of them can be read alone."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], widths: tuple[int, ...] = WIDTHS):
        self.levels, self.widths = levels, widths

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before ``at``."""
        _, bits, directory = self.levels[level]
        block = at // BLOCK
        inside = bits.reshape(-1, BLOCK // 8)[block]
        ahead = np.arange(BLOCK // 8) < ((at % BLOCK) // 8)[:, None]
        whole = (_ONES[inside] * ahead).sum(1)
        last = bits[at // 8] & ((1 << (at % 8)) - 1).astype(np.uint8)
        return directory[block].astype(np.int64) + whole + _ONES[last]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        places = np.asarray(places, np.int64)
        out, own, shift = np.zeros(len(places), np.uint64), np.arange(len(places)), 0
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[own] |= chunk[places].astype(np.uint64) << np.uint64(shift)
            more = (bits[places // 8] >> (places % 8).astype(np.uint8)) & 1 == 1
            shift += self.widths[k]
            own, places = own[more], places[more]
            if not len(own):
                break
            places = self._rank(k, places)
        return out.astype(np.uint32)

    def between(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: a rank at the first place of each level, nothing else is decoded."""
        out, own, shift = np.zeros(max(stop - start, 0), np.uint32), None, 0
        for k, (chunk, bits, _) in enumerate(self.levels):
            if stop <= start:
                break
            value = chunk[start:stop].astype(np.uint32) << np.uint32(shift)
            if own is None:
                out |= value
            else:
                out[own] |= value
            low = start // 8
            more = np.flatnonzero(np.unpackbits(bits[low : (stop + 7) // 8], bitorder="little")[start - 8 * low : stop - 8 * low])
            if not len(more):
                break
            own = more if own is None else own[more]
            shift += self.widths[k]
            start = int(self._rank(k, np.array([start]))[0])
            stop = start + len(more)
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        if not self.levels:
            return np.zeros(0, np.uint32)
        out, own, shift = np.zeros(len(self), np.uint32), None, 0
        for k, (chunk, bits, _) in enumerate(self.levels):
            value = chunk.astype(np.uint32) << np.uint32(shift)
            if own is None:
                out |= value
            else:
                out[own] |= value
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunk), bitorder="little"))
            own = more if own is None else own[more]
            shift += self.widths[k]
        return out


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, group: int = 0, number: int = 0) -> bytes:
    levels = encode_levels(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [_HEADER.pack(MAGIC, group, number, len(counts), len(ids), len(levels)), known.tobytes(), names.tobytes(), counts.astype("<i8").tobytes()]
    for chunk, bits, directory in levels:
        parts += [struct.pack("<q", len(chunk)), chunk.tobytes(), bits.tobytes(), directory.astype("<u4").tobytes()]
    return b"".join(parts)


class File:
    """A file's content; ``codes`` gives random access."""

    def __init__(self, raw: bytes):
        magic, self.group, self.number, n, self.n_ids, levels = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = _HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        known, names, self.counts = take("u1", n), take("<i8", n), take("<i8", n)
        self.doc_ids = pa.array(names, pa.int64(), mask=known == 0)
        self.starts = np.cumsum(self.counts) - self.counts
        found = []
        for _ in range(levels):
            size = int(take("<i8", 1)[0])
            blocks = -(-size // BLOCK)
            found.append((take("u1", size), take("u1", blocks * BLOCK // 8), take("<u4", blocks)))
        self.codes = Codes(found)

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document, read alone."""
        return self.codes.between(int(self.starts[k]), int(self.starts[k] + self.counts[k]))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files below ``path`` (a URI every executor can write to); the manifest.

    The manifest has a row per file that counts: group, number, n_docs, n_tokens, name.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the text's hash splits rows of one id, or of none, between ranges
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, group, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, root = fs.FileSystem.from_uri(path)
        ids, counts, names = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal ids, counts, names, number
            all_ids, sizes = np.concatenate(ids), np.concatenate(counts)
            raw = to_bytes(names, sizes, all_ids, group, number)
            name = f"ids-{group:06d}-{number:05d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{root}/_{name}") as out:
                out.write(raw)
            store.move(f"{root}/_{name}", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int64()), "number": pa.array([number], pa.int64()), "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([len(all_ids)], pa.int64()), "name": pa.array([name])})
            ids, counts, names, number = [], [], [], number + 1
            return row

        held = 0
        for batch in slices(batches, "text"):
            raw, sizes = enc.encode(texts_of(batch, "text"))
            ids.append(np.insert(raw, np.cumsum(sizes), end_id).astype(np.uint32))
            counts.append(sizes + 1)
            names += batch.column(0).to_pylist()
            held += len(ids[-1])
            if held >= file_tokens:
                yield flush()
                held = 0
        if counts:
            yield flush()

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    manifest = rows.mapInArrow(run, "group long, number long, n_docs long, n_tokens long, name string")
    manifest.write.parquet(f"{path}/_manifest")
    return spark.read.parquet(f"{path}/_manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """Each file's ``first``: the ids in all files before it.

    Two steps: over the groups (as many as partitions), then within each.
    """
    per_group = manifest.groupBy("group").agg(F.sum("n_tokens").alias("n"))
    before = per_group.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("group").orderBy("number")) - F.col("n_tokens")
    return manifest.withColumn("inside", inside).join(before, "group").select("group", "number", "name", (F.col("before") + F.col("inside")).alias("first"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, file and place in it."""
    manifest = spark.read.parquet(f"{path}/_manifest")
    names = starts(manifest)
    files = spark.read.format("binaryFile").load(f"{path}/ids-*.dac").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = File(raw.as_buffer())
                crc = [zlib.crc32(file.document(k).astype("<u4")) for k in range(len(file.counts))]
                out = pa.RecordBatch.from_pydict({
                    "name": pa.array([name] * len(crc), pa.string()),
                    "doc_id": file.doc_ids,
                    "place": pa.array(file.starts, pa.int64()),
                    "n_tokens": pa.array(file.counts, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })
                for k in range(0, out.num_rows, 5000):
                    yield out.slice(k, 5000)

    rows = files.mapInArrow(run, "name string, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(names, "name").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "name", "place")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents and describe them from the files read back."""
    path = shared_dir(docs.sparkSession, "dac")
    manifest = write(docs, path, tokenizer, end_id)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, name string, place long")
    return read(docs.sparkSession, path)
