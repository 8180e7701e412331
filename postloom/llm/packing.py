"""Packing by minimum bin slack (operator 9).

A document's ids are cut into full windows and one remainder.  Per block of
documents (whole documents, bounded by tokens, within one partition; nothing is
shuffled) the remainders become a multiset of lengths.  For each window the longest
remainder is the seed; a bitset subset-sum over the multiset finds the lengths that
fill the rest closest to the capacity, and backtracking gives the counts.  The pattern
is used as often as the counts allow.  Where the best filling leaves slack while
remainders are left, the next one is cut to close it.  What is left at the end of a
block is laid into sequences whose lengths are powers of two, which need no padding.

Nulls: a null text is empty; a null ``doc_id`` is kept.  An empty document is its end
id.  Very long documents: a window each; repeated rows are packed each; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .base import bounded_batches, slices, texts_of
from .tok import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_filling(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of at most ``room`` from the multiset, and how often it takes each length.

    Lengths are taken from the longest down; ``reach[i]`` has a bit for each sum of the
    first i lengths.
    """
    full, bits = (1 << (room + 1)) - 1, 1
    lengths, reach = [], [1]
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, k = min(counts[n], room // n), 1
        while left:
            k = min(k, left)
            bits |= (bits << (n * k)) & full
            left -= k
            k *= 2
        lengths.append(n)
        reach.append(bits)
        if bits >> room & 1:
            break
    best = rest = bits.bit_length() - 1
    taken: dict[int, int] = {}
    for i in range(len(lengths), 0, -1):
        while not reach[i - 1] >> rest & 1:
            taken[lengths[i - 1]] = taken.get(lengths[i - 1], 0) + 1
            rest -= lengths[i - 1]
    return best, taken


class Bins:
    """Remainders by length; ``pack`` turns them into windows of (document, start, length)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.of: dict[int, list[tuple[int, int]]] = {}

    def add(self, doc: int, start: int, length: int) -> None:
        self.of.setdefault(length, []).append((doc, start))

    def _take(self, length: int) -> tuple[int, int, int]:
        rows = self.of[length]
        doc, start = rows.pop()
        if not rows:
            del self.of[length]
        return doc, start, length

    def pack(self) -> Iterator[list[tuple[int, int, int]]]:
        while self.of:
            counts = {n: len(v) for n, v in self.of.items()}
            seed = max(counts)
            counts[seed] -= 1
            best, pattern = best_filling({n: c for n, c in counts.items() if c}, self.capacity - seed)
            pattern[seed] = pattern.get(seed, 0) + 1
            slack = self.capacity - seed - best
            if not slack:
                for _ in range(min(len(self.of[n]) // k for n, k in pattern.items())):
                    yield [self._take(n) for n, k in pattern.items() for _ in range(k)]
                continue
            window = [self._take(n) for n, k in pattern.items() for _ in range(k)]
            if not self.of:  # the rest of the block: sequences of powers of two
                yield from self._powers(window)
                return
            doc, start, length = self._take(min(n for n in self.of if n > slack))
            window.append((doc, start, slack))
            self.add(doc, start + slack, length - slack)
            yield window

    @staticmethod
    def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        total, queue = sum(p[2] for p in pieces), pieces[::-1]
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            sequence = []
            while size:
                doc, start, length = queue.pop()
                take = min(size, length)
                sequence.append((doc, start, take))
                if take < length:
                    queue.append((doc, start + take, length - take))
                size -= take
            yield sequence


def pack_block(counts: np.ndarray, capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences over documents of the given lengths: lists of (document, start, length)."""
    bins = Bins(capacity)
    for doc, n in enumerate(counts.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            yield [(doc, start, capacity)]
        if n % capacity:
            bins.add(doc, n - n % capacity, n % capacity)
    yield from bins.pack()


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, block_tokens: int = 6_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as ``input_ids``.

    ``sequence_id`` is the partition's number times 2**32 plus a count, hence unique.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 32
        ids, counts, names = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, ids, counts, names
            all_ids, sizes = np.concatenate(ids), np.concatenate(counts)
            doc_ids = pa.concat_arrays(names)
            ids, counts, names = [], [], []
            first = np.cumsum(sizes) - sizes
            raw = memoryview(all_ids.astype("<u4", copy=False)).cast("B")
            doc, start, length, crc, seq, offset = [], [], [], [], [], []
            for pieces in pack_block(sizes, capacity):
                at = 0
                for d, s, n in pieces:
                    b = int(first[d] + s) * 4
                    doc.append(d)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[b : b + 4 * n]))
                    seq.append(sequence)
                    offset.append(at)
                    at += n
                sequence += 1
            out = {
                "doc_id": doc_ids.take(pa.array(doc, pa.int64())),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(sizes[doc], pa.int64()),
                "sequence_id": pa.array(seq, pa.int64()),
                "offset": pa.array(offset, pa.int64()),
            }
            if with_ids:
                values = np.concatenate([all_ids[a : a + n] for a, n in zip((first[doc] + start).tolist(), length)]).view(np.int32)
                out["input_ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(values))
            batch = pa.RecordBatch.from_pydict(out)
            for k in range(0, batch.num_rows, 5000):
                yield batch.slice(k, 5000)

        held = 0
        for batch in slices(batches, "text"):
            raw, sizes = enc.encode(texts_of(batch, "text"))
            ends = np.cumsum(sizes)
            ids.append(np.insert(raw, ends, end_id).astype(np.uint32))
            counts.append(sizes + 1)
            names.append(batch.column(0).cast(pa.int64()))
            held += len(ids[-1])
            if held >= block_tokens:
                yield from flush()
                held = 0
        if counts:
            yield from flush()

    return rows.mapInArrow(run, SCHEMA + (", input_ids array<int>" if with_ids else ""))
