"""Benchmark decontamination by latent semantic retrieval (operator 6).

Passages are windows of 48 words, 16 apart, as TF-IDF vectors over hashed terms; items of
up to 32 words are compared with windows of 16 and 32 words too, as the text around them
would drown them in longer ones.  The document frequencies are those of all documents.  A randomised subspace iteration finds
the leading right singular vectors of the TF-IDF matrix of all items; from these, one more
step over the passages of all documents and items gives those of the whole matrix: a pass sends a sum
``A.T @ (A @ Z)`` per task.  Every passage of every document is then folded into the
latent space and compared with all items, in blocks of items.  Passages above the cosine
bound are checked on their words: the longest common subsequence with the item, and with
the item's answer (its last sentence).  Paraphrases keep most words in order.

The items are the stated query set: they are read in blocks of ``ITEM_BLOCK``, a pass
over the documents each.

Nulls: null texts are empty; a null ``doc_id`` or ``item_id`` is kept in the pairs.
Empty texts and items never match.  Very long texts are read whole.  Repeated rows give
a pair each; ties go to the earlier passage.  Empty tables give no rows.  Extra columns
are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, materialise, slices, texts_of, trim
from .shingles import words

STEP, SPAN = 16, 3  # a window is three steps
#: Items of up to SHORT words are sought in windows of so many steps as well.
SHORT, SHORT_SPANS = 32, (1, 2)
TERMS = 1 << 14
RANK, EXTRA, PASSES = 128, 8, 3
ITEM_BLOCK = 20_000
#: Parts in which a task's sums are sent.
PARTS = 32
#: Terms found more often in a chunk of steps are summed by a matrix product.
OFTEN = 64
#: Cosines that a task holds at once.
SIMILARITIES = 200_000
#: Windows and items near each other that are checked together, and words of such windows.
CANDIDATES, STRETCHES = 50_000, 1_000_000
COSINE, OVERLAP, ANSWER, SURE = 0.35, 0.6, 0.5, 0.8
PAIR = "doc_id long, item_id long, word long, cosine double, overlap double, answer double"


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return words(pc.utf8_lower(texts))


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % TERMS


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed term is, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in slices(batches, "text", 3_000_000):
            h, counts = _hashes(texts_of(batch, "text"))
            first, terms = np.concatenate([[0], np.cumsum(counts)]), _terms(h)
            for a in range(0, len(counts), 128):
                part = counts[a : a + 128]
                seen = np.zeros((len(part), TERMS), bool)
                seen[np.repeat(np.arange(len(part)), part), terms[first[a] : first[a + len(part)]]] = True
                total += seen.sum(0)
            n += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(seen, -1), pa.int64()), "n": pa.array(np.append(total[seen], n), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(TERMS), 0
    for r in rows:
        if r[0] < 0:
            n = r[1]
        else:
            out[r[0]] = r[1]
    return out, n


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each step of words begins among all words, and how many steps each text has."""
    per = -(-counts // STEP)
    first = np.repeat(np.cumsum(counts) - counts, per)
    inside = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return first + inside * STEP, per


def _layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each step: where it begins, its text, its place in it, and how many steps that text has."""
    start, per = _steps(counts)
    doc = np.repeat(np.arange(len(counts)), per)
    return start, doc, np.arange(len(start)) - np.repeat(np.cumsum(per) - per, per), per[doc]


def _step_sums(h: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each step, and SPAN - 1 rows of zeros."""
    start, doc, _, _ = _layout(counts)
    k = table.shape[1]
    size = np.minimum(np.cumsum(counts)[doc] - start, STEP)  # a text's last step may be short
    table = np.ascontiguousarray(np.concatenate([table, np.zeros((1, k), table.dtype)]))  # by rows, as they are taken
    terms = np.concatenate([_terms(h), np.full(STEP, TERMS)])
    sums, room = np.zeros((len(start) + SPAN - 1, k), np.float32), np.empty((2000, k), table.dtype)
    for a in range(0, len(start), 2000):
        part, short = start[a : a + 2000], size[a : a + 2000]
        own, some = sums[a : a + len(part)], room[: len(part)]
        for j in range(STEP):
            np.take(table, np.where(short > j, terms[part + j], TERMS), 0, some, "clip")
            own += some
    return sums


def _windows(rows: np.ndarray, step: np.ndarray, per: np.ndarray, span: int) -> np.ndarray:
    """Sums of ``rows`` over the window of so many steps from each step, a shorter text's being all of it.

    ``rows`` has SPAN - 1 more than ``step``.  Windows that would end in another text aren't to be used.
    """
    n = len(step)
    out = rows[:n].copy()
    for j in range(1, span):
        out += rows[j : n + j]
    for k in range(1, span):
        few = np.flatnonzero((step == 0) & (per == k))
        if len(few):
            out[few] = sum(rows[few + j] for j in range(k))
    return out


def _lengths(sums: np.ndarray, step: np.ndarray, per: np.ndarray, span: int) -> np.ndarray:
    """The length of each window's sum; infinite where no window begins."""
    n = len(step)
    dots = [np.einsum("ij,ij->i", sums[: len(sums) - g], sums[g:], dtype=float) for g in range(span)]
    dots = [np.concatenate([x, np.zeros(len(sums) - len(x))]) for x in dots]

    def squares(at: np.ndarray, k: int) -> np.ndarray:
        return sum((2 if g else 1) * dots[g][at + i] for g in range(k) for i in range(k - g))

    out = squares(np.arange(n), span)
    for k in range(1, span):
        few = np.flatnonzero((step == 0) & (per == k))
        out[few] = squares(few, k)
    return np.where((step <= per - span) | (step == 0), np.maximum(np.sqrt(np.maximum(out, 0)), 1e-12), np.inf)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _sparse(h: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF vectors of all windows: terms and weights."""
    start, per = _steps(counts)
    ends, out, at = np.cumsum(counts), [], 0
    for d, n in enumerate(per.tolist()):
        for s in range(max(n - SPAN + 1, min(n, 1))):
            lo = start[at + s]
            t, c = np.unique(_terms(h[lo : min(lo + SPAN * STEP, ends[d])]), return_counts=True)
            w = c * idf[t]
            out.append((t, w / max(np.sqrt((w * w).sum()), 1e-12)))
        at += n
    return out


def _orthonormal(a: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' span, by the small matrix of their products (twice, for precision)."""
    for _ in range(2):
        values, turn = np.linalg.eigh((a.T @ a).astype(float))
        a = a @ (turn / np.sqrt(np.maximum(values, values[-1] * 1e-10 + 1e-30))).astype(np.float32)
    return a


def singular_vectors(sample: DataFrame, idf: np.ndarray, rank: int = RANK, tasks: int = 4, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (terms x rank) and values, by randomised subspace iteration."""
    spark, l = sample.sparkSession, rank + EXTRA
    rows = materialise(sample.select("text").repartition(tasks), "lsa")
    z = _orthonormal(np.random.default_rng(seed).standard_normal((TERMS, l), np.float32))

    def summed(z: np.ndarray, small: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(z)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            total = np.zeros((l, l) if small else (TERMS, l), np.float32)
            for batch in slices(batches, "text"):
                h, counts = _hashes(texts_of(batch, "text"))
                for t, w in _sparse(h, counts, idf):
                    y = w @ own[t]
                    if small:
                        total += np.outer(y, y)
                    else:
                        total[t] += np.outer(w, y)
            parts = np.array_split(total, PARTS)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "m": pa.array([p.tobytes() for p in parts], pa.binary())})

        got = _summed_parts(rows, run)
        shared.destroy()
        return got.reshape(-1, l)

    for _ in range(PASSES):
        z = _orthonormal(summed(z, False))
    values, turn = np.linalg.eigh(summed(z, True).astype(float))
    order = np.argsort(values)[::-1][:rank]
    sigma = np.sqrt(np.maximum(values[order], 0))
    ok = sigma > 1e-3 * max(sigma[0], 1e-12)
    return (z @ turn[:, order[ok]]).astype(np.float32), sigma[ok]


def _squares(h: np.ndarray, counts: np.ndarray, idf: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each step, the squared length of the TF-IDF vector of the window that begins there (within its text)."""
    start, per = _steps(counts)
    doc = np.repeat(np.arange(len(counts)), per)
    step = np.repeat(np.arange(len(start)), np.minimum(np.cumsum(counts)[doc] - start, STEP))
    terms, w = _terms(h).astype(np.int16), (idf.astype(float) ** 2)[_terms(h)]
    by_gap = np.zeros((span, len(start)))  # equal terms so many steps apart, by the first one's step
    by_gap[0] = np.bincount(step, w, len(start))
    for lag in range(1, min(span * STEP, len(terms))):
        p = np.flatnonzero(terms[lag:] == terms[:-lag])
        gap = step[p + lag] - step[p]
        ok = (gap < span) & (doc[step[p + lag]] == doc[step[p]])
        p, gap = p[ok], gap[ok]
        by_gap += np.bincount(gap * len(start) + step[p], 2 * w[p], by_gap.size).reshape(by_gap.shape)
    out = np.zeros(len(start))
    for gap in range(span):
        for j in range(span - gap):
            same = np.flatnonzero(doc[j:] == doc[: len(doc) - j])
            out[same] += by_gap[gap, same + j]
    return out


def _spread(total: np.ndarray, terms: np.ndarray, step: np.ndarray, g: np.ndarray) -> None:
    """Add each word's step's row of ``g`` to its term's row of ``total``."""
    n = np.bincount(terms, minlength=TERMS)
    often = np.flatnonzero(n > OFTEN)
    if len(often):
        place = np.full(TERMS, -1)
        place[often] = np.arange(len(often))
        own = place[terms]
        on = own >= 0
        counted = np.bincount(own[on] * len(g) + step[on], minlength=len(often) * len(g))
        total[often] += counted.reshape(len(often), len(g)).astype(np.float32) @ g
        terms, step = terms[~on], step[~on]
    order = np.argsort(terms.astype(np.int16), kind="stable")
    terms, step = terms[order], step[order]
    turn = np.arange(len(terms)) - np.searchsorted(terms, terms)  # a term's first words, then its second ones, ...
    order = np.argsort(turn.astype(np.int16), kind="stable")
    terms, step, ends = terms[order], step[order], np.cumsum(np.bincount(turn))
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        total[terms[a:b]] += g[step[a:b]]


def products(h: np.ndarray, counts: np.ndarray, idf: np.ndarray, z: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` the texts' ``A.T @ (A @ z)`` without the last factor, the term's idf; A has a unit row for each window."""
    start, doc, step, per = _layout(counts)
    if not len(start):
        return
    size = np.minimum(np.cumsum(counts)[doc] - start, STEP)
    g = _windows(_step_sums(h, counts, idf[:, None] * z), step, per, SPAN)
    scale = ((step <= per - SPAN) | (step == 0)) / np.maximum(_squares(h, counts, idf), 1e-12)
    g *= scale.astype(np.float32)[:, None]
    whole = g.copy()
    for j in range(1, SPAN):  # a step is in the windows that begin at it or up to two before
        g[(step == 0) & (per <= j)] = 0
        whole[j:] += g[: max(len(g) - j, 0)]
    terms, ends = _terms(h), start + size
    for a in range(0, len(start), 2000):
        b = min(a + 2000, len(start))
        _spread(total, terms[start[a] : ends[b - 1]], np.repeat(np.arange(b - a), size[a:b]), whole[a:b])


def _summed_parts(rows: DataFrame, run) -> np.ndarray:
    """The sum of the tasks' float32 matrices, sent in parts; they meet on executors, so that the driver gets one matrix."""

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(m.as_buffer(), np.float32).astype(float) for m in table.column("m")).astype(np.float32)
        return pa.table({"part": table.column("part").slice(0, 1), "m": pa.array([whole.tobytes()], pa.binary())})

    got = rows.mapInArrow(run, "part int, m binary").groupBy("part").applyInArrow(add, "part int, m binary").collect()
    return np.concatenate([np.frombuffer(r["m"], np.float32) for r in sorted(got, key=lambda r: r["part"])])


def nystrom(z: np.ndarray, y: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and values of A, by ``y = A.T @ A @ z`` for an orthonormal ``z``."""
    y = y.astype(float)
    values, turn = np.linalg.eigh((z.T @ y + y.T @ z) / 2)
    ok = values > 1e-7 * max(values[-1], 1e-12)
    left, sigma, _ = np.linalg.svd(y @ (turn[:, ok] / np.sqrt(values[ok])), full_matrices=False)
    ok = sigma[:rank] > 1e-3 * max(sigma[0] if len(sigma) else 0.0, 1e-12)
    return left[:, :rank][:, ok].astype(np.float32), sigma[:rank][ok]


def start(items: DataFrame, idf: np.ndarray, n_items: int, rank: int = RANK, seed: int = 12) -> np.ndarray:
    """An orthonormal basis that holds the items' leading singular vectors, filled up at random."""
    own, _ = singular_vectors(items, idf, rank, 1 + n_items // 5000)
    more = np.random.default_rng(seed).standard_normal((TERMS, rank + EXTRA - own.shape[1]), np.float32)
    return _orthonormal(np.concatenate([own, _orthonormal(more)], 1))


def fit(docs: DataFrame, items: DataFrame, idf: np.ndarray, z: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors and values of the passages of all documents and items: one step from ``z``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((z, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        total = np.zeros((TERMS, own.shape[1]), np.float32)
        for batch in slices(batches, "text", 3_000_000):
            products(*_hashes(texts_of(batch, "text")), weights, own, total)
        parts = np.array_split(total, PARTS)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "m": pa.array([p.tobytes() for p in parts], pa.binary())})

    # each task sends a whole matrix, so there are as many tasks as the cluster works on, not as the table has parts
    rows = docs.select("text").union(items.select("text")).coalesce(2 * spark.sparkContext.defaultParallelism)
    y = idf[:, None] * _summed_parts(rows, run).reshape(TERMS, -1)
    shared.destroy()
    return nystrom(z, y, rank)


def answer_of(text: str) -> str:
    """The last sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if p]
    return parts[-1] if parts else ""


def common(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Longest common subsequence's length, bit-parallel over the first sequence's positions."""
    full = (1 << size) - 1
    row = full
    for x in other:
        hit = row & masks.get(x, 0)
        row = (row + hit) | (row - hit)
    return size - (row & full).bit_count()


def _masks(h: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, x in enumerate(h):
        out[x] = out.get(x, 0) | 1 << k
    return out


def _near(h: np.ndarray, counts: np.ndarray, table: np.ndarray, latent: np.ndarray, n_short: int, cosine: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each span, in portions: the span, windows' first steps, items and cosines of at least ``cosine``.

    A window's product with an item is the sum of its steps' products.  The first ``n_short`` items have the short spans too.
    """
    _, _, step, per = _layout(counts)
    sums = _step_sums(h, counts, table)
    for span in (SPAN, *SHORT_SPANS) if n_short else (SPAN,):
        items = latent if span == SPAN else latent[:n_short]
        length = _lengths(sums, step, per, span)
        rows = max(64, SIMILARITIES // max(len(items), 1))
        found, n = [], 0
        for a in range(0, len(step), rows):
            own = slice(a, min(a + rows, len(step)))
            near = _windows(sums[a : own.stop + SPAN - 1] @ items.T, step[own], per[own], span)
            at, item = np.divmod(np.flatnonzero(near >= cosine * length[own, None]), max(len(items), 1))
            found.append((a + at, item, near[at, item] / length[a + at]))
            n += len(at)
            if n > CANDIDATES or own.stop == len(step):
                yield span, *(np.concatenate(x) for x in zip(*found))
                found, n = [], 0


class _Words:
    """The items' different words, to count how much of an item is among the words of a stretch."""

    def __init__(self, texts: list[list[int]]) -> None:
        self.sizes = np.array([len(x) for x in texts], np.int64)
        every = np.array([x for own in texts for x in own], np.uint64)
        self.vocabulary, number = np.unique(every, return_inverse=True)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.own = [np.unique(x, return_counts=True) for x in np.split(number, np.cumsum(self.sizes)[:-1])]

    def shared(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, items: np.ndarray) -> np.ndarray:
        """How many of the item's words are among those of ``h`` from ``begin`` to ``end``, for each stretch and its item."""
        out, none = np.zeros(len(items), np.int64), len(self.vocabulary)
        if not none or not len(items):
            return out
        maybe = np.flatnonzero(self.marks[(h >> np.uint64(44)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), none - 1)
        number = np.full(len(h) + 1, none)
        number[maybe] = np.where(self.vocabulary[found] == h[maybe], found, none)
        place = np.zeros(none + 1, np.int64)
        order = np.argsort(items, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(items[order])) + 1):
            words, times = self.own[items[part[0]]]
            place[words] = np.arange(1, len(words) + 1)
            most = int((end[part] - begin[part]).max())
            some = max(1, STRETCHES // (most + len(words) + 1))
            for a in range(0, len(part), some):
                rows = part[a : a + some]
                at = begin[rows][:, None] + np.arange(most)
                at = place[number[np.where(at < end[rows][:, None], at, len(h))]]
                has = np.zeros((len(rows), len(words) + 1), bool)
                has.reshape(-1)[(at + np.arange(len(rows))[:, None] * has.shape[1]).reshape(-1)] = True
                out[rows] = (has[:, 1:] * times).sum(1)
            place[words] = 0
        return out


def pairs(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, overlap: float = OVERLAP, answer: float = ANSWER, sure: float = SURE) -> DataFrame:
    """PAIR columns: the best passage of each document for each item it contains."""
    out, docs = None, docs.select("doc_id", "text")
    for got, fold in _blocks(docs, benchmark):
        part = _match(docs, got, fold, cosine, overlap, answer, sure)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], PAIR) if out is None else out


def _blocks(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], np.ndarray]]:
    """The items, a block at a time, and the terms' places in the latent space."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("text is not null")
    df, n = frequencies(docs)
    idf = np.log((n + 1) / (df + 0.5)).clip(0).astype(np.float32)
    n_items = items.count()
    if not n_items:
        return
    vectors, sigma = fit(docs, items, idf, start(items, idf, n_items))
    trim()
    fold = idf[:, None] * vectors / np.maximum(sigma, 1e-9).astype(np.float32)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-n_items // ITEM_BLOCK)))))
    for block in sorted(r[0] for r in numbered.select("block").distinct().collect()):
        yield [(r[0], r[1]) for r in numbered.where(F.col("block") == block).select("item_id", "text").collect()], fold


def _match(docs: DataFrame, items: list[tuple[int, str]], fold: np.ndarray, cosine: float, overlap: float, answer: float, sure: float, whole: bool = False) -> DataFrame:
    """PAIR rows; with ``whole`` the rows of ``docs`` without a match, as they are."""
    n_words = _hashes(pa.array([t for _, t in items], pa.string()))[1]
    items = [items[k] for k in np.argsort((n_words == 0) | (n_words > SHORT), kind="stable").tolist()]  # short ones first
    n_short = int(((n_words > 0) & (n_words <= SHORT)).sum())
    h, counts = _hashes(pa.array([t for _, t in items], pa.string()))
    vectors = np.stack([fold[_terms(x)].sum(0) if len(x) else np.zeros(fold.shape[1], np.float32) for x in np.split(h, np.cumsum(counts)[:-1])])
    own = [x.tolist() for x in np.split(h, np.cumsum(counts)[:-1])]
    ha, ca = _hashes(pa.array([answer_of(t) for _, t in items], pa.string()))
    ends = [x.tolist() for x in np.split(ha, np.cumsum(ca)[:-1])]
    shared = docs.sparkSession.sparkContext.broadcast(([i for i, _ in items], _unit(vectors).astype(np.float32), own, ends, fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, latent, texts, answers, table = shared.value
        masks = [(_masks(a), len(a), _masks(b), len(b)) for a, b in zip(texts, answers)]
        words_of = _Words(texts)
        for batch in slices(batches, "text", 3_000_000):
            h, counts = _hashes(texts_of(batch, "text"))
            first = np.cumsum(counts) - counts
            best: dict[tuple[int, int], tuple] = {}
            for span, at, chosen, near in _near(h, counts, table, latent, n_short, cosine):
                _, doc, step, _ = _layout(counts)
                d, s = doc[at], step[at]
                # a step on either side; an item longer than a window gets as many words more
                lo = np.maximum(0, (s - 1) * STEP)
                hi = np.minimum(counts[d], (s + span + 1) * STEP + np.maximum(0, words_of.sizes[chosen] - span * STEP))
                likely = words_of.shared(h, first[d] + lo, first[d] + hi, chosen) >= overlap * words_of.sizes[chosen]
                likely &= words_of.sizes[chosen] > 0  # else the subsequence can't be long enough
                for k in np.flatnonzero(likely).tolist():
                    i, t, a = int(chosen[k]), int(d[k]), int(lo[k])
                    m, size, m2, size2 = masks[i]
                    seen = h[first[t] + a : first[t] + hi[k]].tolist()
                    share = common(m, size, seen) / size
                    if share < overlap:
                        continue
                    told = common(m2, size2, seen) / size2 if size2 else 0.0
                    if share < sure and told < answer:
                        continue
                    now = (share, told, -a, float(near[k]))
                    best[(t, i)] = max(best.get((t, i), now), now)
            if whole:
                hit = np.ones(batch.num_rows, bool)
                hit[[d for d, _ in best]] = False
                yield batch.filter(pa.array(hit))
                continue
            found = sorted(best.items())
            names = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": names.take(pa.array([d for (d, _), _ in found], pa.int64())), "item_id": pa.array([ids[i] for (_, i), _ in found], pa.int64()),
                "word": pa.array([-v[2] for _, v in found], pa.int64()), "cosine": pa.array([v[3] for _, v in found], pa.float64()),
                "overlap": pa.array([v[0] for _, v in found], pa.float64()), "answer": pa.array([v[1] for _, v in found], pa.float64()),
            })

    return docs.mapInArrow(run, docs.schema if whole else PAIR)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that contain an item, each judged by its own text."""
    chosen = {"cosine": COSINE, "overlap": OVERLAP, "answer": ANSWER, "sure": SURE} | options
    out = docs
    for got, fold in _blocks(docs, benchmark):
        out = _match(out, got, fold, **chosen, whole=True)
    return out
