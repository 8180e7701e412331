"""Quality by an interpolated modified Kneser-Ney model (operator 7).

The model is over characters: n-grams of five symbols, code points in lower case with
marks before a text's beginning.  The alphabet is whatever the corpus has, and the
tables of n-grams grow with it.  An n-gram is two longs, exact, 21 bits a symbol.

Counts of the trusted documents' n-grams are summed in each task, then by shards of the
n-gram.  Continuation counts, counts of counts and sums per context are further
groupings; joins of the counts with their contexts' sums give discounted shares and the
contexts' weights for the lower order.  To score, each task sends its different n-grams
once; they are joined, order by order, with shares, weights and the next lower order's
probabilities, and the answers are dealt back to the task that asked, which sums them per
document.  Texts are not shuffled, and no table is collected or broadcast.

Perplexity per symbol is compared with a quantile of the trusted documents of its
language; a language without trusted documents takes the quantile over all.

Nulls: a null or empty text has no symbols, a null perplexity and is not kept; a null
language is a language of its own (``und``); a null ``doc_id`` is never trusted.  Very
long texts are read whole; repeated rows get equal results; a document is trusted if all
labels of its id say quality and none toxic; a perplexity equal to the threshold is kept.
Without trusted text all documents with text are kept.  An empty table gives no rows.
Extra columns are ignored.  ``docs`` must be cut alike by every scan (files are); a scan
that isn't fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sides
from .base import bounded_batches, materialise, slices, texts_of
from .shingles import _GOLD, mix

ORDER, BITS = 5, 21
BEGIN = (1 << BITS) - 1
QUANTILE, SLACK = 0.995, 1.25
#: Up to so many languages' thresholds are broadcast; more are joined by a shuffle.
FEW_LANGUAGES = 1000
#: Different n-grams that a task holds before it sends them.
HELD = 1_000_000
_MARK = "\U0010ffff"
_ONE = (1 << BITS) - 1
_SLICE = 3_000_000
GRAM = "a long, b long"


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams (two longs each, sorted), the place of each symbol's n-gram among them, and how many symbols each text has."""
    low = [t.lower() for t in texts]
    pad = _MARK * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(low)).encode("utf-32-le"), np.uint32).astype(np.int64)
    s = np.where(points == 0x10FFFF, BEGIN, points + 1)
    sizes = np.array([len(t) for t in low], np.int64)
    own = np.ones(len(s), bool)
    begin = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    for k in range(ORDER - 1):
        own[begin + k] = False
    alphabet = np.flatnonzero(np.bincount(s))
    place = np.zeros(BEGIN + 1, np.int32)
    place[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    code = place[s]
    if len(alphabet) ** ORDER < 1 << 62:
        whole = np.zeros(len(s), np.int64)
        for k in range(ORDER - 1, -1, -1):
            whole[ORDER - 1 :] = whole[ORDER - 1 :] * len(alphabet) + code[ORDER - 1 - k : len(s) - k]
        seen, where = np.unique(whole[own], return_inverse=True)
        parts, rest = [], seen
        for _ in range(ORDER):
            parts.append(alphabet[rest % len(alphabet)])
            rest = rest // len(alphabet)
        return _packed(parts[::-1]) + (where, sizes)
    at = np.flatnonzero(own)
    a, b = _packed([s[at - k] for k in range(ORDER - 1, -1, -1)])
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    where = np.zeros(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return a[order][new], b[order][new], where, sizes


def _packed(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first two symbols in one long, the last three in another."""
    one, two, three, four, five = symbols
    return one << BITS | two, three << 2 * BITS | four << BITS | five


def _suffix(k: int) -> list[Column]:
    """The n-gram's last ``k`` symbols as a and b."""
    a = {5: "a", 4: f"a & {_ONE}"}.get(k, "0L")
    b = {2: f"b & {(1 << 2 * BITS) - 1}", 1: f"b & {_ONE}"}.get(k, "b")
    return [F.expr(a).cast("long").alias("a"), F.expr(b).cast("long").alias("b")]


def _context() -> list[Column]:
    """The n-gram without its last symbol as x and y."""
    return [F.expr(f"shiftright(a, {BITS})").alias("x"), F.expr(f"shiftright(b, {BITS}) | shiftleft(a & {_ONE}, {2 * BITS})").alias("y")]


class _Tally:
    """N-grams with their counts, summed as they come."""

    def __init__(self) -> None:
        self.a, self.b, self.n = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.new.append((a, b, n))
        self.held += len(a)
        if self.held > max(HELD, 2 * len(self.a)):
            self.sum()

    def sum(self) -> None:
        if not self.held:
            return
        a, b, n = (np.concatenate([x, *y]) for x, y in zip((self.a, self.b, self.n), zip(*self.new)))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        self.a, self.b, self.n = a[first], b[first], np.add.reduceat(n, first)
        self.new, self.held = [], 0

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        self.sum()
        for k in range(0, len(self.a), 50_000):
            yield self.a[k : k + 50_000], self.b[k : k + 50_000], self.n[k : k + 50_000]


def asked(docs: DataFrame) -> DataFrame:
    """part, a, b: the different n-grams of each partition of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, part = _Tally(), TaskContext.get().partitionId()
        for batch in slices(batches, "text", _SLICE):
            a, b, _, _ = ngrams(texts_of(batch, "text").to_pylist())
            tally.add(a, b, np.zeros(len(a), np.int64))
        for a, b, _ in tally.rows():
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(a), part, np.int32)), "a": pa.array(a), "b": pa.array(b)})

    return docs.select("text").mapInArrow(run, "part int, " + GRAM)


def count(docs: DataFrame, trusted: str | None = None) -> DataFrame:
    """a, b, n: the n-grams of the documents whose ids were dealt to their partitions below ``trusted``; of all without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        ids = None
        if trusted is not None:
            found = sides.own(trusted)
            ids = pa.array([], pa.int64()) if found is None else found.column("doc_id").combine_chunks()
        for batch in batches:
            if ids is not None:
                batch = batch.filter(pa.compute.is_in(batch.column(0).cast(pa.int64()), value_set=ids, skip_nulls=True))
            for part in slices([batch], "text", _SLICE):
                a, b, where, _ = ngrams(texts_of(part, "text").to_pylist())
                tally.add(a, b, np.bincount(where, minlength=len(a)))
        for a, b, n in tally.rows():
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "n": pa.array(n)})

    return docs.select("doc_id", "text").mapInArrow(run, GRAM + ", n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney's D1, D2, D3+ from the counts of counts."""
    r = counts.where("n <= 4").groupBy("n").count().collect()
    n = {int(x[0]): x[1] for x in r}
    one, two = n.get(1, 0), n.get(2, 0)
    y = one / (one + 2 * two) if one else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n.get(k + 1, 0) / n[k] if n.get(k) else k * 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return out


def train(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Of each order, the lowest first: n-grams with their discounted shares, contexts with their weights for the lower order."""
    tables, counts = [], materialise(counts, "ngrams")
    for k in range(ORDER, 0, -1):
        d = _discounts(counts)
        rows = counts.select("a", "b", "n", *_context(), F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]).alias("d"))
        sums = materialise(rows.groupBy("x", "y").agg(F.sum("n").alias("total"), F.sum("d").alias("held")), "contexts")
        shares = rows.join(sums, ["x", "y"]).select("a", "b", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
        tables.append((shares, sums.select("x", "y", (F.col("held") / F.col("total")).alias("g"))))
        if k > 1:  # continuation counts: the different symbols before each shorter n-gram
            counts = materialise(counts.select(*_suffix(k - 1)).groupBy("a", "b").agg(F.count("*").alias("n")), "ngrams")
    return tables[::-1]


def probabilities(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """a, b, p of each of the different n-grams (a, b)."""
    wanted = {ORDER: grams.select("a", "b")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = materialise(wanted[k + 1].select(*_suffix(k)).distinct(), "wanted")
    lower = wanted[1].select("a", "b", F.lit(1.0 / (wanted[1].count() + 1)).alias("q"))  # any symbol of the corpus, and the unseen
    for k, (shares, weights) in enumerate(tables, 1):
        rows = wanted[k].select("a", "b", *_context(), *(c.alias(n) for c, n in zip(_suffix(max(k - 1, 1)), ("la", "lb"))))
        rows = rows.join(shares, ["a", "b"], "left").join(weights, ["x", "y"], "left")
        rows = rows.join(lower.select(F.col("a").alias("la"), F.col("b").alias("lb"), "q"), ["la", "lb"])
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("g", F.lit(1.0)) * F.col("q")
        lower = materialise(rows.select("a", "b", p.alias("q")), "lower")
    return lower.select("a", "b", F.col("q").alias("p"))


def score(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity (null without symbols)."""
    wanted = materialise(asked(docs), "asked")
    known = probabilities(wanted.select("a", "b").distinct(), tables)
    told = sides.deal(wanted.join(known, ["a", "b"]).select("part", "a", "b", F.log("p").cast("float").alias("logp")), "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, h = None, np.zeros(0, np.uint64)
        for batch in slices(batches, "text", _SLICE):
            a, b, where, sizes = ngrams(texts_of(batch, "text").to_pylist())
            if len(a) and found is None:
                rows = sides.own(told)
                if rows is None:
                    raise RuntimeError("the documents are cut otherwise than when their n-grams were asked for")
                found = [rows.column(c).to_numpy() for c in ("a", "b", "logp")]
                h = _hash(found[0], found[1])
                order = np.argsort(h)
                h, found = h[order], [x[order] for x in found]
            logs = _looked_up(a, b, h, *found) if len(a) else np.zeros(0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            mean = np.bincount(doc, logs[where], len(sizes)) / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()), "lang": batch.column(1).cast(pa.string()),
                "n_symbols": pa.array(sizes, pa.int64()), "perplexity": pa.array(np.exp(-mean), pa.float64(), mask=sizes == 0),
            })

    return docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "doc_id long, lang string, n_symbols long, perplexity double")


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64)) * _GOLD + b.view(np.uint64))


def _looked_up(a: np.ndarray, b: np.ndarray, h: np.ndarray, known_a: np.ndarray, known_b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The values of the n-grams; ``h`` sorts the known ones, whose symbols decide."""
    want = _hash(a, b)
    at = np.searchsorted(h, want)
    while True:
        there = np.minimum(at, len(h) - 1)
        wrong = (known_a[there] != a) | (known_b[there] != b)
        if not wrong.any():
            return value[there].astype(float)
        if (wrong & ((at >= len(h)) | (h[there] != want))).any():
            raise RuntimeError("the documents are cut otherwise than when their n-grams were asked for")
        at = at + wrong


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept.

    Trusted are documents labelled of quality and not toxic.  The threshold is the
    quantile of their perplexities times ``slack``.
    """
    bounded_batches(docs.sparkSession)
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    good = materialise(good, "good")
    places = docs.select("doc_id", F.spark_partition_id().alias("part")).join(good, "doc_id", "left_semi").distinct()
    trusted = sides.deal(places, "trusted")
    scores = materialise(score(docs, train(count(docs, trusted))), "perplexity")
    known = scores.join(good, "doc_id", "left_semi").where("perplexity is not null")
    limit = lambda: (F.percentile_approx("perplexity", quantile, 10000) * slack).alias("threshold")
    per_lang = known.groupBy("lang").agg(limit())
    overall = known.agg(limit()).first()[0]
    few = per_lang.limit(FEW_LANGUAGES + 1).collect()
    if len(few) <= FEW_LANGUAGES:
        per_lang = F.broadcast(docs.sparkSession.createDataFrame(few, "lang string, threshold double"))
    out = scores.join(per_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(float("inf") if overall is None else overall)))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
