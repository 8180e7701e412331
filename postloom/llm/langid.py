"""Language of words and documents by a linear-chain conditional random field (operator 1).

Every word's label is a language; digits and signs at or in a word are left out.  Emissions are sums of learned weights of the word's
affixes and character n-grams (with marks at its ends) and of the word itself (the
lexicon), all in one hashed table; transitions between languages are learned too.
Training strings runs of words of different languages together, so that switching
within a text is seen.  All documents outside the held-out fold are learned from: each task climbs by
its own ones, dealt by a hash, and the tasks' weights are averaged, each by the squared
gradients behind it.  Forward-backward gives each word's marginals; a document's
language has the largest mean marginal over its words with letters.

Forward-backward runs on all words of a batch as one chain that starts anew at each
document.  The chain is cut into lanes; the lanes' transfer matrices join them.

Nulls: a null text, or one without letters, is ``und`` with score 0; null languages
are not learned from; a null ``doc_id`` counts as not held out and isn't learned from.
Very long texts are read whole.  Repeated rows get equal results; ties go to the first
language in order.  With nothing to learn from, all is ``und``.  Extra columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, give_back, slices, texts_of, trim
from .tok import forget

#: Characters that a task learns from: as few as this before there are more tasks, and at most.
LEAST_CHARS, MOST_CHARS = 5_000_000, 200_000_000
#: A task with fewer characters goes through them again, up to four times.
LEARNED_CHARS = 20_000_000
#: Bytes that a task strings together at once, and parts in which it sends what it learned.
CHUNK_BYTES, PARTS = 8_000_000, 32
#: Different words whose features are made at once, and text bytes whose words are judged at once.
FEATURE_WORDS, JUDGED_BYTES = 50_000, 1_500_000
BITS = 17
UND = "und"
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * _P
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of each word's features, and the word that each slot belongs to."""
    joined = "\x02" + "\x02".join(words) + "\x02"
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    edge = a == 2
    own = (np.cumsum(edge) - 1).astype(np.int32)
    slots, owner = [], []
    for n in (3, 4):  # with the marks: affixes of one less letter
        if len(a) < n:
            continue
        span = len(a) - n + 1
        h, ok = a[:span].copy(), np.ones(span, bool)
        for k in range(1, n):
            h = h * np.uint64(0x100000001B3) + a[k : k + span]
            if k < n - 1:
                ok &= ~edge[k : k + span]
        slots.append(_slot(h[ok], n))
        owner.append(own[:span][ok])
    inside = np.flatnonzero(~edge)
    start = np.flatnonzero(edge)
    power = _POWERS[np.minimum(inside - start[own[inside]], len(_POWERS) - 1)]
    whole = np.zeros(len(words), np.uint64)
    if len(inside):
        at = np.flatnonzero(np.diff(own[inside], prepend=-1))
        whole[own[inside][at]] = np.add.reduceat(a[inside] * power, at)
    slots.append(_slot(whole, 1))
    owner.append(np.arange(len(words), dtype=np.int32))
    return np.concatenate(slots), np.concatenate(owner)


def by_word(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slots word by word, and how many each word has, made of so many words at once."""
    slots, per = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(words), FEATURE_WORDS):
        part = words[k : k + FEATURE_WORDS]
        found, owner = features(part)
        slots.append(found[np.argsort(owner, kind="stable")])
        per.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(slots), np.concatenate(per)


def cores(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words (lower case, letters only), and for each word with letters its number and its text's."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    core = pc.replace_substring_regex(coded.dictionary, r"[^\p{L}\p{M}']+", "")
    lettered = pc.match_substring_regex(core, r"\p{L}").to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = lettered[at] if len(at) else np.zeros(0, bool)
    return core.to_numpy(zero_copy_only=False).tolist(), at[real], doc[real]


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # slots x languages
    transitions: np.ndarray  # log, from x to
    first: np.ndarray  # log

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        for k in range(0, len(words), FEATURE_WORDS):
            part = words[k : k + FEATURE_WORDS]
            slots, owner = features(part)
            for j in range(len(self.langs)):
                out[k : k + len(part), j] = np.bincount(owner, self.weights[slots, j], len(part))
        return out

    def marginals(self, e: np.ndarray, begins: np.ndarray, pairs: bool = False):
        """Each word's marginals; with ``pairs`` also the expected transitions and first labels."""
        n, k = e.shape
        lanes = max(1, min(1024, n // 64))
        steps = -(-n // lanes)
        x = np.ones((lanes * steps, k))
        np.subtract(e, e.max(1, keepdims=True), out=x[:n])
        np.exp(x[:n], out=x[:n])
        new = np.ones(lanes * steps, bool)
        new[:n] = begins
        x, new = x.reshape(lanes, steps, k).transpose(1, 0, 2), new.reshape(lanes, steps).T
        T, P = np.exp(self.transitions), np.exp(self.first)
        reset = np.broadcast_to(P, (k, k))
        total = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
        for t in range(steps):
            m = np.where(new[t][:, None, None], reset, T) * x[t][:, None, :]
            total = np.matmul(total, m)
            total /= total.sum((1, 2), keepdims=True)
        a, b = np.empty((lanes, k)), np.empty((lanes, k))
        now = np.full(k, 1 / k)
        for i in range(lanes):
            a[i] = now
            now = now @ total[i]
            now /= now.sum()
        now = np.ones(k)
        for i in range(lanes - 1, -1, -1):
            b[i] = now
            now = total[i] @ now
            now /= now.sum()
        before, alpha, beta = np.empty((steps if pairs else 0, lanes, k)), np.empty((steps, lanes, k)), np.empty((steps, lanes, k))
        for t in range(steps):
            if pairs:
                before[t] = a
            a = np.where(new[t][:, None], P, a @ T) * x[t]
            a /= a.sum(1, keepdims=True)
            alpha[t] = a
        for t in range(steps - 1, -1, -1):
            beta[t] = b
            y = x[t] * b
            b = np.where(new[t][:, None], (y * P).sum(1, keepdims=True), y @ T.T)
            b = b / b.sum(1, keepdims=True)
        flat = lambda z: z.transpose(1, 0, 2).reshape(-1, k)[:n]
        alpha *= beta
        p = flat(alpha)
        p = p / p.sum(1, keepdims=True)
        if not pairs:
            return p
        go = ~begins
        left, right = flat(before)[go], (flat(x) * flat(beta))[go]
        z = np.einsum("ni,ij,nj->n", left, T, right)
        return p, T * np.einsum("ni,nj->ij", left / z[:, None], right), p[begins].sum(0)


def blank(langs: list[str]) -> Field:
    k = len(langs)
    return Field(langs, np.zeros((1 << BITS, k)), np.zeros((k, k)) - np.log(k), np.zeros(k) - np.log(k))


class Ascent:
    """Gradient ascent (Adagrad) on the likelihood of runs of 5 to 40 words, strung together."""

    def __init__(self, langs: list[str], batch_words: int = 40_000, rate: float = 0.3, seed: int = 7) -> None:
        self.field, self.batch_words, self.rate, self.rng = blank(langs), batch_words, rate, np.random.default_rng(seed)
        self.squares = [np.full(x.shape, 1e-6) for x in (self.field.weights, self.field.transitions, self.field.first)]
        self.number = {x: i for i, x in enumerate(langs)}
        self.words = 0

    def learn(self, texts: pa.Array, langs: list[str], epochs: int) -> None:
        known, numbers, doc = cores(texts)
        n = len(numbers)
        if not n:
            return
        self.words += n
        cuts = np.cumsum(self.rng.integers(5, 41, n // 5 + 1))
        start = np.union1d(cuts[cuts < n], np.flatnonzero(np.diff(doc, prepend=-1)))
        size = np.diff(np.append(start, n))
        label = np.array([self.number[x] for x in langs])[doc[start]]
        slots, per = by_word(known)
        for _ in range(epochs):
            order = self.rng.permutation(len(start))
            whole = np.cumsum(size[order]) // self.batch_words
            for runs in np.split(order, np.flatnonzero(np.diff(whole)) + 1):
                self._step(numbers[_ranges(start[runs], size[runs])], size[runs], label[runs], slots, per)

    def _step(self, words: np.ndarray, size: np.ndarray, label: np.ndarray, slots: np.ndarray, per: np.ndarray) -> None:
        field, k = self.field, len(self.field.langs)
        y, starts = np.repeat(label, size), np.zeros(len(words), bool)
        starts[(np.cumsum(size) - size)[::6]] = True
        index = np.flatnonzero(np.bincount(words, minlength=len(per)))
        own = np.zeros(len(per), np.int64)
        own[index] = np.arange(len(index))
        own = own[words]
        n = per[index]
        slot = slots[_ranges((np.cumsum(per) - per)[index], n)]
        table = np.add.reduceat(field.weights[slot], np.cumsum(n) - n, axis=0)
        p, moved, begun = field.marginals(table[own], starts, pairs=True)
        miss = -p
        miss[np.arange(len(y)), y] += 1
        used = np.flatnonzero(np.bincount(slot, minlength=1 << BITS))
        g = [np.bincount(slot, np.repeat(np.bincount(own, miss[:, j], len(index)), n), 1 << BITS)[used] for j in range(k)]
        g = np.stack(g, 1) / 50 - 0.002 * field.weights[used]
        sq_w, sq_t, sq_f = self.squares
        sq_w[used] += g**2
        field.weights[used] += self.rate * g / np.sqrt(sq_w[used])
        go = ~starts[1:]
        seen = np.bincount(y[:-1][go] * k + y[1:][go], minlength=k * k).reshape(k, k)
        for value, grad, sq in ((field.transitions, (seen - moved) / len(words), sq_t), (field.first, (np.bincount(y[starts], minlength=k) - begun) / len(words), sq_f)):
            sq += grad**2
            value += self.rate * grad / np.sqrt(sq)
        field.transitions -= np.log(np.exp(field.transitions).sum(1, keepdims=True))
        field.first -= np.log(np.exp(field.first).sum())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Field | None:
    """A field from all whole documents outside the held-out fold, each task's by its own documents, and the mean of these."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs, chars = rows.agg(F.collect_set("lang"), F.sum(F.length("text").cast("long"))).first()
    if not langs:
        return None
    langs = sorted(langs)
    tasks = max(1, chars // MOST_CHARS, min(2 * spark.sparkContext.defaultParallelism, chars // LEAST_CHARS))
    epochs = min(4, -(-LEARNED_CHARS // max(chars // tasks, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ascent, waiting, size, first = Ascent(langs), [], 0, None
        for batch in itertools.chain(slices(batches, "text"), [None]):
            if waiting and (batch is None or size + batch.nbytes > CHUNK_BYTES):
                ascent.learn(pa.concat_arrays([texts_of(x, "text") for x in waiting]), [v for x in waiting for v in x["lang"].to_pylist()], epochs)
                waiting, size = [], 0
                give_back()
            if batch is not None:
                first = batch["key"][0].as_py() if first is None else first
                waiting.append(batch)
                size += batch.nbytes
        if not ascent.words:
            return
        field, seen = ascent.field, np.float32(ascent.words)
        sent = [*zip(np.array_split(field.weights, PARTS), np.array_split(ascent.squares[0], PARTS)), (np.concatenate([field.transitions, field.first[None]]), seen)]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(len(sent)), pa.int32()), "first": pa.array([first] * len(sent), pa.int64()),
            "value": pa.array([v.astype(np.float32).tobytes() for v, _ in sent], pa.binary()), "weight": pa.array([w.astype(np.float32).tobytes() for _, w in sent], pa.binary()),
        })

    def mean(table: pa.Table) -> pa.Table:
        total, weights = 0.0, 0.0
        for v, w in (pair for _, *pair in sorted(zip(*(table.column(c).to_pylist() for c in ("first", "value", "weight"))))):
            v, w = (np.frombuffer(x, np.float32).astype(float) for x in (v, w))
            total, weights = total + v * w, weights + w
        return pa.table({"part": table.column("part").slice(0, 1), "value": pa.array([(total / weights).astype(np.float32).tobytes()], pa.binary())})

    # dealt and ordered by a hash: no task has the documents of one place in the table alone, and a fit can be repeated
    key = F.xxhash64("doc_id", "lang", "text")
    dealt = rows.select("text", "lang", key.alias("key")).repartition(tasks, "key").sortWithinPartitions("key", "text").coalesce(tasks)
    sent = dealt.mapInArrow(run, "part int, first long, value binary, weight binary").groupBy("part")
    got = sorted(sent.applyInArrow(mean, "part int, value binary").collect(), key=lambda r: r["part"])
    if not got:
        return None
    *weights, small = (np.frombuffer(r["value"], np.float32) for r in got)
    small = small.reshape(-1, len(langs)).astype(float)
    small -= np.log(np.exp(small).sum(1, keepdims=True))
    field = Field(langs, np.concatenate(weights).reshape(-1, len(langs)), small[:-1], small[-1])
    trim()
    return field


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words (with letters), n_switches (changes of a word's best label)."""
    return _predicted(docs.select("doc_id", "text"), field, False)


def keep(docs: DataFrame, field: Field | None, least: float) -> DataFrame:
    """The rows of ``docs``, whole, whose language is found with a score of at least ``least``."""
    return _predicted(docs, field, True, least)


def _predicted(docs: DataFrame, field: Field | None, whole: bool, least: float = 0.0) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shared.value
        for batch in slices(batches, "text", JUDGED_BYTES):
            n = batch.num_rows
            texts = texts_of(batch, "text")
            words, at, doc = cores(texts)
            pred, score, counts, switches = [UND] * n, np.zeros(n), np.bincount(doc, minlength=n), np.zeros(n, np.int64)
            if model is not None and len(at):
                begins = np.diff(doc, prepend=-1) > 0
                p = model.marginals(model.emissions(words)[at], begins)
                mean = np.stack([np.bincount(doc, p[:, j], n) for j in range(len(model.langs))], 1) / np.maximum(counts, 1)[:, None]
                best = mean.argmax(1)
                label = p.argmax(1)
                turned = (np.diff(label, prepend=label[0]) != 0) & ~begins
                switches = np.bincount(doc, turned, n).astype(np.int64)
                for i in np.flatnonzero(counts).tolist():
                    pred[i], score[i] = model.langs[best[i]], min(1.0, float(mean[i, best[i]]))
            if whole:
                yield batch.filter(pa.array((np.array(pred, object) != UND) & (score >= least), pa.bool_()))
                continue
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()),
                "n_words": pa.array(counts, pa.int64()), "n_switches": pa.array(switches, pa.int64()),
            })

    return docs.mapInArrow(run, docs.schema if whole else "doc_id long, lang_pred string, score double, n_words long, n_switches long")
