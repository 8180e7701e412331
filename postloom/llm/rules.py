"""Quality rules by gradient-boosted trees (operator 8).

Statistics of each whole text go to boosted trees trained on labelled documents.  The
trees are flattened into numpy node arrays and scored for a batch at once.  Chosen
features are monotonic: a larger share of symbols, repeated lines or repeated words
never raises the score.

Nulls: a null text has no words.  An empty text has zero statistics and fails the base
rules.  Very long texts are read whole, in linear space.  Repeated rows get equal
results.  Without labels of both kinds the trees' verdict is "keep".  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, slices, texts_of

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "ended", "log_lines", "marks")
#: -1: the score must not rise with the feature.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
#: Labelled documents that the trees are fitted on, at most.
FIT_ROWS = 8000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_WHITE = [32, *range(9, 14)]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def statistics(text: str) -> tuple[list[int], list[float]]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and FEATURES."""
    raw = text.encode()
    words = raw.split()  # at \x20 and \x09-\x0D, as bytes are
    n = len(words)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    word_chars = len(text) - int(by_byte[_WHITE].sum())
    n_symbols = int(by_byte[_SYMBOLS].sum())
    seen: set[str] = set()
    n_dup = n_lines = n_ended = 0
    for line in text.split("\n"):
        if core := line.strip(" \t\n\x0b\x0c\r"):
            n_lines += 1
            n_dup += line in seen
            n_ended += core[-1] in ".!?…:;\"'"
            seen.add(line)
    n_repeat, distinct = 0, n
    if n:
        ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        distinct = len(np.unique(ids))
    if n >= 3:
        keys = ids[:-2] * _MIX[0] + ids[1:-1] * _MIX[1] + ids[2:] * _MIX[2]
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = twice.copy()
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
        n_repeat = int(covered.sum())
    c, w, m = max(word_chars, 1), max(n, 1), max(n_lines, 1)
    marks = int(by_byte[33:48].sum() + by_byte[58:65].sum())
    return [n, word_chars, n_symbols, n_dup, n_repeat], [
        np.log1p(n), word_chars / w, n_symbols / c, n_dup / m, n_repeat / w, distinct / w,
        int(by_byte[65:91].sum()) / c, int(by_byte[48:58].sum()) / c, n_ended / m, np.log1p(n_lines), marks / c,
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cutoff: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 20.0, l2: float = 2.0) -> Trees:
    """Newton boosting on logistic loss over binned features.

    A split on a monotonic feature must order its children's values, and both stay on
    their side of the midpoint below.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    raw = np.full(len(y), base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for column, v in ((feature, 0), (cut, 0.0), (left, k), (right, k), (value, 0.0)):
            column.append(v)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            k, rows, low, high, level = open_nodes.pop()
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                size = len(edges[f]) + 1
                gs = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                vl = np.clip(gs / (hs + l2), low, high)
                vr = np.clip((G - gs) / (H - hs + l2), low, high)
                gain = vl * gs - 0.5 * vl**2 * (hs + l2) + vr * (G - gs) - 0.5 * vr**2 * (H - hs + l2) - 0.5 * G**2 / (H + l2)
                ok = (hs * 4 >= least / 4) & ((H - hs) * 4 >= least / 4) & (monotone[f] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -1)
                if len(gain) and gain.max() > best[0]:
                    b = int(gain.argmax())
                    best = (float(gain[b]), (f, b, float(vl[b]), float(vr[b])))
            if best[1] is None:
                value[k] = rate * float(np.clip(G / (H + l2), low, high))
                raw[rows] += value[k]
                continue
            f, b, vl, vr = best[1]
            feature[k], cut[k] = f, float(edges[f][b])
            left[k], right[k] = node(), node()
            mid, goes = (vl + vr) / 2, binned[rows, f] <= b
            lows, highs = [low, low], [high, high]
            if monotone[f]:
                lows, highs = ([low, mid], [mid, high]) if monotone[f] > 0 else ([mid, low], [high, mid])
            open_nodes.append((left[k], rows[goes], lows[0], highs[0], level + 1))
            open_nodes.append((right[k], rows[~goes], lows[1], highs[1], level + 1))
    return Trees(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def _measured(docs: DataFrame) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [statistics(t) for t in texts_of(batch, "text").to_pylist()]
            out = {"doc_id": batch.column(0).cast(pa.int64())}
            out |= {n: pa.array([c[k] for c, _ in found], pa.int64()) for k, n in enumerate(names)}
            yield pa.RecordBatch.from_pydict(out | {"features": pa.array([f for _, f in found], pa.list_(pa.float64()))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", features array<double>")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_good: float = 0.998) -> Trees | None:
    """Trees on at most ``fit_rows`` labelled documents, picked by a hash of their id.

    The cutoff lets the share ``keep_good`` of the good ones pass, and is 0.5 at most.
    """
    bounded_batches(docs.sparkSession)
    ids = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = _measured(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")).select("doc_id", "features")
    got = rows.join(F.broadcast(ids), "doc_id").select("features", "quality").collect()
    x, y = np.array([r[0] for r in got], float).reshape(-1, len(FEATURES)), np.array([float(r[1] > 0) for r in got])
    if len(set(y.tolist())) < 2:
        return None
    trees = fit(x, y, [MONOTONE.get(f, 0) for f in FEATURES])
    trees.cutoff = min(0.5, float(np.quantile(trees.score(x)[y > 0], 1 - keep_good)))
    return trees


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Statistics, ``base_failed``, ``score`` and ``kept`` of every document."""
    bounded_batches(docs.sparkSession)
    measured = _measured(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, repeat = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            failed = (n < 50) | (100 * repeat > 50 * n)
            score = np.ones(len(n))
            if trees is not None and len(n):
                score = trees.score(np.array(batch.column(6).to_pylist(), float))
            kept = ~failed & (score >= (trees.cutoff if trees is not None else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(kept), pa.array(score)], schema=_OUT)

    return measured.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


_OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])
