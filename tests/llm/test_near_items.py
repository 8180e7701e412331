import random
from unittest import mock

import numpy as np
import pyarrow as pa

from postloom.llm import decontam as D

from .test_whole_fit import texts


def test_cosines_by_brute_force():
    """Each window of each span against the items; windows' products are sums of their steps'."""
    r, rows = np.random.default_rng(5), texts(60, 4)
    table = np.asfortranarray(r.standard_normal((D.TERMS, 12)).astype(np.float32))
    latent = D._unit(r.standard_normal((7, 12)).astype(np.float32))
    h, counts = D._hashes(pa.array(rows))
    first, want = np.cumsum(counts) - counts, {}
    for span, items in ((3, 7), (1, 3), (2, 3)):
        at = 0
        for d, n in enumerate((-(-counts // D.STEP)).tolist()):
            for s in range(n):
                if s <= n - span or s == 0:
                    lo = first[d] + s * D.STEP
                    x = D._unit(table[D._terms(h[lo : min(lo + span * D.STEP, first[d] + counts[d])])].sum(0)[None])
                    want |= {(span, at + s, i): c for i, c in enumerate((x @ latent[:items].T)[0].tolist()) if c >= 0.3}
            at += n
    with mock.patch.object(D, "SIMILARITIES", 500), mock.patch.object(D, "CANDIDATES", 20):
        got = {(span, w, i): c for span, *x in D._near(h, counts, table, latent, 3, 0.3) for w, i, c in zip(*(y.tolist() for y in x))}
    assert got.keys() == want.keys() and len(got) > 50 and all(abs(got[k] - want[k]) < 1e-4 for k in got)


def test_shared_words_by_brute_force():
    r = random.Random(6)
    items = [[r.randrange(60) for _ in range(r.choice([0, 1, 15, 40, 300]))] for _ in range(25)]
    h = np.array([r.randrange(90) for _ in range(2000)], np.uint64)
    begin = np.array([r.randrange(1900) for _ in range(400)])
    end = np.minimum(begin + np.array([r.choice([0, 3, 80, 400]) for _ in begin]), len(h))
    own = np.array([r.randrange(25) for _ in begin])
    with mock.patch.object(D, "STRETCHES", 700):
        got = D._Words(items).shared(h, begin, end, own)
    assert got.tolist() == [sum(x in set(h[a:b].tolist()) for x in items[i]) for a, b, i in zip(begin, end, own)]
    assert D._Words([[], []]).shared(h, begin[:2], end[:2], np.array([0, 1])).tolist() == [0, 0]


def test_words_are_counted_before_they_are_compared(spark):
    """Of windows near an item only those that hold enough of its words are compared in order."""
    r = random.Random(7)
    pool = [f"w{k}" for k in range(60)]
    rows = [" ".join(r.choice(pool) for _ in range(300)) for _ in range(20)]
    items = [(k, " ".join([*(f"own{k}x{j}" for j in range(12)), *r.sample(pool, 12)])) for k in range(10)]
    rows[3] = rows[3] + " " + items[4][1]
    docs = pa.record_batch({"doc_id": pa.array(range(20), pa.int64()), "text": pa.array(rows)})
    fold = np.random.default_rng(8).standard_normal((D.TERMS, 16)).astype(np.float32)
    frame = mock.Mock(schema=None, mapInArrow=lambda run, schema: run)
    frame.sparkSession.sparkContext.broadcast = lambda value: mock.Mock(value=value)
    with mock.patch.object(D, "common", side_effect=D.common) as common:
        (out,) = D._match(frame, items, fold, -1.0, D.OVERLAP, D.ANSWER, D.SURE)(iter([docs]))
    assert list(zip(out["doc_id"].to_pylist(), out["item_id"].to_pylist())) == [(3, 4)]
    assert 0 < common.call_count < 50
