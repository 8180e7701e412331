import random

import numpy as np
import pyarrow as pa

from postloom.llm import decontam as D


def dense(texts, idf):
    rows = D._sparse(*D._hashes(pa.array(texts)), idf)
    out = np.zeros((len(rows), D.TERMS))
    for k, (t, w) in enumerate(rows):
        out[k, t] = w
    return out


def texts(n, seed):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    many = [" ".join(r.choice(pool[: r.choice([5, 40, 400])]) for _ in range(r.choice([0, 1, 15, 16, 17, 33, 48, 49, 100, 130]))) for _ in range(n)]
    return [*many, "again " * 200, ""]


def test_products_by_brute_force():
    r, rows = np.random.default_rng(3), texts(60, 1)
    idf, z = r.random(D.TERMS).astype(np.float32), r.standard_normal((D.TERMS, 9)).astype(np.float32)
    a, total = dense(rows, idf), np.zeros((D.TERMS, 9), np.float32)
    D.products(*D._hashes(pa.array(rows)), idf, z, total)
    want = a.T @ (a @ z)
    assert np.abs(idf[:, None] * total - want).max() < 1e-4 * np.abs(want).max()


def test_every_document_is_fitted_on(spark):
    """More documents than a former sample had: the model is that of all of them."""
    rows, own = texts(900, 2), ["one item of some words w1 w2 w3", "w7 " * 20 + "and another"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(k, t) for k, t in enumerate(own)], "item_id long, text string")
    df, n = D.frequencies(docs)
    idf = np.log((n + 1) / (df + 0.5)).clip(0).astype(np.float32)
    z = D.start(items, idf, 2)
    a = dense([*rows, *own], idf)
    vectors, sigma = D.nystrom(z, a.T @ (a @ z), D.RANK)
    ((_, fold),) = D._blocks(docs, items)
    want = idf[:, None] * vectors / sigma
    assert np.abs(fold @ fold.T[:, :50] - want @ want.T[:, :50]).max() < 0.02 * np.abs(want @ want.T[:, :50]).max()
