import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postloom.llm import langid as L


def made(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(n))


def test_every_document_is_learned_from(spark):
    """Languages that only documents outside a former sample, and a text longer than one took, have."""
    r = random.Random(1)
    spans = spark.range(3000).select("id", F.xxhash64("id").alias("key"), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held"))
    ids = spans.orderBy("key").collect()
    fitted = [x.id for x in ids if not x.held]
    late, long = set(fitted[-60:]), fitted[5]
    assert len(fitted) > 2200
    rows = [(x.id, made(r, "opqrs", 30), "late") if x.id in late else (x.id, made(r, "ijklmn", 12_000), "long") if x.id == long else (x.id, made(r, "abcdefgh", 12), "most") for x in ids]
    docs = spark.createDataFrame(sorted(rows), "doc_id long, text string, lang string").repartition(5)
    field = L.train(docs)
    assert field.langs == ["late", "long", "most"]
    asked = [(0, made(r, "opqrs", 40)), (1, made(r, "ijklmn", 40)), (2, made(r, "abcdefgh", 40))]
    found = {x.doc_id: x.lang_pred for x in L.predict(spark.createDataFrame(asked, "doc_id long, text string"), field).collect()}
    assert found == {0: "late", 1: "long", 2: "most"}


def test_tasks_meet_and_repeat(spark, monkeypatch):
    """Several tasks on a table sorted by language give a field as good as one's, and the same again in another order."""
    r = random.Random(2)
    rows = [(k, made(r, "abcdefgh" if k < 400 else "efghijkl", 60), "x" if k < 400 else "y") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    monkeypatch.setattr(L, "LEAST_CHARS", 20_000)
    monkeypatch.setattr(L, "CHUNK_BYTES", 15_000)
    field, again = L.train(docs), L.train(docs.repartition(3).orderBy(F.desc("text")))
    assert np.array_equal(field.weights, again.weights) and np.array_equal(field.transitions, again.transitions)
    found = L.predict(docs, field).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang_pred = lang").count() > 790
    assert np.allclose(np.exp(field.transitions).sum(1), 1)


def test_a_step_goes_up():
    r = random.Random(3)
    texts, langs = [made(r, "abcd" if k % 2 else "cdef", 50) for k in range(200)], ["x" if k % 2 else "y" for k in range(200)]
    ascent = L.Ascent(["x", "y"])
    ascent.learn(pa.array(texts), langs, 4)
    words, at, doc = L.cores(pa.array(texts))
    p = ascent.field.marginals(ascent.field.emissions(words)[at], np.diff(doc, prepend=-1) > 0)
    right = p[np.arange(len(at)), [ascent.field.langs.index(langs[d]) for d in doc]]
    assert ascent.words == len(at) == 10_000 and right.mean() > 0.9
