import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from postloom.llm import langid as L
from postloom.llm import tok
from postloom.llm.packing import pack


class Captured(Exception):
    pass


def task_of(monkeypatch, docs, made):
    """The function that ``made`` gives its workers."""

    def capture(self, run, schema):
        raise Captured(run)

    monkeypatch.setattr(type(docs), "mapInArrow", capture)
    with pytest.raises(Captured) as e:
        made()
    return e.value.args[0]


def test_language_tasks_let_the_encoder_go(spark, monkeypatch):
    """A worker that packed before doesn't hold its encoder beside the language model."""
    docs = spark.createDataFrame([(k, "some words of a text", "en") for k in range(10)], "doc_id long, text string, lang string")
    field = L.blank(["en"])
    rows = {"doc_id": pa.array([1], pa.int64()), "text": pa.array(["some words"]), "lang": pa.array(["en"])}
    for made, batch in (
        (lambda: L.train(docs), {**rows, "key": pa.array([5], pa.int64())}),
        (lambda: L.predict(docs, field), rows),
        (lambda: L.keep(docs, field, 0.3), rows),
    ):
        run = task_of(monkeypatch, docs, made)
        monkeypatch.setitem(tok._ENCODERS, "kept", object())
        assert list(run(iter([pa.RecordBatch.from_pydict(batch)])))
        assert not tok._ENCODERS


def test_a_chunk_of_many_words_is_learned_in_bounded_memory():
    r = random.Random(4)
    texts = pa.array([" ".join("".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(2000)) for _ in range(100)])
    ascent = L.Ascent(["x", "y"])
    tracemalloc.start()
    ascent.learn(texts, ["x", "y"] * 50, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ascent.words == 200_000 and peak < 90e6, peak


def test_features_by_parts_are_those_of_all(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choices("abcdéß'", k=r.randint(0, 9))) for _ in range(501)]
    whole = L.by_word(words)
    monkeypatch.setattr(L, "FEATURE_WORDS", 100)
    parts = L.by_word(words)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts)) and len(whole[1]) == 501
    assert [len(x) for x in L.by_word([])] == [0, 0]


def test_packed_ids_are_those_of_the_pieces(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * (7 * k)) for k in range(60)], "doc_id long, text string").coalesce(2)
    rows = pack(docs, with_ids=True).collect()
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert all(len(r.input_ids) == r.length and zlib.crc32(np.array(r.input_ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
