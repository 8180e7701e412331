import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postloom.llm import dac, packing
from postloom.llm.base import shared_dir, table
from postloom.llm.tok import Encoder

from .cases import awkward, empty

HARD = ["", "a", " a", "a ", "a  b", "a \n b", "x\ty", "it's I'll don't", "日本語 テキスト です", "a\x00b c", "\x00", "<|endoftext|> hi", "12 34²", "\x1c a\x1cb", "😀 😀a", "a\n\n b\n", "É_é __ b-c", "x​x   y", "word, word. (word) word) a.b", "9,9 x! ?"]


@pytest.fixture(scope="module")
def enc():
    return Encoder(max_pieces=50)


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_pieces_are_what_the_library_gives(enc):
    for _ in range(2):
        assert split(*enc.encode(pa.array(HARD))) == [enc.whole(t) for t in HARD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé .,\n\t \u0085日1²_-\x00\x1c", max_size=30), min_size=1, max_size=8))
def test_any_text(texts):
    own = Encoder(max_pieces=20)
    assert split(*own.encode(pa.array(texts, pa.string()))) == [own.whole(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    raw = dac.to_bytes([1], np.array([len(ids)]), np.array(ids, np.uint32))
    file = dac.File(raw)
    assert file.codes.all().tolist() == ids
    places = np.arange(len(ids))[::-1]
    assert not len(ids) or file.codes.at(places).tolist() == ids[::-1]
    assert file.document(0).tolist() == ids


def want_ids(enc, docs, end):
    return [(r.doc_id, [*enc.whole(r.text or ""), end]) for r in docs.collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_in_order_from_the_files(spark, sf, enc):
    docs = table(spark, sf, "documents")
    at = 0
    got = {r.doc_id: r for r in dac.round_trip(docs).collect()}
    for d, ids in sorted(want_ids(enc, docs, 2)):
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert dac.round_trip(empty(spark)).count() == 0
    rows = dac.round_trip(awkward(spark)).collect()
    assert sorted(r.ids_crc32 for r in rows) == sorted(crc(i) for _, i in want_ids(enc, awkward(spark), 2))
    ends = sorted((r.start, r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_a_repeated_task_leaves_only_whole_files(spark):
    path = shared_dir(spark, "dac-test")
    dac.write(awkward(spark), path)
    assert dac.read(spark, path).count() == awkward(spark).count()


def check_packing(rows, want):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
    full = [sum(r.length for r in p) for p in by_seq.values()]
    assert all(n == 1024 or n & (n - 1) == 0 for n in full)
    for d, ids in want.items():
        parts = sorted(by_doc[(d, len(ids))], key=lambda r: r.start)
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    return full


def test_packing(spark, sf, enc):
    docs = table(spark, sf, "documents")
    full = check_packing(packing.pack(docs).collect(), dict(want_ids(enc, docs, 0)))
    assert sum(n != 1024 for n in full) <= 10 * 4
    own = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1)
    check_packing(packing.pack(own, block_tokens=500).collect(), dict(want_ids(enc, own, 0)))
    assert packing.pack(awkward(spark)).count() >= awkward(spark).count() and packing.pack(empty(spark)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_filling_is_the_best(lengths, room):
    import itertools

    counts = {n: lengths.count(n) for n in lengths}
    best, taken = packing.best_filling(counts, room)
    sums = {sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k)}
    assert best == max(s for s in sums if s <= room) == sum(n * k for n, k in taken.items())
    assert all(k <= counts[n] for n, k in taken.items())


def test_a_document_is_read_alone():
    r = np.random.default_rng(2)
    ids = r.choice([3, 200, 256, 70_000, 20_000_000], 5000).astype(np.uint32)
    codes = dac.Codes(dac.encode_levels(ids))
    for a, b in ((0, 0), (0, 1), (511, 513), (7, 4999), (4999, 5000), (0, 5000), (1024, 1024)):
        assert codes.between(a, b).tolist() == ids[a:b].tolist()


def test_words_go_one_by_one_where_tokens_span_them():
    e = Encoder()
    texts = pa.array(["one two, three four five", "à la carte é b"])
    want = e.encode(texts)
    assert e.in_rows
    slow = Encoder()
    slow.in_rows = False
    got = slow.encode(texts)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
