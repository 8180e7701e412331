import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postloom.llm import bagminhash, linededup
from postloom.llm.base import table
from postloom.llm.shingles import layers

from .cases import awkward, empty


def bag(text):
    w = (text or "").encode().split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    return {(g, i) for g, n in Counter(grams).items() for i in range(n)}


def classes(rows):
    """Least id of each document's component, all pairs compared."""
    bags = {k: bag(t) for k, t in rows}
    up = {k: k for k in bags}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(bags)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = bags[a], bags[b]
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9:
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {k: top(k) for k in keys}


def planted():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(8, 150))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 9])):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    chain = [word() for _ in range(80)]
    for k in range(12):  # each near the next, the ends far apart
        chain = chain[3:] + [word() for _ in range(3)]
        out.append(" ".join(chain))
    return list(enumerate(out, 100))


def test_layers_are_the_multiset():
    texts = ["a b c d e f a b c d e f a b c d e", "a b", "", " \n", "x", None, "a b c d e"]
    found, counts = layers(pa.array([t or "" for t in texts]))
    assert counts.tolist() == [len(bag(t)) for t in texts]
    parts = np.split(found, np.cumsum(counts)[:-1])
    assert all(len(set(p.tolist())) == len(p) for p in parts)
    assert len(set(parts[0].tolist()) & set(parts[6].tolist())) == 1


def test_signatures_estimate_similarity():
    r = random.Random(1)
    a = [str(r.random()) for _ in range(300)]
    b = a[:270] + [str(r.random()) for _ in range(30)]
    found, counts = layers(pa.array([" ".join(a), " ".join(b)]))
    sig = bagminhash.signatures(found, counts, 2000)
    x, y = bag(" ".join(a)), bag(" ".join(b))
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.04 and (sig != 0).all()


@pytest.mark.parametrize("which", ["planted", "documents"])
def test_classes_by_brute_force(spark, sf, which):
    if which == "planted":
        docs = spark.createDataFrame([(k, t, "x") for k, t in planted()], "doc_id long, text string, label string")
    else:
        docs = table(spark, sf, "documents")
    want = classes([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()}
    assert got == want


def test_edges(spark):
    docs = awkward(spark)
    rows = bagminhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[11].class_id == by[12].class_id == 11 and by[11].n_copies == 2 and by[0].class_id == 0 and by[2].class_id == 2
    assert bagminhash.near_duplicates(empty(spark)).count() == 0


def runs_gone(rows, least=5):
    """Lines to delete, from all windows of all texts."""
    seqs = {}
    for d, t in rows:
        lines = t.split("\n")
        seqs[d] = [(i, s, len([w for w in s.encode().split()])) for i, s in enumerate(lines) if s.encode().split()]
    first = {}
    for d in sorted(seqs):
        s = seqs[d]
        for b in range(len(s)):
            for e in range(b, len(s)):
                first.setdefault(tuple(x[1] for x in s[b : e + 1]), (d, b))
    gone = {}
    for d, s in seqs.items():
        for b in range(len(s)):
            for e in range(b, len(s)):
                if sum(x[2] for x in s[b : e + 1]) >= least and first[tuple(x[1] for x in s[b : e + 1])] < (d, b):
                    short = sum(x[2] for x in s[b + 1 : e + 1]) < least or sum(x[2] for x in s[b:e]) < least
                    lines = range(s[b][0], s[e][0] + 1) if short else [x[0] for x in s[b : e + 1]]
                    gone.setdefault(d, set()).update(lines)
    return gone


def test_runs_by_brute_force(spark):
    r = random.Random(8)
    pool = ["one", "two words", "three words here", "a line of five words", "and one of six words here", "", "  "]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for k in range(40)]
    docs = spark.createDataFrame([(k, t, 7, "z") for k, t in rows], "doc_id long, text string, d long, _line_x string")
    gone = runs_gone(rows)
    for row in linededup.dedup_lines(docs).collect():
        t = dict(rows)[row.doc_id]
        want = "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone.get(row.doc_id, ()))
        assert row.text == want and row._line_gone == len(gone.get(row.doc_id, ())) and row.d == 7


def test_run_edges(spark):
    docs = awkward(spark)
    rows = linededup.dedup_lines(docs).collect()
    assert len(rows) == docs.count() and len(rows[0]) == len(docs.columns) + 2
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[10].text == "the quick brown fox jumps over the lazy dog" and by[10]._line_gone == 1
    assert by[11].text == by[12].text == "" and by[0].text is None and by[0]._line_total == 0
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_one_id_with_two_texts(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (1, "another text that has nothing to do with it at all"), (2, " ".join([*words[:39], "end"]))]
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_layers) for r in got) == [(1, 1, 7), (1, 1, 36), (2, 1, 36)]


def test_blocks_of_a_bucket_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 3)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(60)], []
    for k in range(40):
        w = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            w[r.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.class_id for x in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_a_text_of_many_lines(spark):
    import time

    lines = [f"line number {k} of a long text" for k in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["its own first line is here", *lines[40_000:], "x"]))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: (r._line_gone, r.text) for r in linededup.dedup_lines(docs).collect()}
    assert time.time() - began < 120
    assert got == {1: (0, "\n".join(lines)), 2: (60_000, "its own first line is here\nx")}
