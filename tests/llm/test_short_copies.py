import random

import pytest

from postloom.llm import bagminhash

from .test_duplicates import classes


@pytest.mark.parametrize("end", ["front", "back"])
def test_a_word_more_than_eight_by_brute_force(spark, end):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for n in (6, 7, 8, 9, 12):
        for _ in range(8):
            w = [word() for _ in range(n)]
            rows += [w, [word(), *w] if end == "front" else [*w, word()]]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    want = classes(rows)
    assert sum(k != c for k, c in want.items()) == 24  # 8 words and more
    got = {x.doc_id: x.class_id for x in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
