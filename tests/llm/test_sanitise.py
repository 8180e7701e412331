import hashlib
import re

import pytest
from pyspark.sql import functions as F

from postloom.llm import sanitise
from postloom.llm.base import table

from .cases import awkward, empty

EXTRA = [
    "1.2.3.4.5 999.1.1.1 001.02.3.255 256.1.1.1 12.34.56", "a" * 5000 + "@ b@c x@y.z..w q@@r.s a@b.c_d@e.f", "..+%@a-b.c-d. -@-.-",
    "+1234567 +12345678 +123456789012345 +1234567890123456 ++1 2-3(4)5.6 7 8 9x +(1)", "4111-1111-1111-1111 4111  1111 41111111111111112 6011000990139424 1 2 3",
    "9" * 5000, "7 " * 300, "x+49 (30) 1234-5678.", "éé a@b.cd\n1.1.1.1\r\n+1 555 010 9999\n5105105105105100é",
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def base(text):
    text = text or ""
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


def check(rows):
    for r in rows:
        want = base(r.text)
        names = [f"{k}:{a}:{b}" for k in sanitise.KINDS for a, b in want[k]]
        assert [len(want[k]) for k in sanitise.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone], r.text[:200]
        assert hashlib.sha256(",".join(names).encode()).hexdigest() == r.base_sha256, (r.text[:200], r.spans, names)
        assert r.spans == ",".join(names) or r.spans.startswith(",".join([*names, "term"]))


def test_base_spans_by_brute_force(spark, sf):
    docs = awkward(spark, EXTRA).where("doc_id is not null").dropDuplicates(["doc_id"])
    assert len(docs.columns) == 8
    check(sanitise.report(docs).join(docs.select("doc_id", "text"), "doc_id").collect())
    docs = table(spark, sf, "documents")
    check(sanitise.report(docs).join(docs.select("doc_id", "text"), "doc_id").collect())


def test_nulls_and_empty(spark):
    assert sanitise.report(awkward(spark)).count() == awkward(spark).count()
    assert sanitise.report(empty(spark)).count() == 0


def test_a_word_that_only_goes_with_an_entity_discloses_it(spark):
    texts = ["Zanzibarian office writes from boss@corp.example today please"] * 3 + [f"today please the office writes about item number {k}" for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in sanitise.report(docs).collect()}
    spans = rows[0].spans.split(",")
    assert spans[0].startswith("email:") and "term:0:11" in spans
    assert not any(s == f"term:{texts[0].index('office')}:{texts[0].index('office') + 6}" for s in spans)
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert "Zanzibarian" not in clean[0] and "boss@" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10]


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201, 1003])
def test_running_sums(spark, n):
    got = spark.range(1).select(sanitise._running(F.lit([3] * n).cast("array<bigint>") if n else F.array().cast("array<bigint>")).alias("a")).first()[0]
    assert got == [3 * k for k in range(n)]


def test_long_domains_and_many_entities(spark):
    import time

    long = "a@" + "b." * 100_000 + "c"
    many = " ".join(f"word{chr(97 + k % 26)}x name{k}@mail.example" for k in range(5000))
    docs = spark.createDataFrame([(1, long), (2, many), (3, many), (4, many), (5, "other text")], "doc_id long, text string")
    began = time.time()
    rows = {r.doc_id: r for r in sanitise.report(docs).collect()}
    assert time.time() - began < 90
    assert rows[1].n_email == 1 and rows[1].spans == f"email:0:{len(long)}" and rows[2].n_email == 5000 and rows[2].spans == rows[3].spans


def test_rows_of_one_id_or_of_none_are_masked_each(spark):
    docs = spark.createDataFrame([(1, "a@b.co x"), (1, "y c@d.co"), (1, "a@b.co x"), (None, "z e@f.co"), (None, None), (2, None), (2, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text or "-") for r in sanitise.sanitise(docs).collect()))
    assert got == [(0, "-"), (0, "z [EMAIL]"), (1, "[EMAIL] x"), (1, "[EMAIL] x"), (1, "y [EMAIL]"), (2, "-"), (2, "-")]
