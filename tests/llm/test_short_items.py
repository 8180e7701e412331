import random

from postloom.llm import decontam
from postloom.llm.base import table


def test_short_items_in_other_text(spark, sf):
    docs, bench = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", "text")
    short = [(r.item_id, r.text.split()) for r in bench.where("text is not null").orderBy("item_id").collect() if 15 <= len(r.text.split()) < 20]
    r, rows, want = random.Random(3), [], set()
    for row in docs.where("text is not null").orderBy("doc_id").collect():
        w = row.text.split()
        if len(w) > 100 and short:
            item, words = r.choice(short)
            at = r.randrange(len(w))
            rows.append((row.doc_id, " ".join(w[max(0, at - 200) : at] + words + w[at : at + 200])))
            want.add((row.doc_id, item))
    assert len(want) > 50
    got = {(x.doc_id, x.item_id) for x in decontam.pairs(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(want & got) >= 0.9 * len(want)
