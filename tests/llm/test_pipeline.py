import corpus_pipeline
from postloom.llm import queries
from postloom.llm.base import table

from .cases import DOCS


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


def test_stages_one_by_one(spark, sf):
    docs = start = table(spark, sf, "documents")
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), start.schema)
        assert docs.columns == start.columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * start.count()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {"doc_id", "sequence_id", "offset", "input_ids"} <= set(rows.columns)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_take_odd_documents(spark, sf):
    from .cases import awkward

    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), DOCS)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


def test_line_runs_same_as_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES["op3_line_runs"](spark, sf).collect()
    want = c.execute("SELECT doc_id, n_lines, n_deleted, text FROM (" + queries.ORACLES["op3_line_runs"] + ")").fetchall()
    assert sorted((r.doc_id, r.n_lines, r.n_deleted, r.text) for r in got) == sorted(want)


def test_rows_without_an_id_and_repeated_rows(spark, sf):
    docs = table(spark, sf, "documents")
    item = table(spark, sf, "benchmark").where("length(text) > 150").orderBy("item_id").first().text
    some = [r.asDict() for r in docs.where("length(text) between 400 and 4000").orderBy("doc_id").limit(60).collect()]
    texts = [r.text for r in docs.where("length(text) between 400 and 4000").orderBy("doc_id").limit(90).collect()][60:]
    words = texts[0].split(" ")
    planted = [
        {**some[0], "doc_id": None, "text": " ".join(t.split(" ")[::-1])} for t in texts[1:4]  # without an id, different
    ] + [{**some[0], "doc_id": 7_000_000, "text": " ".join(words[::-1])}] * 3 + [{**some[0], "doc_id": None, "text": " ".join([*texts[5].split(" ")[:60], item, *texts[5].split(" ")[60:]])}]
    out = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in some + planted], docs.schema)
    out = out.coalesce(1)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, sf).collect(), docs.schema)
    left = out.collect()
    assert sum(r.doc_id == 7_000_000 for r in left) == 1
    assert sum(r.doc_id is None for r in left) == 3 and not any(item in r.text for r in left)
    assert len(left) > 30


def test_run_is_the_stages_in_turn(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, sf)).collect(), out.schema)
    cols = ["doc_id", "start", "length", "ids_crc32"]
    whole = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()))
    assert whole(corpus_pipeline.run(spark, sf).select(*cols, "doc_tokens")) == whole(docs.select(*cols, "doc_tokens"))
