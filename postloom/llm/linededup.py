"""Repeated runs of lines (operator 3), with DataFrame functions only.

A text's lines with a word are a sequence of line ids.  Prefix doubling names the
suffixes' prefixes: a prefix of 2**k lines gets its name from the names of its two
halves, and a prefix of any length from two overlapping ones.  In a suffix array, the
suffixes that share their first m lines are an interval whose longest common
prefixes are at least m; equal names of length m are that interval, so it is found by
a grouping and no global order has to be made.

A run counts if it has ``min_words`` words.  For each line the shortest such runs that
begin there and that end there are looked up; a longer repeated run is covered by
overlapping ones of these, so their union is the union of all maximal repeated runs.
The first copy, by (doc_id, line), stays; later copies are deleted.  A blank line goes if
it is inside one of the shortest runs.  Copies within one text count.

Nulls: a null text has no lines and stays null; a null ``doc_id`` comes first in order.
Rows equal in doc_id and text are one document: each gets its result.  Empty texts
stay.  Very long texts are read whole.  An empty table gives no rows.  Other columns
stay as they are; the operator's own begin with ``_line_`` while it works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise

MIN_WORDS = 5
_LOWEST = -(2**63)
_SHIFT = 2**31


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))


def _doubled(half: str, size: int) -> Column:
    """Names of the runs of ``size`` lines from those of half the size."""

    def name(p: Column) -> Column:
        one, two = F.get(half, p - 1), F.get(half, p - 1 + size // 2)
        return F.struct(F.xxhash64(one.x, two.x).alias("x"), F.xxhash64(F.lit(1), one.y, two.y).alias("y"))

    return F.transform(F.sequence(F.lit(1), F.col("n") - (size - 1)), lambda p: name(p))


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per shortest run: doc, text's hash, lines from and upto, and the run's name (x, y)."""
    halves = [1 << k for k in range(1, min_words.bit_length()) if 1 << k <= min_words]
    rows = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("d"), F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.select("d", "t", F.filter(F.transform("lines", lambda s, i: F.struct(i.alias("i"), _words(s).alias("w"), F.xxhash64(s).alias("x"), F.xxhash64(F.lit(1), s).alias("y"))), lambda z: z.w > 0).alias("s"))
    rows = rows.withColumn("n", F.size("s")).where("n > 0")
    name = "n1"
    rows = rows.withColumn(name, F.transform("s", lambda z: F.struct(z.x.alias("x"), z.y.alias("y"))))
    names = {1: name}
    for size in halves:
        own = f"n{size}"
        rows = rows.withColumn(own, F.when(F.col("n") >= size, _doubled(names[size // 2], size)))
        names[size] = own
    spans = F.sequence(F.lit(1), F.col("n"))

    def words_in(b: Column, e: Column) -> Column:
        return F.aggregate(F.slice("s", b, e - b + 1), F.lit(0), lambda a, z: a + z.w)

    def onward(p: Column) -> Column:  # the least end of a run that begins at p
        return F.get(F.filter(F.sequence(p, F.least(F.col("n"), p + (min_words - 1))), lambda e: words_in(p, e) >= min_words), 0)

    def back(p: Column) -> Column:  # the largest begin of a run that ends at p
        return F.get(F.filter(F.sequence(p, F.greatest(F.lit(1), p - (min_words - 1)), F.lit(-1)), lambda b: words_in(b, p) >= min_words), 0)

    heavy = lambda p: F.get("s", p - 1).w >= min_words
    found = F.concat(
        F.transform(spans, lambda p: F.struct(p.alias("b"), F.when(heavy(p), p).otherwise(onward(p)).alias("e"))),
        F.filter(F.transform(spans, lambda p: F.struct(F.when(~heavy(p), back(p)).alias("b"), p.alias("e"))), lambda z: z.b.isNotNull()),
    )
    # a run as one number, of which an array's distinct ones are found by hashing
    coded = F.array_distinct(F.transform(F.filter(found, lambda z: z.e.isNotNull()), lambda z: z.b.cast("long") * _SHIFT + z.e))

    def key(c: str, b: Column, e: Column, m: Column) -> Column:
        out = None
        for size in sorted(names, reverse=True):
            one = F.xxhash64(m, F.get(names[size], b - 1)[c], F.get(names[size], e - size)[c])
            out = F.when(m >= size, one) if out is None else out.when(m >= size, one)
        return out

    def run(z: Column) -> Column:
        b, e = z.b, z.e
        m = e - b + 1
        return F.struct(b.alias("b"), F.get("s", b - 1).i.alias("from"), F.get("s", e - 1).i.alias("upto"), key("x", b, e, m).alias("x"), key("y", b, e, m).alias("y"))

    split = F.transform(coded, lambda r: F.struct(F.shiftright(r, 31).cast("int").alias("b"), r.bitwiseAND(F.lit(_SHIFT - 1)).cast("int").alias("e")))
    # runs are whole before they are taken apart, so that no row carries the text's lists; explode would make the list twice
    rows = rows.withColumn("split", split).select("d", "t", F.transform("split", run).alias("r")).select("d", "t", F.explode_outer("r").alias("r"))
    return rows.where("r is not null").select("d", "t", "r.*")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, t, gone: the line numbers (from 0) to delete in the documents that have any."""
    rows = materialise(windows(docs, min_words), "runs")
    firsts = rows.groupBy("x", "y").agg(F.min(F.struct("d", "t", "b")).alias("first"), F.count("*").alias("n")).where("n > 1").select("x", "y", "first")
    firsts = materialise(firsts, "firsts")  # else the join takes over its exchange, and a hot run can't be split
    later = rows.join(firsts, ["x", "y"]).where(F.struct("d", "t", "b") > F.col("first"))
    lines = later.select("d", "t", "from", "upto").distinct()
    return lines.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("from", "upto"))))).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text cleaned, and ``_line_total`` and ``_line_gone`` counts."""
    gone = later_copies(docs, min_words).select(F.col("d").alias("_line_d"), F.col("t").alias("_line_t"), F.col("gone").alias("_line_list"))
    keyed = docs.withColumn("_line_d", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("_line_t", F.xxhash64("text"))
    rows = keyed.join(gone, ["_line_d", "_line_t"], "left")
    lines = F.split("text", "\n", -1)
    # the lines that stay, by number
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_line_list")
    marked = F.array_join(F.transform(F.array(F.struct(lines.alias("s"), stay.alias("at"))), lambda z: F.array_join(F.transform(z["at"], lambda i: F.get(z["s"], i)), "\n")), "")
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    rows = rows.withColumn("_line_total", total.cast("long")).withColumn("_line_gone", F.coalesce(F.size("_line_list"), F.lit(0)).cast("long"))
    rows = rows.withColumn("text", F.when(F.col("_line_list").isNull(), F.col("text")).otherwise(marked))
    return rows.select(*docs.columns, "_line_total", F.greatest("_line_gone", F.lit(0)).alias("_line_gone"))


ORACLE = """
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM a),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l WHERE w > 0),
p AS (SELECT x.doc_id, x.j AS b, y.j AS e, x.i AS f, y.i AS u FROM s x JOIN s y ON x.doc_id = y.doc_id AND y.j BETWEEN x.j AND x.j + 4 AND y.c - x.c + x.w >= 5),
m AS (SELECT doc_id, b, min(e) AS e FROM p GROUP BY doc_id, b UNION SELECT doc_id, max(b) AS b, e FROM p GROUP BY doc_id, e),
r AS (SELECT m.doc_id, m.b, m.e, min(s.i) AS f, max(s.i) AS u, string_agg(s.line, chr(10) ORDER BY s.j) AS run FROM m JOIN s ON s.doc_id = m.doc_id AND s.j BETWEEN m.b AND m.e GROUP BY m.doc_id, m.b, m.e),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, b) AS nth FROM r),
g AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN k ON k.doc_id = l.doc_id AND l.i BETWEEN k.f AND k.u WHERE k.nth > 1),
c AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_deleted, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_deleted, 0) AS BIGINT) AS n_deleted, c.text FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
"""
