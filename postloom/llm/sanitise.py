"""Personal data and what gives it away (operator 4), with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and telephone numbers.  Each
distinct value is a protected entity.  The words of a text with an entity are terms that
may give it away, however far they stand from it.  The corpus estimates how much: with p
over documents, a term t discloses an entity e where

    PMI(t; e) = log2( p(t, e) / (p(t) p(e)) )  >=  alpha * IC(e) = -alpha * log2 p(e)

and at least ``support`` documents have both.  Such terms are further spans (kind
``term``) wherever they stand in a document with that entity: masking the entity alone
would leave it readable from them.

Pairs are counted over whole documents.  As p(t, e) is at most p(e), a pair can hold only
where n_t <= N ** (1 - alpha) * n_e ** alpha, and support needs as many documents of
either; other pairs are not made, which loses none that the bound admits.  ``sanitise`` generalises base spans to their kind and removes
the terms.

Lists are taken apart by ``explode_outer``: for ``explode`` Spark adds a filter on the list's
size, for which it makes the list anew, expression within expression.

Positions are code points, end exclusive.  Matches are found by splitting at them and
summing lengths; the patterns begin only where a run of their characters begins or the
last match ended, so that long runs stay linear.

Nulls: a null text is empty (and stays null when sanitised); a null ``doc_id`` is kept.
Empty texts have no spans.  Very long texts are read whole.  Spans of different kinds may
overlap and are all reported; where they do, ``sanitise`` masks the one that begins first.  Repeated rows get equal
results and count as documents.  An empty table gives no rows.  Extra columns are
ignored, or kept by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a kind can't occur.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"\p{L}{3,}"
ALPHA, SUPPORT = 0.9, 3
_BLOCK = 200


def _running(lengths: Column) -> Column:
    """Sums of the lengths before each place, in blocks so that long lists stay cheap."""
    empty = F.array().cast("array<bigint>")

    def block(b: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("s"), empty.alias("a"))
        return F.aggregate(F.slice(lengths, b + 1, _BLOCK), start, lambda acc, n: F.struct((acc.s + n).alias("s"), F.concat(acc.a, F.array(acc.s)).alias("a")))

    def shift(blocks: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<array<bigint>>").alias("a"))
        return F.aggregate(blocks, start, lambda acc, z: F.struct((acc.s + z.s).alias("s"), F.concat(acc.a, F.array(F.transform(z.a, lambda v: v + acc.s))).alias("a")))

    n = F.size(lengths)
    return F.when(n == 0, empty).otherwise(F.flatten(shift(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(_BLOCK)), block)).a))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda s: F.length(s).cast("bigint"))


def found(df: DataFrame, text: str, pattern: str, out: str, needs: Column | None = None) -> DataFrame:
    """Adds ``out``: array of (text, start, end) of the pattern's leftmost non-overlapping matches."""
    none = F.array().cast("array<string>")
    has = F.lit(True) if needs is None else needs
    hits = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    df = df.withColumn("_hits", hits)
    gaps = F.when(F.size("_hits") > 0, F.split(text, pattern, -1)).otherwise(none)
    df = df.withColumn("_gaps", _lengths(gaps)).withColumn("_sizes", _lengths(F.col("_hits")))
    # from one match's start to the next: its own length and the gap after it
    df = df.withColumn("_steps", F.zip_with("_sizes", F.slice("_gaps", 2, F.greatest(F.size("_sizes"), F.lit(1))), lambda a, b: a + F.coalesce(b, F.lit(0))))
    df = df.withColumn("_starts", F.transform(_running(F.col("_steps")), lambda s: s + F.coalesce(F.get("_gaps", 0), F.lit(0))))
    spans = F.zip_with("_hits", "_starts", lambda h, s: F.struct(h.alias("text"), s.alias("start"), (s + F.length(h)).alias("end")))
    return df.withColumn(out, spans).drop("_hits", "_gaps", "_sizes", "_steps", "_starts")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, "\\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.when((n >= 16) & (n <= 19), _luhn(digits)).otherwise(False)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column per kind: array of (text, start, end); ``text`` without nulls."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        needs = F.contains(F.col("text"), F.lit(NEEDS[kind])) if kind in NEEDS else F.col("text").rlike("[0-9](?:[\\x20-]?[0-9]){15}")
        out = found(out, "text", PATTERNS[kind], kind, needs)
        out = out.withColumn(kind, F.filter(kind, _keeps(kind)))
    return out


def _keeps(kind: str):
    return lambda z: _valid(kind, z.text)


def _named(kind: str) -> Column:
    return F.transform(kind, lambda z: F.concat_ws(":", F.lit(kind), z.start, z.end))


def _value(kind: str, hit: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(hit) if kind in ("email", "ip") else F.regexp_replace(hit, "[^0-9]", ""))


def _blanked(text: str) -> Column:
    """The text with each e-mail address put as so many zeros; the other kinds have no letters."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    gaps = F.split(text, PATTERNS["email"], -1)
    blank = F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.repeat(F.lit("0"), F.length(h)), F.lit("")))), "")
    return F.when(F.contains(F.col(text), F.lit("@")), blank).otherwise(F.col(text))


def _with_words(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words``: array of (text, start, end) of the words of three letters or more of ``text`` outside its e-mail addresses."""
    df = df.withColumn("_blank", _blanked(text))
    return found(df, "_blank", TERM, "words", F.col("_blank") != "").drop("_blank")


def _key() -> Column:
    """What a row's spans depend on."""
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))


def disclosing(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """A row per document with its base spans, ``term`` spans (array of start, end, in order) and its key.

    Terms are words of three letters or more of documents that have an entity.
    """
    every = F.concat(*(_entities(k) for k in KINDS))
    spanned = base_spans(docs.select("doc_id", "text", _key().alias("key")))
    held = materialise(spanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", *KINDS, F.when(F.size(every) > 0, F.col("text")).alias("text")), "spans")
    total = held.count()
    values = held.where("text is not null").select("row", F.explode_outer(F.array_distinct(F.transform(every, lambda e: e.value))).alias("entity"))
    of_entity = materialise(values.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support), "entities")
    # the most documents a term may be in, for each entity of each document
    bound = F.lit(float(max(total, 1))) ** (1 - alpha) * F.col("n_e") ** alpha + 1e-6
    who = materialise(values.join(of_entity, "entity").select("row", "entity", "n_e", bound.alias("most")), "who")
    rows = held.join(who.groupBy("row").agg(F.max("most").alias("most")), "row").select("row", "text", "most")
    worded = _with_words(rows, "text").select("row", "most", F.explode_outer(F.array_distinct(F.transform("words", lambda w: F.lower(w.text)))).alias("term")).where("term is not null")
    terms = docs.select(F.explode_outer(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term")).where("term is not null")
    of_term = materialise(terms.groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support), "terms")
    rare = worded.join(of_term, "term").where(F.col("n_t") <= F.col("most")).select("row", "term", "n_t")
    met = materialise(rare.join(who, "row").where(F.col("n_t") <= F.col("most")).select("row", "entity", "term", "n_t", "n_e"), "pairs")
    counted = met.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")).where(F.col("both") >= support)
    ic = F.log2(total / F.col("n_e"))
    pmi = F.log2(F.col("both") * total / (F.col("n_t") * F.col("n_e")))
    telling = counted.where((ic > 0) & (pmi >= alpha * ic)).select("entity", "term")
    told = materialise(met.join(telling, ["entity", "term"]).select("row", "term").distinct(), "told")
    # words are looked for again only where some are telling
    again = _with_words(held.join(told.select("row").distinct(), "row", "left_semi").select("row", "text"), "text")
    placed = again.select("row", F.explode_outer("words").alias("w")).where("w is not null").select("row", F.lower("w.text").alias("term"), F.struct("w.start", "w.end").alias("span"))
    spans = placed.join(told, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("term"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return held.select("row", "doc_id", "key", *KINDS).join(spans, "row", "left").select("doc_id", *KINDS, F.coalesce("term", none).alias("term"), "key")


def _entities(kind: str) -> Column:
    return F.transform(kind, lambda z: F.struct(_value(kind, z.text).alias("value"), z.start.alias("start"), z.end.alias("end")))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans as text, and the numbers of terms and of all spans."""
    rows = disclosing(docs, **options)
    base = F.concat(*(_named(k) for k in KINDS))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _named("term")), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        F.size(F.concat(base, _named("term"))).cast("long").alias("n_spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (label, start, end; in order, none overlapping) put as its label."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    part = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    done = F.aggregate(
        F.filter(spans, lambda z: z.start >= 0),
        start,
        lambda acc, z: F.when(z.start >= acc["at"], F.struct(F.concat(acc["out"], part(acc["at"], z.start), z.label).alias("out"), z.end.alias("at"))).otherwise(acc),
    )
    return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text)))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans generalised to their kind in brackets and telling terms removed.

    Spans find their rows by doc_id and text, of which equal rows have equal spans.
    """
    rows = disclosing(docs.select("doc_id", "text"), **options)
    label = lambda k: F.transform(k, lambda z: F.struct(z.start.alias("start"), z.end.alias("end"), F.lit("" if k == "term" else f"[{k.upper()}]").alias("label")))
    spans = rows.select(F.col("key").alias("_own"), F.array_sort(F.concat(*(label(k) for k in (*KINDS, "term")))).alias("_spans"))
    spans = spans.where(F.size("_spans") > 0).dropDuplicates(["_own"])
    joined = docs.withColumn("_key", _key()).join(spans, F.col("_key").eqNullSafe(F.col("_own")), "left")
    return joined.withColumn("text", F.when(F.col("_own").isNotNull(), masked(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))).select(*docs.columns)
