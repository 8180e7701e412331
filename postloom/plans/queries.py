"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..operators import answers as A
from ..operators import catalogue as C
from ..operators import headers as H
from ..operators import prompts as P
from ..schemas import ATTACHMENTS
from ..session import shared_folder, ship
from ..sources import mail
from ..sources.client import FakeClient, call
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column) -> Column:
    return c.cast("long")


# --- messages made from the tables -----------------------------------------------------------

_DOC_HEADERS = [
    ("received", "by mx"), ("from", "Desk <desk@example.com>"), ("authentication-results", "spf=pass"), ("To", "not lower case"),
    ("authentication-results", "spf=fail"), ("arc-seal", "i=1"), ("arc-seal", "i=2"), ("x-priority", "1"), ("list-id", "news"), (" subject", "blank before"),
]


def _headers() -> Column:
    fixed = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in _DOC_HEADERS]
    return F.array(*fixed, F.struct(F.lit("subject").alias("key"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("value")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages; a page of the same id is the message's page."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    name = F.concat(F.col("source"), F.lit(".txt"))
    items = F.array(F.struct(name.alias("filename"), F.lit("text/plain").alias("contentType")), F.struct(F.lit(None).cast("string").alias("filename"), F.lit("").alias("contentType")))
    joined = docs.join(pages, docs.doc_id == pages.page_id, "left")
    return joined.select(F.col("doc_id").cast("string").alias("message_id"), "doc_id", _headers().alias("headers"), items.alias("attachments"), "text", "html")


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("({}, '{}', '{}')".format(i, k.replace("'", "''"), v.replace("'", "''")) for i, (k, v) in enumerate(rows, 1))


_H = f"""h AS (SELECT * FROM (VALUES {_values(_DOC_HEADERS)}) t(pos, key, value)),
m AS (SELECT doc_id, pos, key, value FROM documents, h UNION ALL SELECT doc_id, {len(_DOC_HEADERS) + 1}, 'subject', 'Document ' || doc_id FROM documents)"""
_IN = "key IN (" + ", ".join(f"'{k}'" for k in H.ALLOWED) + ")"
_NUMBERED = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS place"


def _exploded(spark: SparkSession, sf_dir: str, kept: Callable[[Column], Column]) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", kept(_headers()).alias("h"))
    return docs.select("doc_id", F.posexplode("h").alias("place", "h")).select("doc_id", long(F.col("place")).alias("place"), "h.key", "h.value")


@query(f"WITH {_H} SELECT doc_id, {_NUMBERED}, key, value FROM m WHERE {_IN}")
def header_whitelist(spark, sf_dir):
    return _exploded(spark, sf_dir, H.whitelist)


@query(f"WITH {_H} SELECT doc_id, {_NUMBERED}, key, value FROM m WHERE {_IN} OR key = 'x-priority'")
def header_whitelist_custom(spark, sf_dir):
    return _exploded(spark, sf_dir, lambda h: H.whitelist(h, H.allowed_keys([" X-Priority ", "", None])))


def _first(keys) -> str:
    names = ", ".join(f"'{k}'" for k in keys)
    return f"WITH {_H}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM m WHERE {_IN}) SELECT doc_id, {_NUMBERED}, key, value FROM w WHERE nth = 1 OR key NOT IN ({names})"


@query(_first(H.FIRST_SUMMARY))
def header_first_wins(spark, sf_dir):
    return _exploded(spark, sf_dir, lambda h: H.first_wins(H.whitelist(h)))


@query(_first(H.FIRST_RISK))
def header_first_wins_risk(spark, sf_dir):
    return _exploded(spark, sf_dir, lambda h: H.first_wins(H.whitelist(h), H.FIRST_RISK))


def _attached(spark: SparkSession, sf_dir: str, keep: bool) -> DataFrame:
    lone = lambda a, b: F.struct(a.cast("string").alias("filename"), b.cast("string").alias("contentType"))
    items = F.array(lone(F.concat("source", F.lit(".pdf")), F.lit("application/pdf")), lone(F.lit(None), F.lit("")), lone(F.lit(""), F.when(F.col("doc_id") % 2 == 0, "text/csv")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(H.attachments(items, keep)).alias("place", "a"))
    return rows.select("doc_id", long(F.col("place")).alias("place"), "a.filename", "a.contentType")


_ITEMS = "a AS (SELECT doc_id, 1 AS pos, source || '.pdf' AS filename, 'application/pdf' AS contentType FROM documents UNION ALL SELECT doc_id, 2, NULL, '' FROM documents UNION ALL SELECT doc_id, 3, '', CASE WHEN doc_id % 2 = 0 THEN 'text/csv' END FROM documents)"


@query(f"WITH {_ITEMS} SELECT doc_id, {_NUMBERED}, filename, contentType FROM a WHERE coalesce(filename, '') <> '' OR coalesce(contentType, '') <> ''")
def attachment_project(spark, sf_dir):
    return _attached(spark, sf_dir, False)


@query(f"WITH {_ITEMS} SELECT doc_id, {_NUMBERED}, filename, contentType FROM a")
def attachment_project_risk(spark, sf_dir):
    return _attached(spark, sf_dir, True)


@query("SELECT doc_id, 'a.txt ; ' || source || ' x.pdf' AS names FROM documents")
def attachment_names(spark, sf_dir):
    named = lambda c: F.struct(c.cast("string").alias("filename"), F.lit("t").alias("contentType"))
    items = F.array(named(F.lit(" a.txt\n")), named(F.lit(" ")), named(F.lit(None)), named(F.concat("source", F.lit("\tx.pdf"))))
    return table(spark, sf_dir, "documents").select("doc_id", H.attachment_names(items).alias("names"))


def _page_text(html: str) -> str:
    t = f"regexp_replace({html}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<!--.*?-->', '', 'g')"
    for a, b in (("(?i)<br\\s*/?>|</(p|div|li|h[1-6])\\s*>", "chr(10)"), ("<[^>]*>", "''"), ("[ \\t\\r\\f]+", "' '"), (" ?\\n ?", "chr(10)"), ("\\n\\n+", "chr(10) || chr(10)")):
        t = f"regexp_replace({t}, '{a}', {b}, 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim({t}, ' ' || chr(10))"


@query(f"SELECT page_id, {_page_text('html')} AS plain FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("plain"))


def _body(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return messages(spark, sf_dir).select("doc_id", X.choose_body(F.col("text"), F.col("html"), rule).alias("body"))


def _body_sql(rule: str) -> str:
    text = "trim(text, ' ' || chr(10) || chr(9) || chr(13))" if rule == "embed" else "text"
    longer = f"length(html) > 2 * length({text})" if rule == "risk" else f"length(html) >= length({text})"
    return f"SELECT doc_id, CASE WHEN html <> '' AND ({text} = '' OR {longer}) THEN {_page_text('html')} ELSE {text} END AS body FROM documents LEFT JOIN pages ON page_id = doc_id"


@query(_body_sql("summary"))
def body_choice_summary(spark, sf_dir):
    return _body(spark, sf_dir, "summary")


@query(_body_sql("risk"))
def body_choice_risk(spark, sf_dir):
    return _body(spark, sf_dir, "risk")


@query(_body_sql("embed"))
def body_choice_embed(spark, sf_dir):
    return _body(spark, sf_dir, "embed")


@query("""SELECT c_custkey, c_name || ' <c' || c_custkey || '@example.com> ; <' || lower(c_mktsegment) || '@example.com> ; ' || c_mktsegment AS shown FROM customer""")
def address_render(spark, sf_dir):
    who = lambda n, a: F.struct(n.alias("name"), a.alias("address"))
    own = F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com"))
    people = F.array(who(F.col("c_name"), own), who(F.lit(""), F.concat(F.lower("c_mktsegment"), F.lit("@example.com"))), who(F.lit(""), F.lit("")), who(F.col("c_mktsegment"), F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", H.render_addresses(people).alias("shown"))


@query("""SELECT c_custkey, c_name || ' <c' || c_custkey || '@example.com> ; Ann <ann@example.com> ; Bob <bob@bücher.example>' AS shown FROM customer""")
def address_parse(spark, sf_dir):
    ship(spark)
    value = F.concat(F.lit('"'), F.col("c_name"), F.lit('" <c'), F.col("c_custkey"), F.lit("@example.com>, Team: =?utf-8?q?Ann?= <ann@example.com>, Bob <bob@xn--bcher-kva.example>;"))
    return table(spark, sf_dir, "customer").select("c_custkey", H.render_addresses(H.parse_addresses(value)).alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S') || ' GMT' AS shown FROM orders")
def date_header_utc(spark, sf_dir):
    day = F.col("o_orderdate").cast("timestamp")
    sent = F.concat(F.date_format(day, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)"))
    head = lambda v: F.struct(F.lit("date").alias("key"), v.alias("value"))
    return table(spark, sf_dir, "orders").select("o_orderkey", H.last_date(F.array(head(F.lit("Mon, 1 Jan 2001 10:00:00 +0100")), head(sent), head(F.lit("no date")))).alias("shown"))


@query("""SELECT c_custkey, 'to: ' || c_name || ' <c' || c_custkey || '@example.com>' || chr(10) || 'from: Desk <desk@example.com>' || chr(10) || 'subject: Order ' || c_custkey || chr(10) || 'date: Fri, 02 Feb 2024 03:04:05 GMT' || chr(10) || 'attachments: a.pdf' || chr(10) || chr(10) AS preamble FROM customer""")
def preamble(spark, sf_dir):
    head = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    sent = F.array(head("subject", F.lit("first")), head("subject", F.concat(F.lit(" Order "), F.col("c_custkey").cast("string"))), head("subject", F.lit(" ")), head("date", F.lit("Fri, 2 Feb 2024 05:04:05 +0200")))
    to = F.array(F.struct(F.col("c_name").alias("name"), F.concat(F.lit("c"), F.col("c_custkey"), F.lit("@example.com")).alias("address")))
    desk = F.array(F.struct(F.lit("Desk").alias("name"), F.lit("desk@example.com").alias("address")))
    names = H.attachment_names(F.array(F.struct(F.lit("a.pdf").alias("filename"))))
    return table(spark, sf_dir, "customer").select("c_custkey", H.preamble(H.render_addresses(desk), H.render_addresses(to), H.last_subject(sent), H.last_date(sent), names, F.lit(True)).alias("preamble"))


@query("""SELECT page_id, 'See ' || regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || ', ftp://files.example.com:2121 and http://www.example.org or mailto:// now' AS reduced FROM pages""")
def link_reduce(spark, sf_dir):
    t = F.concat(F.lit("See "), F.col("url"), F.lit(", ftp://me:pw@files.example.com:2121/a?b#c and www.example.org/x/y or Ann.B@mail.example.com now"))
    return table(spark, sf_dir, "pages").select("page_id", X.reduce_links(t).alias("reduced"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(?:mailto:)?[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+', 'mailto://', 'g') AS masked FROM documents")
def email_mask(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.mask_emails(F.col("text")).alias("masked"))


_QUOTED = "'> first' || chr(13) || chr(10) || text || chr(10) || chr(10) || '  > quoted' || chr(10) || chr(10) || chr(10) || ' ' || chr(10) || 'end > here' || chr(10) || '>'"


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace({_QUOTED}, chr(13) || chr(10), chr(10)), '(?m)^\\s*>.*$', '', 'g'), '(?m)^\\s+$', '', 'g'), '\\n\\n+', chr(10) || chr(10), 'g') AS cleaned FROM documents""")
def quote_strip(spark, sf_dir):
    t = F.concat(F.lit("> first\r\n"), "text", F.lit("\n\n  > quoted\n\n\n \nend > here\n>"))
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_quotes(t).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 1000) ELSE text END AS kept, CAST(CASE WHEN doc_id % 2 = 0 THEN greatest(length(text) - 1000, 0) ELSE greatest(length(text) - 65536, 0) END AS BIGINT) AS removed FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE substr(text, 1, 65536) END AS text FROM documents)")
def length_clamp(spark, sf_dir):
    (a, x), (b, y) = X.clamp(F.col("text"), 1000), X.clamp(F.col("text"))
    even = F.col("doc_id") % 2 == 0
    return table(spark, sf_dir, "documents").select("doc_id", F.when(even, a).otherwise(b).alias("kept"), long(F.when(even, x).otherwise(y)).alias("removed"))


_TOKENS = "regexp_extract_all({}, ' ?\\p{{L}}+| ?\\p{{N}}+| ?[^\\s\\p{{L}}\\p{{N}}]+|\\s+')"


@query(f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", long(T.count(F.col("text"))).alias("n_tokens"))


def _chunks_sql(size: int) -> str:
    front = "'subject: Document ' || doc_id || chr(10) || chr(10)"
    return f"""WITH d AS (SELECT doc_id, {front} AS front, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\\s*>.*$', '', 'g'), '(?m)^\\s+$', '', 'g'), '\\n\\n+', chr(10) || chr(10), 'g') AS t FROM documents),
k AS (SELECT doc_id, front, {_TOKENS.format('t')} AS tok, greatest(200, {size} - len({_TOKENS.format('front')})) AS size FROM d),
i AS (SELECT *, unnest(range(0, len(tok), size)) AS pos FROM k)
SELECT doc_id, CAST(floor(pos / size) AS BIGINT) AS chunk_no, front || array_to_string(list_slice(tok, pos + 1, pos + size), '') AS chunk FROM i"""


@query(_chunks_sql(400))
def chunk_documents(spark, sf_dir):
    front = F.concat(F.lit("subject: Document "), F.col("doc_id"), F.lit("\n\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(T.chunks(front, X.strip_quotes(F.col("text")), F.col("text"))).alias("n", "chunk")).where("chunk is not null")
    return rows.select("doc_id", long(F.col("n")).alias("chunk_no"), "chunk")


@query("SELECT * FROM (VALUES (1, 0, 'p' || chr(10) || chr(10)), (3, 0, 'p' || chr(10) || chr(10) || 'one')) t(case_no, chunk_no, chunk)")
def chunk_edge_cases(spark, sf_dir):
    rows = spark.createDataFrame([(1, ""), (2, "> all\n > quoted"), (3, "one")], "case_no int, t string")
    out = rows.select("case_no", F.posexplode(T.chunks(F.lit("p\n\n"), X.strip_quotes(F.col("t")), F.col("t"))).alias("chunk_no", "chunk"))
    return out


_STEP = "CASE WHEN kept > 2097152 THEN 1048576 WHEN kept > 2048 THEN 1024 WHEN kept > 512 THEN 256 WHEN kept > 200 THEN 100 WHEN kept > 20 THEN 10 WHEN kept > 1 THEN 1 ELSE 0 END"


def _ladder_sql(budget: int, removed: str) -> str:
    n = f"len({_TOKENS.format(chr(39) + 'Body: ' + chr(39) + ' || substr(text, 1, kept)')})"
    return f"""WITH RECURSIVE r AS (
SELECT doc_id, substr(text, 1, 65536) AS text, least(length(text), 65536) AS kept, greatest(length(text) - 65536, 0) AS removed FROM documents
UNION ALL SELECT doc_id, text, kept - {_STEP}, removed + {removed} FROM r WHERE {n} > {budget} AND kept > 1)
SELECT doc_id, CAST(min(kept) AS BIGINT) AS kept, CAST(max(removed) AS BIGINT) AS removed FROM r GROUP BY doc_id"""


def _truncated(spark: SparkSession, sf_dir: str, budget: int, old: bool) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", P.fitted(F.col("text"), lambda t: F.concat(F.lit("Body: "), t), P.Options(max_tokens=budget), old).alias("z"))
    return rows.select("doc_id", long(F.col("z.kept")).alias("kept"), long(F.col("z.removed")).alias("removed"))


@query(_ladder_sql(500, _STEP))
def truncate_budget(spark, sf_dir):
    return _truncated(spark, sf_dir, 500, False)


@query(_ladder_sql(500, f"CASE WHEN {_STEP} = 256 THEN 255 ELSE {_STEP} END"))
def truncate_budget_cr(spark, sf_dir):
    return _truncated(spark, sf_dir, 500, True)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql(prompt: str) -> str:
    return f"SELECT doc_id, md5({prompt}) AS digest, CAST(length({prompt}) AS BIGINT) AS n_chars FROM documents"


def _digest(df: DataFrame, prompt: Column) -> DataFrame:
    return df.select("doc_id", F.md5(prompt).alias("digest"), long(F.length(prompt)).alias("n_chars"))


_JSON_TEXT = "to_json(text)"
_CONTENT = "'{\"headers\":[{\"key\":\"from\",\"value\":\"Desk <desk@example.com>\"},{\"key\":\"subject\",\"value\":\"Document ' || doc_id || '\"}],\"attachments\":[{\"filename\":\"' || source || '.txt\",\"contentType\":\"text/plain\"}],\"text\":' || " + _JSON_TEXT + " || '}'"


def _content() -> Column:
    head = F.filter(H.first_wins(H.whitelist(_headers())), lambda h: h.key.isin("from", "subject"))
    items = F.array(F.struct(F.concat("source", F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("contentType")))
    return P.content_json(head, H.attachments(items), F.col("text"))


@query(_prompt_sql(_quoted(P.SUMMARY_USER + "\n" + P.SUMMARY_SCHEMA + "\n\n") + " || " + _CONTENT))
def summary_prompt(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents"), P.summary_prompt(_content()))


@query(_prompt_sql(_quoted(P.RISK_USER + "\n\n") + " || " + _CONTENT))
def risk_prompt(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents"), P.risk_prompt(_content()))


@query(_prompt_sql(_quoted(P.ANSWER_USER + "\nThe time is 2024-01-01.\n\n") + " || '{\"name\":\"Ann\",\"question\":\"what about ' || source || '?\"}' || chr(10) || chr(10) || text"))
def answer_prompt(spark, sf_dir):
    asked = F.concat(F.lit("what about "), F.col("source"), F.lit("?"))
    return _digest(table(spark, sf_dir, "documents"), P.answer_prompt(asked, F.lit("Ann"), F.lit(None).cast("string"), F.col("text"), "2024-01-01"))


@query(_prompt_sql(_quoted(P.QUESTION_USER + "\n") + " || source || '?' || chr(10)"))
def question_prompt(spark, sf_dir):
    return _digest(table(spark, sf_dir, "documents"), P.question_prompt(F.concat("source", F.lit("?"))))


_ROUTES = "CASE doc_id % 3 WHEN 0 THEN 'gpt-3.5-turbo-instruct' WHEN 1 THEN 'gpt-5-mini' ELSE 'gpt-3.5-turbo' END"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/v1/completions' ELSE '/v1/chat/completions' END AS path,
CASE WHEN doc_id % 3 = 0 THEN '{{"model":"' || {_ROUTES} || '","prompt":"Be brief.\\n' || source || '","max_tokens":' || (4000 - n_chars) || ',"user":"u1","temperature":0.5}}'
ELSE '{{"model":"' || {_ROUTES} || '","messages":[{{"role":"system","content":"Be brief."}},{{"role":"user","content":"' || source || '"}}],"user":"u1","temperature":0.5}}' END AS body FROM documents""")
def payload_routing(spark, sf_dir):
    model = F.when(F.col("doc_id") % 3 == 0, P.INSTRUCT_MODEL).when(F.col("doc_id") % 3 == 1, P.CHAT_MODEL).otherwise("gpt-3.5-turbo")
    path, body = P.payload(F.col("source"), F.col("n_chars"), "Be brief.", model, P.Options(temperature="0.5", top_p=0, user="u1"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), body.alias("body"))


_URLS = [
    (None, "/v1/models", "https://api.openai.com/v1/models"), ("https://api.example.com", "/v1/models", "https://api.example.com/v1/models"), ("https://api.example.com/", "/v1/models", "https://api.example.com/v1/models"),
    ("https://api.example.com/v1", "/v1/models", "https://api.example.com/v1/models"), ("https://api.example.com/v1/", "/v1/models", "https://api.example.com/v1/models"), ("https://r.example.com/base/v1", "/v1/chat/completions", "https://r.example.com/base/v1/chat/completions"),
    ("http://127.0.0.1:9200/v1", "/v1/embeddings", "http://127.0.0.1:9200/v1/embeddings"), ("https://api.example.com/proxy", "/v1/models", "https://api.example.com/proxy/v1/models"), ("https://api.example.com/v1", "/v1beta/x", "https://api.example.com/v1/v1beta/x"),
    ("https://api.example.com/xv1", "/v1/models", "https://api.example.com/xv1/v1/models"), ("https://api.example.com/v1", None, "https://api.example.com/v1/"), ("https://api.example.com/v1", "/v1", "https://api.example.com/v1/"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(u)})" for i, (_, _, u) in enumerate(_URLS)) + ") t(case_no, url)")
def api_url(spark, sf_dir):
    rows = spark.createDataFrame([(i, b, p) for i, (b, p, _) in enumerate(_URLS)], "case_no int, base string, path string")
    return rows.select("case_no", P.api_url(F.col("base"), F.col("path")).alias("url"))


@query("""WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN 0 ELSE turn END AS k FROM conversations WHERE role = 'assistant' AND text <> '')
SELECT conv_id, coalesce((SELECT trim(string_agg(c.text, '' ORDER BY k, turn), ' ' || chr(10)) FROM c WHERE c.conv_id = a.conv_id), '') AS merged FROM (SELECT DISTINCT conv_id FROM conversations) a""")
def choices_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    k = F.when(F.col("turn") % 3 == 2, F.lit(None)).otherwise(F.col("turn")).cast("int")
    choice = F.struct(F.col("turn").alias("at"), F.struct(k.alias("index"), F.struct("role", F.col("text").alias("content")).alias("message"), F.lit(None).cast("string").alias("text")).alias("c"))
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(choice)), lambda x: x.c).alias("choices"))
    return rows.select("conv_id", A.merge_choices(F.col("choices")).alias("merged"))


@query("SELECT doc_id, '{\"a\":' || to_json(text) || ',\"b\":{\"c\":\"}\"}}' AS found FROM documents")
def json_extract(spark, sf_dir):
    own = F.to_json(F.struct(F.col("text").alias("a"), F.struct(F.lit("}").alias("c")).alias("b")))
    return table(spark, sf_dir, "documents").select("doc_id", A.json_object(F.concat(F.lit("Here you are:\n"), own, F.lit("\nthat's all"))).alias("found"))


@query("""SELECT doc_id, '{"lang":"' || lang || '",' || CASE WHEN doc_id % 2 = 0 THEN '"even":true,' ELSE '' END || '"zero":0,"no":false,"list":[null,"",{}],"deep":{}}' AS pruned FROM documents""")
def json_prune(spark, sf_dir):
    ship(spark)
    even = F.when(F.col("doc_id") % 2 == 0, "true").otherwise('""')
    t = F.concat(F.lit('{"lang":"'), "lang", F.lit('","even":'), even, F.lit(',"zero":0,"no":false,"gone":null,"list":[null,"",{"x":""}],"deep":{"y":null}}'))
    return table(spark, sf_dir, "documents").select("doc_id", A.strict_json(t).json.alias("pruned"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CASE WHEN quality = 0 THEN -1.0 ELSE quality END WHEN 1 THEN 3.0 WHEN 2 THEN -1.0 WHEN 3 THEN -1.0 WHEN 4 THEN 1.0 ELSE 250.0 END::DOUBLE AS risk FROM labels""")
def risk_coerce(spark, sf_dir):
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, F.col("quality").cast("string")).when(k == 1, "3").when(k == 2, "high").when(k == 3, "1d").when(k == 4, "true").otherwise(" 2.5e2 ")
    return table(spark, sf_dir, "labels").select("doc_id", A.coerce_risk(raw).alias("risk"))


_REPLY = "Sure.\n**Answer:** {}\n\nand more\nMessage-ID: <a@x>, <b@x>,\n`message-id:` <a@x> , <c@x>\nANSWER: last"


@query("""SELECT doc_id, source || chr(10) || chr(10) || 'and more' || chr(10) || 'last' AS answer, '<a@x> <b@x> <c@x>' AS ids FROM documents""")
def answer_sections(spark, sf_dir):
    a, b = _REPLY.split("{}")
    rows = table(spark, sf_dir, "documents").select("doc_id", A.sections(F.concat(F.lit(a), "source", F.lit(b))).alias("s"))
    return rows.select("doc_id", F.col("s.answer").alias("answer"), F.array_join(A.message_ids(F.col("s.ids")), " ").alias("ids"))


@query("WITH x AS (SELECT conv_id, '<' || role || '>' AS r, min(turn) AS t FROM conversations GROUP BY conv_id, role) SELECT conv_id, string_agg(r, ' ' ORDER BY t) AS ids FROM x GROUP BY conv_id")
def message_id_distinct(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit("<"), x.role, F.lit(">"))), ", ").alias("r"))
    s = A.sections(F.concat(F.lit("Message-ID: "), "r"))
    return said.select("conv_id", F.array_join(A.message_ids(s.ids), " ").alias("ids"))


_MODELS = [
    ("gpt-4-0613", "openai", "GPT-4 0613", 8), ("gpt-4", "openai", "GPT-4", 3), ("tts-1-hd", "system", "TTS-1 HD", 13), ("gpt-3.5-turbo-16k", "openai", "GPT-3.5 Turbo 16K", 2), ("gpt-3.5-turbo", None, "GPT-3.5 Turbo", 1),
    ("dall-e-3", "system", "Dall-E 3", 10), ("whisper-1", "openai-internal", "Whisper-1", 14), ("gpt-4-turbo-2024-04-09", "system", "GPT-4 Turbo 2024-04-09", 5), ("gpt-4-turbo", "system", "GPT-4 Turbo", 4), ("gpt-4-vision-preview", "system", "GPT-4 Vision Preview", 6),
    ("gpt-4o-preview", "system", "GPT-4o Preview", 7), ("davinci-002", "system", "Davinci 002", 11), ("text-embedding-ada-002", "openai-internal", "Text Embedding Ada 002", 12), ("curie", "openai-dev", None, None), ("ada", "system", "Ada", 9),
]
_NAMED = "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(i)}, {_quoted(n)}, {r}::BIGINT)" for i, _, n, r in _MODELS if r) + ") t(id, name, rank)"


@query(_NAMED)
def model_catalog(spark, sf_dir):
    from pyspark.sql import Window

    rows = C.usable(spark.createDataFrame([m[:2] for m in _MODELS], "id string, owned_by string"))
    return rows.select("id", C.display_name(F.col("id")).alias("name"), long(F.row_number().over(Window.orderBy(*C.order_keys(F.col("id"))))).alias("rank"))


@query("SELECT doc_id, 'Report ' || doc_id AS subject, 'Hello' || chr(10) || source AS body, 'a.pdf application/pdf' AS attached FROM documents")
def eml_parse(spark, sf_dir):
    """Messages of .eml bytes built from the documents."""
    raw = F.concat(F.lit("From: Desk <desk@example.com>\r\nSubject: Report "), F.col("doc_id"), F.lit('\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHello\n'), "source", F.lit('\r\n--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename="a.pdf"\r\n\r\nx\r\n--b--\r\n'))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(raw, "UTF-8").alias("content"))
    m = mail.parse_files(files)
    a = F.get("attachments", F.lit(0))
    return m.select(F.col("message_id").cast("long").alias("doc_id"), H.last_subject(F.col("headers")).alias("subject"), "text", F.concat_ws(" ", a.filename, a.contentType).alias("attached")).withColumnRenamed("text", "body")


@query("SELECT doc_id, lower(lang) AS key, source AS value FROM documents")
def header_map_adapter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", mail.headers_of_map(F.create_map(F.upper("lang"), F.array("source"))).alias("h"))
    return rows.select("doc_id", F.explode("h").alias("h")).select("doc_id", "h.key", "h.value")


@query("SELECT doc_id, 'model' AS id, '7' AS tokens, 'own' AS model, source AS extra FROM documents")
def metadata_overlay(spark, sf_dir):
    own = F.concat(F.lit('{"id":"x","tokens":1,"extra":"'), "source", F.lit('"}'))
    rows = table(spark, sf_dir, "documents").select("doc_id", A.overlay(own, F.lit("model"), F.lit(7), F.lit("own")).alias("m"))
    return rows.select("doc_id", *(F.col("m")[k].alias(k) for k in ("id", "tokens", "model", "extra")))


# --- with a client ---------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(CASE WHEN source = 'src1' THEN 5 ELSE 1 END AS BIGINT) AS attempts, CASE source WHEN 'src1' THEN 'slow down' WHEN 'src2' THEN 'broken' WHEN 'src3' THEN 'Failed to run API request' WHEN 'src4' THEN 'Failed to POST API request' WHEN 'src5' THEN 'Expecting value: line 1 column 1 (char 0)' END AS message,
CASE source WHEN 'src1' THEN 429 WHEN 'src2' THEN 500 WHEN 'src3' THEN 503 END AS status, CASE source WHEN 'src2' THEN 'E1' END AS code, TRUE AS timed FROM documents""")
def error_rows(spark, sf_dir):
    """Retries, structured, generic, empty-body and undecodable errors as rows, each with its time."""
    script = {
        '"src1"': (429, '{"error":{"message":"slow down"}}'), '"src2"': (500, '{"error":{"message":"broken","code":"E1"}}'),
        '"src3"': (503, "{}"), '"src4"': (200, "null"), '"src5"': (429, "busy"),
    }
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(P.CHAT).alias("path"), F.to_json(F.struct(F.col("source").alias("s"))).alias("body"))
    sent = call(rows, lambda: FakeClient(script), ["doc_id"], wait=0.0)
    return sent.select("doc_id", long(F.col("attempts")).alias("attempts"), F.col("error.message").alias("message"), F.col("error.statusCode").alias("status"), F.col("error.code").alias("code"), (F.col("time_ms") >= 0).alias("timed"))


SOURCES = 20


def _scripted(reply: Callable[[int], tuple[int, str]]) -> Callable[[], FakeClient]:
    """A client whose answer depends on the attachment's name, ``src<k>.txt``, in the request."""
    script = {f"src{k}.txt": reply(k) for k in range(SOURCES)}
    return lambda: FakeClient(script)


def _chat(*parts: str, n: int = 7) -> str:
    """A chat answer with these choices, the last of them first in the list."""
    import json

    choices = [{"index": k, "message": {"role": "assistant", "content": t}} for k, t in enumerate(parts)]
    return json.dumps({"id": "r1", "choices": choices[::-1], "usage": {"total_tokens": n}})


_K = "CAST(substr(source, 4) AS INT) % 4"
#: The text of a document without anything that a link is found by.
_NO_LINKS = "translate(text, '.@:/', '    ')"


def _plain_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without pages, whose texts have no links and no quotes."""
    docs = table(spark, sf_dir, "documents")
    item = F.array(F.struct(F.concat(F.col("source"), F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("contentType")))
    return docs.select(F.col("doc_id").cast("string").alias("message_id"), _headers().alias("headers"), item.alias("attachments"), F.translate("text", ".@:/>", "     ").alias("text"), F.lit(None).cast("string").alias("html"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE WHEN k < 3 THEN 'r1' END AS req_id, CAST(CASE WHEN k < 3 THEN 7 END AS BIGINT) AS tokens, 'gpt-5-mini' AS model, CASE k WHEN 0 THEN 'neutral' END AS sentiment, CASE k WHEN 0 THEN 'About ' || source WHEN 1 THEN 'bare' END AS summary,
CASE k WHEN 0 THEN TRUE END AS reply, CASE k WHEN 0 THEN 2 END AS risk, CASE k WHEN 0 THEN 'fine' END AS assessment, CAST(CASE k WHEN 0 THEN 1 END AS BIGINT) AS n_events, CASE k WHEN 0 THEN 'call' END AS action,
CASE k WHEN 2 THEN 'Failed to parse output' WHEN 3 THEN 'denied' END AS message, CASE k WHEN 2 THEN 'OutputParseFailed' END AS code, CASE k WHEN 3 THEN 401 END AS status, CASE k WHEN 1 THEN '{{"summary":"bare"}}' END AS raw, 0 AS chars_removed FROM (SELECT *, {_K} AS k FROM documents)""")
def summarize(spark, sf_dir):
    """JSON in prose over two choices; nulls pruned; no JSON; a refusal."""

    def reply(k: int) -> tuple[int, str]:
        whole = f'{{"sentiment":"neutral","summary":"About src{k}","shouldReply":true,"riskAssessment":{{"risk":2,"assessment":"fine"}},"replyText":"","events":[{{"description":"meet"}}],"actions":[{{"description":"call","dueDate":null}}]}} Done.'
        return [(200, _chat("Here: " + whole[:40], whole[40:])), (200, _chat('{"summary":"bare","replyText":null}')), (200, _chat("No idea.")), (401, '{"error":{"message":"denied"}}')][k % 4]

    out = pipelines.summarize(messages(spark, sf_dir), _scripted(reply))
    return out.select(
        "message_id", "req_id", "tokens", "model", "sentiment", "summary", F.col("shouldReply").alias("reply"), "riskAssessment.risk", "riskAssessment.assessment", long(F.nullif(F.size("events"), F.lit(-1))).alias("n_events"), F.get("actions", F.lit(0)).description.alias("action"),
        F.col("error.message").alias("message"), F.col("error.code").alias("code"), F.col("error.statusCode").alias("status"), F.when(F.col("summary") == "bare", F.col("raw_json")).alias("raw"), "chars_removed",
    )


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE k5 WHEN 0 THEN 3.0 WHEN 1 THEN -1.0 WHEN 2 THEN 1.0 WHEN 3 THEN -1.0 END::DOUBLE AS risk, CASE WHEN k5 < 4 THEN 'a' END AS assessment, CASE k5 WHEN 4 THEN 'no json' END AS said, CASE k5 WHEN 4 THEN 'OutputParseFailed' END AS code, 0 AS chars_removed
FROM (SELECT doc_id, CAST(substr(source, 4) AS INT) % 5 AS k5 FROM documents)""")
def assess_risk(spark, sf_dir):
    """Chat choices alone count, over lines, without quotation marks at the ends; strict JSON; odd numbers."""
    import json

    def reply(k: int) -> tuple[int, str]:
        values = ['"{"risk":\n"3","assessment":"a"}"', '{"risk":"true","assessment":"a"}', '{"risk":true,"assessment":"a"}', '{"risk":"high","assessment":"a"}', "no json"]
        parts = values[k % 5].split("\n")
        choices = [{"index": i, "message": {"role": "assistant", "content": t}} for i, t in enumerate(parts)]
        return 200, json.dumps({"id": "r", "choices": [{"index": 9, "text": "not chat"}, *choices], "usage": {"total_tokens": 1}})

    out = pipelines.assess_risk(messages(spark, sf_dir), _scripted(reply))
    return out.select("message_id", "risk", "assessment", F.col("error.textContent").alias("said"), F.col("error.code").alias("code"), "chars_removed")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("message_id"), F.when(F.col("doc_id") % 10 > 0, F.concat(F.lit("What of "), "source", F.lit(".txt"))).alias("question"), F.lit("Ann").alias("user_name"), F.lit(None).cast("string").alias("user_email"), F.concat(F.lit("- EMAIL #1:\nMessage-ID: <a@x>\n\n"), "text").alias("context"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE WHEN asked THEN 'newer_first' END AS ordering, CASE WHEN asked AND k % 2 = 0 THEN '2024-01-02' END AS start_time, CAST(NULL AS VARCHAR) AS end_time, CASE WHEN asked THEN source END AS topic, CASE WHEN NOT asked THEN 'EmptyInput' END AS code, 'gpt-3.5-turbo-instruct' AS model
FROM (SELECT doc_id, source, {_K} AS k, doc_id % 10 > 0 AS asked FROM documents)""")
def plan_question(spark, sf_dir):
    import json

    def reply(k: int) -> tuple[int, str]:
        start = '"2024-01-02"' if k % 2 == 0 else "null"
        return 200, json.dumps({"id": "r", "choices": [{"text": f'So: {{"ordering":"newer_first","start_time":{start},"end_time":"","topic":"src{k}"}}'}]})

    out = pipelines.plan_question(_questions(spark, sf_dir), _scripted(reply))
    return out.select("message_id", "ordering", "start_time", "end_time", "topic", F.col("error.code").alias("code"), "model")


@query("""SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE WHEN doc_id % 10 = 0 THEN 'nothing' ELSE 'It is ' || source || chr(10) || 'and so' END AS answer, CASE WHEN doc_id % 10 > 0 THEN '<' || source || '@x> <b@x>' END AS ids, CASE WHEN doc_id % 10 > 0 THEN 'r1' ELSE 'r2' END AS req_id, 'gpt-5-mini' AS model FROM documents""")
def answer(spark, sf_dir):
    """Labelled answers; a question that is empty is asked all the same."""
    script = {f"src{k}.txt": (200, _chat(f"**Answer:** It is src{k}\nand so\n\nMessage-ID: <src{k}@x>, <b@x>,\nmessage-id: <b@x>")) for k in range(SOURCES)}
    script["user"] = (200, _chat("Answer: nothing").replace("r1", "r2"))
    out = pipelines.answer(_questions(spark, sf_dir), lambda: FakeClient(script))
    return out.select("message_id", "answer", F.array_join("messageId", " ").alias("ids"), "req_id", "model")


def _embedded_sql() -> str:
    t = "regexp_replace(regexp_replace(trim(translate(text, '.@:/>', '     '), ' ' || chr(10) || chr(9) || chr(13)), '(?m)^\\s+$', '', 'g'), '\\n\\n+', chr(10) || chr(10), 'g')"
    front = "'from: Desk <desk@example.com>' || chr(10) || 'subject: Document ' || doc_id || chr(10) || 'attachments: ' || source || '.txt' || chr(10) || chr(10)"
    return f"""d AS (SELECT doc_id, source, {front} AS front, {t} AS t FROM documents), k AS (SELECT doc_id, source, front, t, {_TOKENS.format('t')} AS tok, greatest(200, 400 - len({_TOKENS.format('front')})) AS size FROM d),
i AS (SELECT *, unnest(CASE WHEN t = '' THEN [0] ELSE range(0, len(tok), size) END) AS pos FROM k), c AS (SELECT doc_id, source, CAST(floor(pos / size) AS INT) AS chunk_no, front || array_to_string(list_slice(tok, pos + 1, pos + size), '') AS chunk FROM i)"""


_BYTES = " || ' ' || ".join(f"CAST(CAST('0x' || substr(h, {2 * k + 1}, 2) AS INT) AS VARCHAR)" for k in range(8))


@query(f"""WITH {_embedded_sql()}, e AS (SELECT *, sha256('/v1/embeddings' || chr(10) || '{{"model":"text-embedding-ada-002","input":' || to_json(chunk) || '}}') AS h FROM c)
SELECT CAST(doc_id AS VARCHAR) AS message_id, chunk_no, chunk, {_BYTES} AS embedding, 'text-embedding-ada-002' AS model, CAST(NULL AS VARCHAR) AS message FROM e""")
def embed_chunks(spark, sf_dir):
    """A call a chunk; the vector's numbers are 255ths, shown as such."""
    out = pipelines.embed(_plain_messages(spark, sf_dir), FakeClient)
    shown = F.array_join(F.transform("embedding", lambda x: F.round(x * 255).cast("int").cast("string")), " ")
    return out.select("message_id", "chunk_no", "chunk", shown.alias("embedding"), "model", F.col("error.message").alias("message"))


@query(f"WITH {_embedded_sql()} SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(CASE WHEN source <> 'src3' THEN count(*) END AS BIGINT) AS n, CASE source WHEN 'src3' THEN 'denied' END AS message FROM c GROUP BY doc_id, source")
def embed_nested(spark, sf_dir):
    """All chunks of a message in one list; a failed chunk fails its message."""
    out = pipelines.nest(pipelines.embed(_plain_messages(spark, sf_dir), lambda: FakeClient({"src3.txt": (401, '{"error":{"message":"denied"}}')})))
    return out.select("message_id", long(F.when(F.col("embeddings").isNotNull(), F.size("embeddings"))).alias("n"), F.col("error.message").alias("message"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS message_id, 'PROMPT_TOO_LONG' AS code, least(length(text), 50000) AS original, greatest(least(length(text), 50000) - 1, 0) AS removed, 20 AS allowed, 0 AS attempts FROM documents""")
def budget_errors(spark, sf_dir):
    """No text fits: every row is refused with its figures, and nothing is sent."""
    rows = _plain_messages(spark, sf_dir).withColumn("text", F.substring("text", 1, 50_000))
    out = pipelines.summarize(rows, lambda: FakeClient({"model": (500, "sent")}), P.Options(max_tokens=20))
    return out.select("message_id", F.col("error.code").alias("code"), F.col("error.originalLength").alias("original"), F.col("error.charactersRemoved").alias("removed"), F.col("error.maxAllowedTokens").alias("allowed"), F.col("time_ms").cast("int").alias("attempts"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS message_id, CAST(greatest(3 * length(text) - 65536, 0) AS INT) AS chars_removed, md5(substr(t, 1, 65536)) AS text_used, 12 AS id_length, TRUE AS own_id FROM (SELECT doc_id, text, repeat(translate(text, '.@:/>', '     '), 3) AS t FROM documents)""")
def verbose_result(spark, sf_dir):
    """What a verbose call tells: the text that was used, how much went, and a request id of its own."""
    from pyspark.sql import Window

    rows = _plain_messages(spark, sf_dir).withColumn("text", F.repeat("text", 3))
    out = pipelines.assess_risk(rows, FakeClient, P.Options(max_tokens=10_000_000, verbose="columns"))
    return out.select("message_id", "chars_removed", F.md5("text_used").alias("text_used"), F.length("request_id").alias("id_length"), (F.count("*").over(Window.partitionBy("request_id")) == 1).alias("own_id"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.7 ELSE 0.2 END::DOUBLE AS temperature, 'instructions' || chr(10) || 'ask ' || source || chr(10) AS asked, CAST(4000 - 3 AS BIGINT) AS room, 'EmptyInput' AS empty, '/v1/completions' AS path FROM documents""")
def question_payload(spark, sf_dir):
    """Temperature 0.2 unless chosen, trimmed prompts, an empty question refused."""
    docs = table(spark, sf_dir, "documents")
    out = None
    for k, chosen in enumerate((None, "0.7", 0)):
        path, body = P.payload(F.concat(F.lit("ask "), "source", F.lit("\n")), F.lit(3), " instructions ".strip(), P.INSTRUCT_MODEL, P.Options(temperature=chosen), 0.2)
        part = docs.where(F.col("doc_id") % 3 == k).select("doc_id", path.alias("path"), body.alias("body"))
        out = part if out is None else out.union(part)
    blank = spark.createDataFrame([("1", " \n", None, None, None)], "message_id string, question string, user_name string, user_email string, context string")
    code = pipelines.prepare_question(blank).select(F.col("refused.code").alias("empty"))
    return out.crossJoin(F.broadcast(code)).select("doc_id", F.get_json_object("body", "$.temperature").cast("double").alias("temperature"), F.get_json_object("body", "$.prompt").alias("asked"), F.get_json_object("body", "$.max_tokens").cast("long").alias("room"), "empty", "path")


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN trim(source || ',' || lang || ', ', ' ') ELSE trim('  ' || source || chr(10), ' ' || chr(10)) END AS context FROM documents")
def context_text(spark, sf_dir):
    """A list of contexts is joined by commas; then it is trimmed."""
    many = P.context_text(F.array("source", "lang", F.lit(" ")), True)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, many).otherwise(P.context_text(F.concat(F.lit("  "), "source", F.lit("\n")))).alias("context"))


@query("""SELECT c_custkey, 'from: ' || c_name || ' <c' || c_custkey || '@example.com>' || chr(10) || 'to: Ann <ann@example.com> ; <two@example.com> ; Bob <bob@example.com> ; <hidden@example.com>' || chr(10) || chr(10) || lower(c_mktsegment) AS chunk FROM customer""")
def address_collect(spark, sf_dir):
    """from alone; to, cc and bcc together in their order; each header is parsed by itself, so a broken one spoils no other."""
    head = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    own = F.concat(F.lit('"'), "c_name", F.lit('" <c'), "c_custkey", F.lit("@example.com>"))
    heads = F.array(head("from", own), head("to", F.lit("Ann <ann@example.com>, two@example.com")), head("cc", F.lit("Bob <bob@example.com>")), head("cc", F.lit("")), head("bcc", F.lit("hidden@example.com")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("message_id"), heads.alias("headers"), F.lit(None).cast(ATTACHMENTS).alias("attachments"), F.lower("c_mktsegment").alias("text"), F.lit(None).cast("string").alias("html"))
    return pipelines.chunk(rows).select(F.col("message_id").cast("long").alias("c_custkey"), "chunk")


@query("""SELECT doc_id, '{"headers":[{"key":"subject","value":"' || source || '"}],"attachments":[' || CASE WHEN doc_id % 2 = 0 THEN '{"filename":"a.txt","contentType":"text/plain"}' ELSE '' END || '],"text":"x"}' AS content FROM documents""")
def lone_objects(spark, sf_dir):
    """A lone header or attachment is a list of one; none is an empty list."""
    item = F.struct(F.lit("a.txt").alias("filename"), F.lit("text/plain").alias("contentType"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.lit("subject").alias("key"), F.col("source").alias("value")).alias("headers"), F.when(F.col("doc_id") % 2 == 0, item).alias("attachments"))
    rows = H.listed(rows, "headers", "attachments")
    return rows.select("doc_id", P.content_json(H.first_wins(H.whitelist(F.col("headers"))), H.attachments(F.col("attachments")), F.lit("x")).alias("content"))


@query("""SELECT c_custkey, 'at http://10.20.30.' || (c_custkey % 250) || ':8080 or http://a' || c_custkey || '.example.travel, http://sub.example.ee. Not 1.2.3, 300.1.1.1, x.notanending, 1.2.3.4.5 or file.' AS reduced FROM customer""")
def link_bare_hosts(spark, sf_dir):
    """Addresses of numbers, ports, and endings beyond the usual ones."""
    k = F.col("c_custkey")
    t = F.concat(F.lit("at 10.20.30."), (k % 250).cast("string"), F.lit(":8080/x?y or a"), k.cast("string"), F.lit(".example.travel/p, sub.example.ee. Not 1.2.3, 300.1.1.1, x.notanending, 1.2.3.4.5 or file."))
    return table(spark, sf_dir, "customer").select("c_custkey", X.reduce_links(t).alias("reduced"))


_LISTED = [{"id": i} | ({"owned_by": o} if o else {}) for i, o, _, _ in _MODELS]


@query(_NAMED.replace("id, name, rank", "id, name, place"))
def model_list(spark, sf_dir):
    """The catalogue from an API's answer."""
    import json

    from pyspark.sql import Window

    from ..sources.models import list_models

    rows = list_models(spark, FakeClient({"": (200, json.dumps({"data": _LISTED}))}))
    return rows.select("id", "name", long(F.row_number().over(Window.orderBy(*C.order_keys(F.col("id"))))).alias("place"))


def _mail_folder(spark: SparkSession) -> str:
    """A new folder with six messages, two of them deeper and one with an ending in capitals, and a file that is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "mail"))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = ["a.eml", "b.EML", "c.eml", "d/e.eml", "d/f/g.eml", "h.eml", "i.txt"]
    for k, name in enumerate(names):
        out = store.create(spark._jvm.org.apache.hadoop.fs.Path(path, name))
        out.write(bytearray(f"From: Desk <desk@example.com>\r\nSubject: number {k}\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody {k}\n".encode()))
        out.close()
    return path.toString()


@query("SELECT 'number ' || n AS subject, 'body ' || n || chr(10) AS text, 'eml' AS ending FROM range(6) t(n)")
def eml_folder(spark, sf_dir):
    """All messages below a folder, whatever the case of their endings."""
    rows = mail.read_eml(spark, _mail_folder(spark))
    return rows.select(H.last_subject(F.col("headers")).alias("subject"), "text", F.lower(F.element_at(F.split("message_id", "\\."), -1)).alias("ending"))


@query("SELECT * FROM (VALUES ('all', 6, 6), ('two', 2, 2), ('minus', 3, 3), ('word', 6, 6), ('zero', 6, 6), ('many', 6, 6)) t(what, n, different)")
def eml_shuffle_limit(spark, sf_dir):
    """A seeded shuffle loses and repeats nothing; the limit's sign is dropped, and what isn't a number is no limit."""
    path, out = _mail_folder(spark), None
    for what, most in (("all", None), ("two", 2), ("minus", "-3"), ("word", "x"), ("zero", 0), ("many", 99)):
        part = mail.read_eml(spark, path, seed=7, most=most).agg(F.lit(what).alias("what"), F.count("*").cast("int").alias("n"), F.count_distinct("message_id").cast("int").alias("different"))
        out = part if out is None else out.union(part)
    return out


@query(f"SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE WHEN k <> 3 THEN 'bare' END AS summary, CASE k WHEN 3 THEN 'denied' END AS message, CASE k WHEN 3 THEN 401 END AS status FROM (SELECT doc_id, {_K} AS k FROM documents)")
def json_sink(spark, sf_dir):
    """Results written as JSON and read back: failed rows are kept with their errors."""
    out = pipelines.summarize(_plain_messages(spark, sf_dir), _scripted(lambda k: (401, '{"error":{"message":"denied"}}') if k % 4 == 3 else (200, _chat('{"summary":"bare"}'))))
    path = shared_folder(spark, "results")
    mail.write_json(out.select("message_id", "summary", "error"), path)
    back = spark.read.schema("message_id string, summary string, error struct<message:string,statusCode:int>").json(path)
    return back.select("message_id", "summary", F.col("error.message").alias("message"), F.col("error.statusCode").alias("status"))
