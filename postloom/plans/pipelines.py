"""Message to result, for each entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..operators import answers as A
from ..operators import headers as H
from ..operators import prompts as P
from ..schemas import CHAT, EMBEDDING, RETRIEVAL, SUMMARY
from ..session import ship
from ..sources.client import Client, call

_TOO_LONG = "PROMPT_TOO_LONG"


def error(message: str, code: str | None = None, text=None, original=None, removed=None, allowed: int | None = None):
    """An error as a column; the last three are the figures of a prompt that doesn't fit."""
    or_null = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(
        F.lit(message).alias("message"),
        F.lit(code).cast("string").alias("code"),
        F.lit(None).cast("int").alias("statusCode"),
        or_null(text, "string").alias("textContent"),
        or_null(original, "int").alias("originalLength"),
        or_null(removed, "int").alias("charactersRemoved"),
        F.lit(allowed).cast("int").alias("maxAllowedTokens"),
    )


def prepare_summary(messages: DataFrame, options: P.Options | None = None) -> DataFrame:
    """message_id, prompt, n_tokens, chars_removed, fits, path, body."""
    o = options or P.Options()
    rows = H.listed(messages, "headers", "attachments").select("message_id", X.choose_body(F.col("text"), F.col("html"), "summary").alias("t"), H.first_wins(H.whitelist(F.col("headers"), H.allowed_keys(o.allowed_headers))).alias("h"), H.attachments(F.col("attachments")).alias("a"))
    return _prepared(rows, o, lambda t: P.summary_prompt(P.content_json(F.col("h"), F.col("a"), t), o.user_prompt), (o.system_prompt or P.SUMMARY_SYSTEM).strip(), True, False)


def prepare_risk(messages: DataFrame, options: P.Options | None = None) -> DataFrame:
    o = options or P.Options()
    rows = H.listed(messages, "headers", "attachments").select("message_id", X.choose_body(F.col("text"), F.col("html"), "risk").alias("t"), H.first_wins(H.whitelist(F.col("headers")), H.FIRST_RISK).alias("h"), H.attachments(F.col("attachments"), True).alias("a"))
    return _prepared(rows, o, lambda t: P.risk_prompt(P.content_json(F.col("h"), F.col("a"), t), o.user_prompt), o.system_prompt or P.RISK_SYSTEM, False, o.old_count)


def prepare_answer(questions: DataFrame, options: P.Options | None = None) -> DataFrame:
    """Of questions (message_id, question, user_name, user_email, context)."""
    o = options or P.Options()
    rows = questions.select("message_id", P.context_text(F.col("context")).alias("t"), X.js_trim(F.coalesce("question", F.lit(""))).alias("q"), "user_name", "user_email")
    return _prepared(rows, o, lambda t: P.answer_prompt(F.col("q"), F.col("user_name"), F.col("user_email"), t, o.as_of), (o.system_prompt or P.ANSWER_SYSTEM).strip(), True, o.old_count, False)


def prepare_question(questions: DataFrame, options: P.Options | None = None) -> DataFrame:
    o = options or P.Options()
    rows = questions.select("message_id", X.js_trim(F.coalesce("question", F.lit(""))).alias("q"))
    rows = rows.withColumn("prompt", P.question_prompt(F.col("q"), o.as_of)).withColumn("n_tokens", _counter(o)(F.col("prompt")))
    path, body = P.payload(F.col("prompt"), F.col("n_tokens"), (o.system_prompt or P.QUESTION_SYSTEM).strip(), o.model_or(P.INSTRUCT_MODEL), o, 0.2)
    empty = F.when(F.col("q") == "", error("Question not provided", "EmptyInput"))
    return rows.select("message_id", "prompt", "n_tokens", F.lit(0).alias("chars_removed"), F.lit("").alias("text_used"), empty.alias("refused"), path.alias("path"), body.alias("body"))


def _counter(o: P.Options) -> Callable:
    return T.bpe_count(o.tokenizer) if o.tokenizer else T.count


def _prepared(rows: DataFrame, o: P.Options, wrapped: Callable, system: str, routed: bool, old_count: bool, escaped: bool = True) -> DataFrame:
    if o.tokenizer:
        ship(rows.sparkSession)
        cut, gone = X.clamp(F.col("t"))
        rows = rows.withColumn("z", T.bpe_fit(o.tokenizer, o.max_tokens, escaped, old_count)(wrapped(F.lit(T.MARK)), cut))
        rows = rows.withColumn("z", F.struct("z.kept", (gone + F.col("z.removed")).cast("int").alias("removed"), "z.fits"))
    else:
        rows = rows.withColumn("z", P.fitted(F.col("t"), wrapped, o, old_count))
    rows = rows.withColumn("text_used", X.utf16_prefix(F.col("t"), F.col("z.kept"))).withColumn("chars_removed", F.col("z.removed")).withColumn("fits", F.col("z.fits"))
    rows = rows.withColumn("prompt", wrapped(F.col("text_used"))).withColumn("n_tokens", _counter(o)(F.col("prompt")))
    path, body = P.payload(F.col("prompt"), F.col("n_tokens"), system, o.model_or(P.CHAT_MODEL), o, routed=routed)
    short = (path == P.INSTRUCT) & (F.col("n_tokens") >= T.WINDOW)
    refused = F.when(~F.col("fits"), error("Unable to fit the text within the token limit", _TOO_LONG, None, X.utf16_length(F.col("t")), F.col("chars_removed"), o.max_tokens)).when(short, error("No room for an answer", _TOO_LONG))
    return rows.select("message_id", "prompt", "n_tokens", "chars_removed", "text_used", refused.alias("refused"), path.alias("path"), body.alias("body"))


def _asked(prepared: DataFrame, make_client: Callable[[], Client], o: P.Options, model: str, chat_only: bool = False, **run) -> DataFrame:
    """message_id, answer text, req_id, tokens, model, time_ms, chars_removed, error, for all rows; refused ones aren't sent.

    ``verbose`` adds text_used and request_id, the call's own random id, and logs requests and answers.
    """
    own = ["text_used"] if o.verbose else []
    rows = prepared.select("message_id", F.when(F.col("refused").isNull(), F.col("path")).alias("path"), "body", "refused", "chars_removed", *own)
    sent = call(rows, make_client, ["message_id", "refused", "chars_removed", *own], verbose=o.verbose, **run).withColumn("r", F.from_json("response", CHAT))
    return sent.select(
        "message_id",
        A.merge_choices(F.col("r.choices"), "\n" if chat_only else "", chat_only).alias("answer_text"),
        F.col("r.id").alias("req_id"),
        F.col("r.usage.total_tokens").alias("tokens"),
        F.coalesce("refused", "error").alias("error"),
        "time_ms",
        F.lit(model).alias("model"),
        *_told(o),
    )


def _told(o: P.Options) -> list[str]:
    """Columns about the call that results have beside the answer's."""
    return ["chars_removed", *(["text_used", "request_id"] if o.verbose else [])]


def _decoded(asked: DataFrame, extract: bool) -> DataFrame:
    """Adds ``json`` (strictly parsed and pruned) and an error where that fails."""
    found = A.json_object(F.col("answer_text")) if extract else F.col("answer_text")
    rows = asked.withColumn("p", A.strict_json(found))
    failed = error("Failed to parse output", "OutputParseFailed", F.col("answer_text"))
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("p.error").isNotNull(), failed))).withColumn("json", F.col("p.json")).drop("p")


def summarize(messages: DataFrame, make_client: Callable[[], Client], options: P.Options | None = None, **run) -> DataFrame:
    o = options or P.Options()
    rows = _decoded(_asked(prepare_summary(messages, o), make_client, o, o.model_or(P.CHAT_MODEL), **run), True)
    values = F.from_json("json", SUMMARY)
    return rows.withColumn("v", values).select("message_id", "req_id", "tokens", "model", "v.*", F.col("json").alias("raw_json"), "error", "time_ms", *_told(o))


def assess_risk(messages: DataFrame, make_client: Callable[[], Client], options: P.Options | None = None, **run) -> DataFrame:
    o = options or P.Options()
    prepared = prepare_risk(messages, o)
    asked = _asked(prepared, make_client, o, o.model_or(P.CHAT_MODEL), True, **run).withColumn("answer_text", A.strip_quotes(F.col("answer_text")))
    rows = _decoded(asked, False)
    known = F.col("json").isNotNull()
    risk = F.when(known, A.coerce_risk(F.coalesce(F.get_json_object("json", "$.risk"), F.lit("")), A.json_kind(F.col("json"), "$.risk")))
    return rows.select("message_id", "req_id", "tokens", "model", risk.alias("risk"), F.get_json_object("json", "$.assessment").alias("assessment"), "error", "time_ms", *_told(o))


def plan_question(questions: DataFrame, make_client: Callable[[], Client], options: P.Options | None = None, **run) -> DataFrame:
    o = options or P.Options()
    rows = _decoded(_asked(prepare_question(questions, o), make_client, o, o.model_or(P.INSTRUCT_MODEL), **run), True)
    return rows.withColumn("v", F.from_json("json", RETRIEVAL)).select("message_id", "req_id", "tokens", "model", "v.*", "error", "time_ms", *_told(o))


def answer(questions: DataFrame, make_client: Callable[[], Client], options: P.Options | None = None, **run) -> DataFrame:
    o = options or P.Options()
    rows = _asked(prepare_answer(questions, o), make_client, o, o.model_or(P.CHAT_MODEL), **run).withColumn("s", A.sections(F.col("answer_text")))
    return rows.select("message_id", "req_id", "tokens", "model", F.col("s.answer").alias("answer"), A.message_ids(F.col("s.ids")).alias("messageId"), "error", "time_ms", *_told(o))


def chunk(messages: DataFrame, size: int = T.CHUNK, tokenizer: str | None = None) -> DataFrame:
    """message_id, chunk_no, chunk: preamble and body of every message, ready to embed.

    ``tokenizer``: a vocabulary file that workers can read; chunks are cut by the pattern otherwise.
    """
    ship(messages.sparkSession)
    key, messages = F.col("headers"), H.listed(messages, "headers", "attachments")
    senders, receivers = (F.filter(key, lambda h: h.key == "from"), F.filter(key, lambda h: h.key.isin("to", "cc", "bcc")))
    value = lambda hs: F.transform(hs, lambda h: h.value)
    rows = messages.select("message_id", "headers", "attachments", X.reduce_links(X.choose_body(F.col("text"), F.col("html"), "embed")).alias("t"), value(senders).alias("f"), value(receivers).alias("r"))
    rows = rows.withColumn("f", H.parse_address_lists("f")).withColumn("r", H.parse_address_lists("r")).withColumn("s", H.decode_words(H.last_subject(key)))
    names = F.transform(F.filter(key, lambda h: h.key.isin("from", "to", "cc", "bcc")), lambda h: h.key)
    to_first = F.coalesce(F.get(names, F.lit(0)) != "from", F.lit(False))
    front = H.preamble(H.render_addresses(F.col("f")), H.render_addresses(F.col("r")), F.col("s"), H.last_date(key), H.attachment_names(F.col("attachments")), to_first)
    rows = rows.select("message_id", front.alias("front"), "t")
    cleaned = X.strip_quotes(F.col("t"))
    parts = T.bpe_chunks(tokenizer, size)(F.col("front"), cleaned, F.col("t")) if tokenizer else T.chunks(F.col("front"), cleaned, F.col("t"), size)
    # not posexplode: for it Spark filters on the list's size and makes the list twice
    return rows.select("message_id", F.posexplode_outer(parts).alias("chunk_no", "chunk")).where("chunk is not null")


def embed(messages: DataFrame, make_client: Callable[[], Client], options: P.Options | None = None, **run) -> DataFrame:
    """message_id, chunk_no, chunk, embedding, model, error, time_ms: a call a chunk."""
    o = options or P.Options()
    model = o.model_or(P.EMBEDDING_MODEL)
    rows = chunk(messages, o.chunk, o.tokenizer).withColumn("path", F.lit(P.EMBEDDINGS)).withColumn("body", F.to_json(F.struct(F.lit(model).alias("model"), F.col("chunk").alias("input"), F.lit(o.user).alias("user"))))
    sent = call(rows, make_client, ["message_id", "chunk_no", "chunk"], verbose=o.verbose, **run)
    vector = A.first_embedding(F.from_json("response", EMBEDDING).data)
    return sent.select("message_id", "chunk_no", "chunk", vector.alias("embedding"), F.lit(model).alias("model"), "error", "time_ms", *(["request_id"] if o.verbose else []))


def nest(chunks: DataFrame) -> DataFrame:
    """Chunks of a message in order in one list; a message with a failed chunk has the error and no list."""
    part = F.struct("chunk_no", "chunk", "embedding")
    rows = chunks.groupBy("message_id", "model").agg(F.array_sort(F.collect_list(part)).alias("e"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_no"))).alias("error"))
    return rows.select("message_id", "model", F.when(F.col("error").isNull(), F.transform("e", lambda x: F.struct(x.chunk.alias("chunk"), x.embedding.alias("embedding")))).alias("embeddings"), "error")
