"""Prompts, request payloads and options.

Each prompt is worded here; what it asks for is the answer format of ``schemas``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.text import clamp, js_trim, utf16_length, utf16_prefix

CHAT_MODEL, INSTRUCT_MODEL, EMBEDDING_MODEL = "gpt-5-mini", "gpt-3.5-turbo-instruct", "text-embedding-ada-002"
CHAT, INSTRUCT, EMBEDDINGS, MODELS = "/v1/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/models"
API = "https://api.openai.com"

SUMMARY_SYSTEM = "You read e-mail for a busy person and report what matters."
SUMMARY_USER = """
Describe the e-mail below as one JSON object with these members:
sentiment ("positive", "neutral" or "negative"), summary (150 characters at most),
shouldReply (boolean), riskAssessment {risk (1 safe to 5 malicious), assessment (a sentence)},
and, where there is something to say, replyText, events
[{description, location, startTime, endTime, type, confidence}] and actions
[{description, dueDate, confidence}].
Weigh passing SPF, DKIM and DMARC results against failing ones. Write times in ISO 8601 as the
message means them. Mailing lists and automatic mail need no reply. Answer in English.
""".strip()
SUMMARY_SCHEMA = "The e-mail is a JSON object: headers [{key, value}], attachments [{filename, contentType}], text."
RISK_SYSTEM = re.sub(r"\s+", " ", "You judge whether an e-mail is dangerous to its reader.")
RISK_USER = """
Consider the sender's authentication, look-alike domains, pressure and urgency, requests for money,
credentials or personal data, unusual links and attachments, impersonation, and mismatches between
the headers and the text. Answer with JSON alone: {"risk": a number from 1 (harmless) to 5
(malicious), "assessment": one sentence}.
""".strip()
ANSWER_SYSTEM = "You answer questions from the e-mails you are given and from nothing else."
ANSWER_USER = """
Below are a person's question as JSON and e-mails that may hold the answer. Each begins with
"- EMAIL #n:" and header lines with a Message-ID. Reply as:
Answer: the answer, or that it isn't known
Message-ID: the ids that the answer rests on, separated by commas
""".strip()
QUESTION_SYSTEM = "You turn questions about a mailbox into search instructions."
QUESTION_USER = """
Answer with one JSON object: ordering ("older_first", "newer_first" or "best_match"), start_time and
end_time (ISO dates, where the question sets bounds), topic (what to look for).
""".strip()


@dataclass
class Options:
    """What a caller can choose; the token never enters a plan."""

    base_url: str | None = None
    model: str | None = None
    system_prompt: str | None = None
    user_prompt: str | None = None
    max_tokens: int = T.BUDGET
    temperature: object = None
    top_p: object = None
    user: str | None = None
    allowed_headers: object = None
    chunk: int = T.CHUNK
    verbose: bool | str = False  # results have request_id and text_used, and workers log requests and answers; "columns": without the log
    tokenizer: str | None = None  # a vocabulary file that workers can read; the pattern otherwise
    as_of: str | None = None
    old_count: bool = False

    def model_or(self, default: str) -> str:
        return self.model or default


def number(value: object) -> float | None:
    """An optional parameter: sent if true and numeric; the number 0 isn't, the text '0' is."""
    if not value or isinstance(value, bool) and value is False:
        return None
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def resolve_url(base: str | None = None, path: str | None = None) -> str:
    """The request's URL below a base that may have a path, with /v1 once."""
    from urllib.parse import urlsplit, urlunsplit

    u = urlsplit(base or API)
    root, rest = u.path.rstrip("/"), path or "/"
    if root.endswith("/v1") and re.match(r"/v1(/|$)", rest):
        rest = rest[3:] or "/"
    return urlunsplit((u.scheme, u.netloc, root + rest, u.query, u.fragment))


def api_url(base: Column, path: Column) -> Column:
    """``resolve_url`` for columns of URLs without query."""
    base = F.coalesce(F.when(base != "", base), F.lit(API))
    root = F.regexp_replace(base, "/+$", "")
    rest = F.coalesce(F.when(path != "", path), F.lit("/"))
    twice = root.rlike("^[a-z]+://[^/]+(/.*)?/v1$") & rest.rlike("^/v1(/|$)")
    short = F.substring(rest, 4, 1_000_000)
    return F.concat(root, F.when(twice, F.when(short == "", "/").otherwise(short)).otherwise(rest))


def content_json(headers: Column, attachments: Column, text: Column) -> Column:
    return F.to_json(F.struct(headers.alias("headers"), attachments.alias("attachments"), text.alias("text")))


def fitted(text: Column, wrapped, options: Options, old_count: bool = False, counter=T.count) -> Column:
    """(kept, removed, fits) as a struct: make it a column of its own, so that it is evaluated once."""
    cut, gone = clamp(text)
    state = T.fit(cut, wrapped, options.max_tokens, lambda s, n: F.when(n >= utf16_length(s), s).otherwise(utf16_prefix(s, n)), utf16_length(cut), counter, old_count)
    return F.transform(F.array(state), lambda z: F.struct(z.kept.alias("kept"), (gone + z.removed).cast("int").alias("removed"), z.fits.alias("fits")))[0]


def summary_prompt(content: Column, user: str | None = None) -> Column:
    return F.concat(F.lit((user or SUMMARY_USER).strip() + "\n" + SUMMARY_SCHEMA + "\n\n"), content)


def risk_prompt(content: Column, user: str | None = None) -> Column:
    return F.concat(F.lit((user or RISK_USER) + "\n\n"), content)


def answer_prompt(question: Column, name: Column, email: Column, context: Column, as_of: str | None = None) -> Column:
    asked = F.to_json(F.struct(name.alias("name"), email.alias("email"), question.alias("question")))
    now = f"\nThe time is {as_of}." if as_of else ""
    return F.concat(F.lit(ANSWER_USER + now + "\n\n"), asked, F.lit("\n\n"), context)


def question_prompt(question: Column, as_of: str | None = None) -> Column:
    now = f"\nThe time is {as_of}." if as_of else ""
    return F.concat(F.lit(QUESTION_USER + now + "\n"), question, F.lit("\n"))


def context_text(context: Column, is_list: bool = False) -> Column:
    return js_trim(F.coalesce(F.array_join(context, ",") if is_list else context, F.lit("")))


def payload(prompt: Column, n_tokens: Column, system: str, model: Column | str, options: Options, default_temperature: float | None = None, routed: bool = True) -> tuple[Column, Column]:
    """(path, JSON body): chat, or the instruct form for that one model."""
    model = F.lit(model) if isinstance(model, str) else model
    chosen = number(options.temperature)
    temperature = chosen if chosen is not None else default_temperature
    extra = [F.lit(options.user).alias("user"), F.lit(temperature).cast("double").alias("temperature"), F.lit(number(options.top_p)).cast("double").alias("top_p")]
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    chat = F.to_json(F.struct(model.alias("model"), F.array(turn("system", F.lit(system)), turn("user", prompt)).alias("messages"), *extra))
    instruct = F.to_json(F.struct(model.alias("model"), F.concat(F.lit(system + "\n"), prompt).alias("prompt"), (F.lit(T.WINDOW) - n_tokens).alias("max_tokens"), *extra))
    if not routed:
        return F.lit(CHAT), chat
    is_instruct = model == INSTRUCT_MODEL
    return F.when(is_instruct, INSTRUCT).otherwise(CHAT), F.when(is_instruct, instruct).otherwise(chat)
