"""From an API's answer to values."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import js_trim


def merge_choices(choices: Column, glue: str = "", chat_only: bool = False) -> Column:
    """The answers' text in order of index (stable), joined and trimmed; null without choices."""
    content = lambda c: F.when((c.message.role == "assistant") & (c.message.content != ""), c.message.content)
    text = (lambda c: content(c)) if chat_only else (lambda c: F.coalesce(content(c), F.when(c.text != "", F.coalesce(F.when(c.message.content != "", c.message.content), c.text))))
    rows = F.transform(choices, lambda c, i: F.struct(F.coalesce(c["index"], F.lit(0)).alias("k"), i.alias("i"), text(c).alias("t")))
    kept = F.array_sort(F.filter(rows, lambda r: r.t.isNotNull()))
    return F.when(choices.isNotNull(), js_trim(F.array_join(F.transform(kept, lambda r: r.t), glue)))


def strip_quotes(text: Column) -> Column:
    """Without one quotation mark at either end."""
    return js_trim(F.regexp_replace(F.regexp_replace(text, '^\\s*"', ""), '"\\s*$', ""))


def json_object(text: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    found = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    return F.when(found != "", found)


def prune(value):
    """Members that are null or empty go, at any depth; list elements stay."""
    if isinstance(value, dict):
        return {k: prune(v) for k, v in value.items() if v is not None and v != ""}
    return [prune(v) for v in value] if isinstance(value, list) else value


def _bad_constant(name: str):
    raise ValueError(name)


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("error", StringType())]))
def strict_json(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Strictly parsed, pruned and written again; or what is wrong."""
    for s in texts:
        out = []
        for t in s:
            try:
                out.append((json.dumps(prune(json.loads(t, parse_constant=_bad_constant)), ensure_ascii=False, separators=(",", ":")), None))
            except (TypeError, ValueError):
                out.append((None, "Failed to parse output"))
        yield pd.DataFrame(out, columns=["json", "error"])


def overlay(json_text: Column, req_id: Column, tokens: Column, model: Column) -> Column:
    """The answer's members as a map, with id, tokens and model put over its own."""
    own = F.from_json(json_text, "map<string,string>")
    meta = F.create_map(F.lit("id"), req_id.cast("string"), F.lit("tokens"), tokens.cast("string"), F.lit("model"), model.cast("string"))
    return F.map_concat(F.map_filter(own, lambda k, v: ~k.isin("id", "tokens", "model")), meta)


def json_kind(json_text: Column, path: str) -> Column:
    """The type of a JSON text's member (``STRING``, ``BOOLEAN``, ...); null if there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json_text), path, "variant"))


def coerce_risk(risk: Column, kind: Column | None = None) -> Column:
    """A number from JSON's text; what isn't one, and 0, is -1.  Of kind ``STRING``, ``true`` isn't one."""
    t = js_trim(risk)
    true = t == "true" if kind is None else (t == "true") & ~kind.eqNullSafe("STRING")
    n = F.when(true, F.lit(1.0)).when(t.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    return F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(-1.0))


_LABEL = "(?i)(^|\\n)[*\\x60]*(Answer:|Message-ID:)[*\\x60]*"


def sections(text: Column) -> Column:
    """(answer, ids): a labelled answer's parts; text before the first label is left out."""
    marked = F.regexp_replace(F.regexp_replace(js_trim(text), "\\r\\n", "\n"), _LABEL, "\u0001$2\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001", -1), js_trim), lambda p: p != "")
    start = F.struct(F.lit("").alias("key"), F.lit("").alias("answer"), F.lit("").alias("ids"))
    joined = lambda old, new: F.when(old == "", new).otherwise(F.concat(old, F.lit("\n"), new))
    of_ids = lambda p: F.array_join(F.filter(F.transform(F.split(p, ","), js_trim), lambda x: x != ""), "\n")

    def fold(acc: Column, p: Column) -> Column:
        label = F.lower(F.regexp_replace(p, ":$", ""))
        return (
            F.when(F.lower(p).isin("answer:", "message-id:"), F.struct(label.alias("key"), acc.answer.alias("answer"), acc.ids.alias("ids")))
            .when(acc.key == "answer", F.struct(acc.key.alias("key"), joined(acc.answer, p).alias("answer"), acc.ids.alias("ids")))
            .when(acc.key == "message-id", F.struct(acc.key.alias("key"), acc.answer.alias("answer"), joined(acc.ids, of_ids(p)).alias("ids")))
            .otherwise(acc)
        )

    return F.aggregate(parts, start, fold)


def message_ids(ids: Column) -> Column:
    """Different ids in the order they came; null if none."""
    return F.when(ids != "", F.array_distinct(F.split(ids, "\n")))


def first_embedding(data: Column) -> Column:
    return F.get(data, F.lit(0)).embedding
