"""Header and attachment operators; lists keep their order and repeated keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import flatten_white, js_trim

# fixed values: the headers that a prompt may show
ALLOWED = (
    "from",
    "to",
    "cc",
    "bcc",
    "subject",
    "mime-version",
    "authentication-results",
    "arc-authentication-results",
    "arc-message-signature",
    "arc-seal",
    "date",
    "content-type",
    "list-id",
)
# fixed values: headers of which the first alone counts
FIRST_SUMMARY = ("authentication-results", "arc-authentication-results", "arc-message-signature", "arc-seal")
FIRST_RISK = ("authentication-results",)
#: Types as objects: workers have no session to parse names with.
_ADDRESSES = ArrayType(StructType([StructField("name", StringType()), StructField("address", StringType())]))


def allowed_keys(extra: Iterable[object] | str | None = None) -> list[str]:
    """The allowed keys with the caller's own before them, in lower case, each once."""
    if not extra:
        return list(ALLOWED)
    own = [extra] if isinstance(extra, str) else list(extra)
    return list(dict.fromkeys(k for k in (str(x or "").strip().lower() for x in [*own, *ALLOWED]) if k))


def listed(df: DataFrame, *names: str) -> DataFrame:
    """Columns that hold a lone struct become lists of it (of nothing, if it is null)."""
    lone = [n for n in names if isinstance(df.schema[n].dataType, StructType)]
    return df.withColumns({n: F.when(F.col(n).isNotNull(), F.array(n)).otherwise(F.array()) for n in lone}) if lone else df


def whitelist(headers: Column, allowed: Iterable[str] = ALLOWED) -> Column:
    keys = F.array(*(F.lit(k) for k in allowed))
    return F.filter(F.coalesce(headers, F.array()), lambda h: F.coalesce(F.array_contains(keys, h.key), F.lit(False)))


def first_wins(headers: Column, keys: Iterable[str] = FIRST_SUMMARY) -> Column:
    """Of headers with one of these keys, the first of each key."""
    once = F.array(*(F.lit(k) for k in keys))
    names = F.transform(headers, lambda h: h.key)
    return F.filter(headers, lambda h, i: ~F.coalesce(F.array_contains(once, h.key), F.lit(False)) | (F.array_position(names, h.key) == i + 1))


def attachments(items: Column, keep_empty: bool = False) -> Column:
    """Name and type of each attachment; those with neither go unless ``keep_empty``."""
    both = F.transform(F.coalesce(items, F.array()), lambda a: F.struct(a.filename.alias("filename"), a.contentType.alias("contentType")))
    return both if keep_empty else F.filter(both, lambda a: (F.coalesce(a.filename, F.lit("")) != "") | (F.coalesce(a.contentType, F.lit("")) != ""))


def attachment_names(items: Column) -> Column:
    """Names in one line, null if none."""
    names = F.filter(F.transform(F.coalesce(items, F.array()), lambda a: js_trim(flatten_white(a.filename))), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.when(F.size(names) > 0, F.array_join(names, " ; "))


def render_addresses(addresses: Column) -> Column:
    """``name <address>`` of each, in one string; null if nothing is left."""
    one = lambda a: F.concat_ws(" ", F.when(a["name"] != "", a["name"]), F.when(a.address != "", F.concat(F.lit("<"), a.address, F.lit(">"))))
    shown = F.filter(F.transform(addresses, one), lambda s: s != "")
    return F.when(F.size(shown) > 0, F.array_join(shown, " ; "))


def _decode(text: str) -> str:
    from email.header import decode_header

    try:
        return "".join(part.decode(charset or "ascii", "replace") if isinstance(part, bytes) else part for part, charset in decode_header(text))
    except Exception:  # as it was
        return text


def _address(address: str) -> str:
    if "@xn--" in address:
        local, _, domain = address.rpartition("@")
        try:
            return f"{local}@{domain.encode('ascii').decode('idna')}"
        except Exception:  # as it was
            return address
    return address


@F.pandas_udf(_ADDRESSES)
def parse_addresses(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Addresses of header values, groups flattened, names decoded, domains in Unicode."""
    from email.utils import getaddresses

    for s in values:
        yield s.map(lambda v: [{"name": _decode(n), "address": _address(a)} for n, a in getaddresses([_ungrouped(v)]) if n or a] if v else [])


@F.pandas_udf(_ADDRESSES)
def parse_address_lists(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As ``parse_addresses`` over lists of header values, each parsed on its own."""
    from email.utils import getaddresses

    for s in values:
        yield s.map(lambda vs: [{"name": _decode(n), "address": _address(a)} for v in (() if vs is None else vs) if v for n, a in getaddresses([_ungrouped(v)]) if n or a])


def _ungrouped(value: str) -> str:
    """``label: a, b;`` as ``a, b``."""
    import re

    return re.sub(r"(^|,)\s*[^,:;<>\"@]+:([^;]*);", r"\1\2", value)


@F.pandas_udf(StringType())
def decode_words(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """MIME words decoded; what can't be decoded stays."""
    for s in values:
        yield s.map(lambda v: None if v is None else _decode(v))


def last_subject(headers: Column) -> Column:
    """The last subject that isn't empty, trimmed (before decoding)."""
    found = F.filter(F.transform(F.filter(headers, lambda h: h.key == "subject"), lambda h: js_trim(F.coalesce(h.value, F.lit("")))), lambda s: s != "")
    return F.when(F.size(found) > 0, F.element_at(found, -1))


#: Date forms understood, after the weekday and a trailing comment are gone; others are invalid.
DATES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy")


def parse_date(value: Column) -> Column:
    core = F.regexp_replace(F.regexp_replace(js_trim(value), "^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\\s+", ""), "\\s*\\([^)]*\\)\\s*$", "")
    return F.coalesce(*(F.try_to_timestamp(core, F.lit(f)) for f in DATES))


def utc_date(t: Column) -> Column:
    """RFC 1123 form; the session's time zone must be UTC."""
    return F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def last_date(headers: Column) -> Column:
    """The last valid date of the date headers, in RFC 1123 form, else null."""
    found = F.filter(F.transform(F.filter(headers, lambda h: h.key == "date"), lambda h: parse_date(h.value)), lambda t: t.isNotNull())
    return F.when(F.size(found) > 0, utc_date(F.element_at(found, -1)))


def preamble(sender: Column, receivers: Column, subject: Column, date: Column, names: Column, to_first: Column | None = None) -> Column:
    """Lines of what is known, then an empty line; ``to`` leads if its header came first."""
    line = lambda k, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), flatten_white(v) if k in ("from", "to") else v))
    a, b = line("from", sender), line("to", receivers)
    first = F.lit(False) if to_first is None else to_first
    lines = F.concat_ws("\n", F.when(first, b).otherwise(a), F.when(first, a).otherwise(b), line("subject", subject), line("date", date), line("attachments", names))
    return F.concat(lines, F.lit("\n\n"))
