"""Body text as native column functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JavaScript's white space and line ends, which the message format is defined by.
WHITE = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_LINE = "\\n\\r\\u2028\\u2029"
_BOL, _EOL = f"(?<![^{_LINE}])", f"(?![^{_LINE}])"
#: What follows a host in a link, without the punctuation of the sentence around it.
_PATH = "(?:[/?#](?:[^\\s<>\"']*[^\\s<>\"'.,;:!?)])?)?"
MAX_TEXT = 65_536
#: Endings of bare hosts: country codes, internationalised ones and the common generic ones; ``reduce_links`` takes a longer list.
ENDINGS = (
    "[a-z]{2}", "xn--[a-z0-9-]+", "com", "org", "net", "edu", "gov", "mil", "int", "arpa", "info", "biz", "name", "pro", "aero", "coop", "museum", "jobs", "mobi", "travel", "tel", "cat", "asia", "post", "onion",
    "app", "dev", "page", "web", "site", "online", "store", "shop", "blog", "cloud", "email", "tech", "agency", "company", "digital", "global", "group", "media", "network", "news", "studio", "systems", "team", "tools", "top", "world", "xyz", "club", "link", "live", "space", "website", "wiki", "work", "zone",
)


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def utf16_prefix(s: Column, n: Column | int) -> Column:
    """The first ``n`` UTF-16 units; half of a pair at the end is left out."""
    n = F.lit(n) if isinstance(n, int) else n
    short = F.length(s) == utf16_length(s)  # no character outside the basic plane
    raw = F.encode(s, "UTF-16BE")
    half = (n > 0) & F.hex(F.substring(raw, (n * 2 - 1).cast("int"), F.lit(1))).between("D8", "DB")
    units = F.decode(F.substring(raw, F.lit(1), (F.when(half, n - 1).otherwise(n) * 2).cast("int")), "UTF-16BE")
    return F.when(short, F.substring(s, F.lit(1), n.cast("int"))).otherwise(units)


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{WHITE}]+|[{WHITE}]+$(?![\\s\\S])", "")


def flatten_white(s: Column) -> Column:
    """Each white space character becomes a blank."""
    return F.regexp_replace(s, f"[{WHITE}]", " ")


def html_to_text(html: Column) -> Column:
    """Words of a page: no tags, scripts or comments; blocks on lines of their own."""
    t = F.regexp_replace(html, "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<!--.*?-->", "")
    t = F.regexp_replace(t, "(?i)<br\\s*/?>|</(p|div|li|h[1-6])\\s*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", "")
    t = F.regexp_replace(t, "[ \\t\\r\\f]+", " ")
    t = F.regexp_replace(t, " ?\\n ?", "\n")
    t = F.regexp_replace(t, "\\n\\n+", "\n\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.regexp_replace(t, "^[ \\n]+|[ \\n]+$(?![\\s\\S])", "")


def reduce_links(t: Column, endings: Iterable[str] = ENDINGS) -> Column:
    """Links become scheme and host (with port); e-mail addresses a bare ``mailto://``; bare hosts and IPv4 addresses get ``http://``.

    ``endings`` are the top-level domains under which a bare host is a link, as patterns.
    """
    t = F.regexp_replace(t, "(?i)\\b((?:https?|ftp|git)://)(?:[^\\s/?#@]*@)?([a-z0-9\\[][a-z0-9.:\\[\\]-]*[a-z0-9\\]])" + _PATH, "$1$2")
    t = F.regexp_replace(t, "(?i)\\b(?:https?|ftp|git)://(?![a-z0-9\\[])[^\\s<>\"']*", " ")
    t = mask_emails(t)
    part = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    host = f"(?:[a-z0-9-]++\\.(?=[a-z0-9]))++(?:{'|'.join(endings)})(?!\\.?[a-z0-9-])|{part}(?:\\.{part}){{3}}(?!\\.?[a-z0-9-])"
    return F.regexp_replace(t, f"(?i)(?<![a-z0-9@./:_-])((?:{host})(?::[0-9]{{1,5}})?){_PATH}", "http://$1")


def mask_emails(t: Column) -> Column:
    own = "[a-z0-9._%+-]"  # a match begins where a run of these does, so that long runs stay linear
    return F.regexp_replace(t, f"(?i)(?:mailto:|\\G|(?<!{own})){own}++@[a-z0-9-]++(?:\\.[a-z0-9-]++)++", "mailto://")


def normal_newlines(t: Column) -> Column:
    return F.regexp_replace(t, "\\r\\n", "\n")


def strip_quotes(t: Column) -> Column:
    """Quoted lines go, with blank lines before them; then blank lines are emptied and runs of line ends shortened to two."""
    # a run of blanks is read once: from the text's beginning, or from its first line end on
    quoted = f"(?:\\A|(?:\\G|(?<![{WHITE}]))([{WHITE}&&[^{_LINE}]]*+[{_LINE}]))[{WHITE}]*+>[^{_LINE}]*+"
    t = F.regexp_replace(normal_newlines(t), quoted, "$1")
    t = F.regexp_replace(t, f"{_BOL}[{WHITE}]+{_EOL}", "")
    return F.regexp_replace(t, "\\n\\n+", "\n\n")


def clamp(t: Column, most: int = MAX_TEXT) -> tuple[Column, Column]:
    """The text cut to ``most`` units, and how many went."""
    n = utf16_length(t)
    return F.when(n > most, utf16_prefix(t, most)).otherwise(t), F.greatest(n - most, F.lit(0))


def choose_body(text: Column, html: Column, rule: str) -> Column:
    """Text or the page's text: ``summary``, ``risk`` (only pages over twice as long) or ``embed`` (trimmed)."""
    text = F.coalesce(text, F.lit(""))
    if rule == "embed":
        text = js_trim(text)
    a, b = utf16_length(html), utf16_length(text)
    longer = a > 2 * b if rule == "risk" else a >= b
    page = html_to_text(html)
    use = html.isNotNull() & (html != "") & ((text == "") | longer)
    return F.when(use, js_trim(page) if rule == "embed" else page).otherwise(text)
