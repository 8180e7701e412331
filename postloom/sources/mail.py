"""Messages from .eml files and from mail-store records; results to JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGE
from ..session import ship


def parse(raw: bytes) -> dict:
    """headers (lower-case keys, in order), attachments, text, html of one message."""
    from email import policy
    from email.parser import BytesParser

    m = BytesParser(policy=policy.compat32).parsebytes(raw)
    out = {"headers": [{"key": k.lower(), "value": " ".join(str(v).split("\n")).replace("\r", "")} for k, v in m.items()], "attachments": [], "text": None, "html": None}
    for part in m.walk():
        if part.is_multipart():
            continue
        name, kind = part.get_filename(), part.get_content_type()
        if name or part.get_content_disposition() == "attachment":
            out["attachments"].append({"filename": name, "contentType": kind})
        elif kind in ("text/plain", "text/html"):
            body = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
            own = "text" if kind == "text/plain" else "html"
            out[own] = body if out[own] is None else out[own] + body
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """Messages of a frame with ``path`` and ``content``; the path is the id."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"message_id": p} | parse(bytes(c)) for p, c in zip(batch["path"], batch["content"])], columns=["message_id", "headers", "attachments", "text", "html"])

    return files.select("path", "content").mapInPandas(run, MESSAGE)


def read_eml(spark: SparkSession, path: str, seed: int | None = None, most: int | str | None = None) -> DataFrame:
    """All .eml files (any case) below a path; shuffled by ``seed``; the first ``most`` if it is over 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][mM][lL]").option("recursiveFileLookup", "true").load(path)
    if seed is not None:
        files = files.orderBy(F.rand(seed))
    try:
        n = abs(int(float(most or 0)))
    except ValueError:
        n = 0
    return parse_files(files.limit(n) if n else files)


def headers_of_map(headers: Column) -> Column:
    """A map of name to values as the ordered list of single headers."""
    return F.flatten(F.transform(F.map_entries(headers), lambda e: F.transform(e.value, lambda v: F.struct(F.lower(e.key).alias("key"), v.alias("value")))))


def write_json(results: DataFrame, path: str) -> None:
    """A JSON object a row; rows with an error are kept with it."""
    results.write.mode("errorifexists").json(path)
