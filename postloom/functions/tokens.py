"""Token counts, chunking and budgeted truncation.

The default tokenizer is a pattern evaluated in the JVM; ``bpe_count``, ``bpe_chunks`` and
``bpe_fit`` use a vocabulary file instead.  Cutting and counting follow the same rules with either.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

TOKEN = " ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+"
CHUNK, LEAST_BODY = 400, 200
BUDGET, WINDOW = 30_000, 4_000
STEPS = 94
#: Stands for the text in a prompt whose budget is counted with a vocabulary.
MARK = "\uf8ff\ue123\uf8ff"
FITTED = StructType([StructField("kept", IntegerType()), StructField("removed", IntegerType()), StructField("fits", BooleanType())])
#: Fixed values: (above this many units, units that truncation takes off).
LADDER = ((2 * 1024 * 1024, 1024 * 1024), (2048, 1024), (512, 256), (200, 100), (20, 10), (1, 1))


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))


def count(s: Column) -> Column:
    """How many tokens; every character is in one, so each token is put as one character and these are counted."""
    return F.length(F.regexp_replace(s, TOKEN, "x"))


def _vocabulary(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # a special token's name in a text is text
    return t


def _ids(t, texts: Iterable[str]) -> list[list[int]]:
    return [x.ids for x in t.encode_batch(list(texts), add_special_tokens=False)]


def bpe_count(path: str) -> Callable[[Column], Column]:
    """A counter with the vocabulary in ``path``; not for use inside lambdas (see ``bpe_fit``, ``bpe_chunks``)."""

    @F.pandas_udf(IntegerType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _vocabulary(path)
        for s in batches:
            yield pd.Series([len(x) for x in _ids(t, s.fillna(""))])

    return counted


def bpe_chunks(path: str, chunk: int = CHUNK) -> Callable[[Column, Column, Column], Column]:
    """``chunks`` with the vocabulary in ``path``: of (preamble, cleaned, raw)."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        t = _vocabulary(path)
        for front, cleaned, raw in batches:
            out = []
            for f, n, ids, r in zip(front, (len(x) for x in _ids(t, front)), _ids(t, cleaned.fillna("")), raw):
                size = max(LEAST_BODY, chunk - n)
                out.append([f + t.decode(ids[k : k + size], skip_special_tokens=False) for k in range(0, len(ids), size)] if r else [f])
            yield pd.Series(out)

    return cut


def bpe_fit(path: str, budget: int, escaped: bool = True, old_count: bool = False) -> Callable[[Column, Column], Column]:
    """``fit`` with the vocabulary in ``path``: of (prompt with ``MARK`` for the text, text).

    ``escaped``: the text stands in the prompt as in a JSON string.
    """

    @F.pandas_udf(FITTED)
    def fitted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = _vocabulary(path)
        for prompts, texts in batches:
            out = []
            for prompt, text in zip(prompts, texts):
                units, removed = (text or "").encode("utf-16-le", "surrogatepass"), 0
                kept = len(units) // 2
                while True:
                    part = units[: 2 * kept].decode("utf-16-le", "ignore")
                    whole = prompt.replace(MARK, json.dumps(part, ensure_ascii=False)[1:-1] if escaped else part)
                    d = _step(kept)
                    # a token has a byte at least
                    if len(whole.encode()) <= budget or len(_ids(t, [whole])[0]) <= budget:
                        out.append((kept, removed, True))
                        break
                    if not d:
                        out.append((kept, removed, False))
                        break
                    kept, removed = kept - d, removed + (255 if old_count and d == 256 else d)
            yield pd.DataFrame(out, columns=["kept", "removed", "fits"])

    return fitted


def body_size(prefix_tokens: Column, chunk: int = CHUNK) -> Column:
    """Tokens of body in a chunk: what the preamble leaves, 200 at least."""
    return F.greatest(F.lit(LEAST_BODY), F.lit(chunk) - prefix_tokens)


def chunks(preamble: Column, cleaned: Column, raw: Column, chunk: int = CHUNK) -> Column:
    """Preamble and body in chunks; an empty ``raw`` text is one chunk, one that cleans to nothing is none."""

    def cut(z: Column) -> Column:  # the tokens are bound once, not made again for each chunk
        n = F.size(z.body)
        parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), z.size), lambda i: F.concat(z.front, F.array_join(F.slice(z.body, i + 1, z.size), "")))
        return F.when(n > 0, parts).otherwise(F.array().cast("array<string>"))

    bound = F.struct(tokens(cleaned).alias("body"), body_size(count(preamble), chunk).alias("size"), preamble.alias("front"))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array(preamble)).otherwise(F.transform(F.array(bound), cut)[0])


def step(n: Column) -> Column:
    """How many units truncation takes off a text of ``n``; 0: no more."""
    out = F.lit(0)
    for above, d in reversed(LADDER):
        out = F.when(n > above, d).otherwise(out)
    return out


def _step(n: int) -> int:
    return next((d for above, d in LADDER if n > above), 0)


def fit(text: Column, wrapped: Callable[[Column], Column], budget: int, cut: Callable[[Column, Column], Column], length: Column, counter: Callable[[Column], Column] = count, old_count: bool = False) -> Column:
    """(kept, removed, fits): the longest length on the ladder whose wrapped prompt has at most ``budget`` tokens.

    A length is tried only while none before it fits.  ``old_count`` counts 255 for a step of 256.
    """
    state = F.struct(length.cast("int").alias("kept"), F.lit(0).alias("removed"), F.lit(False).alias("fits"))

    def tried(acc: Column, _: Column) -> Column:
        d = step(acc.kept)
        counted = F.when(d == 256, 255).otherwise(d) if old_count else d
        prompt = wrapped(cut(text, acc.kept))
        fine = (F.octet_length(prompt) <= budget) | (counter(prompt) <= budget)  # a token has a byte at least
        return F.when(acc.fits, acc).when(fine, F.struct(acc.kept.alias("kept"), acc.removed.alias("removed"), F.lit(True).alias("fits"))).otherwise(
            F.struct((acc.kept - d).cast("int").alias("kept"), (acc.removed + counted).cast("int").alias("removed"), F.lit(False).alias("fits"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), state, tried)
