"""Awkward documents that every operator gets."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _hits string, label string, spans string"


def awkward(spark, extra=()):
    texts = [
        None, "", " ", "\n\n", "a", "one two three", "日本語 テキスト です", "x " * 40_000, "é" * 3000, "a  b\n \nc\td ",
        "the quick brown fox jumps over the lazy dog\nthe quick brown fox jumps over the lazy dog",
        "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog",
        "mail a.b@c.de, 10.0.0.1 +1 (555) 010-9999 4111 1111 1111 1111 end", "😀 a@b.co 😀 c@d.ef_g@h.ij",
        *extra,
    ]
    rows = [(k, t, "en" if k % 3 else None, "s", 1, "clash", "clash", "clash") for k, t in enumerate(texts)]
    rows += [rows[10], (None, "null id here now and then", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
