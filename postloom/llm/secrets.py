"""Secret scan with a random forest (operator 5).

Patterns propose candidates in every whole text: values after a credential's name, known
key shapes, private key blocks through their end, and long runs of key characters, of any length.  A random forest removes false
positives.  It sees a candidate's length, its character transitions (by class, and their
likelihood among the corpus's words), how much of it dictionary words cover, the path
(the document's source) and the neighbouring words.

The dictionary and the transitions come from all documents: words in letters are
counted everywhere and the most frequent, ``DICTIONARY`` at most, are the dictionary.  The forest
is trained on labelled findings: by default ``labelled_findings``, made from published
key formats and from look-alikes (digests, identifiers, versions, words); a table of
one's own with the columns text, before, after, path, secret can be given instead, of
which at most ``FIT_ROWS`` are used.

Findings carry a hash of the secret, never the secret.  Nulls: a null text has no
findings; a null source is an empty path; a null ``doc_id`` is kept.  Empty texts have
none, very long texts are read whole, repeated rows have equal findings.  An empty table
gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches, materialise, slices, texts_of

DICTIONARY, FIT_ROWS, TREES, DEPTH = 20_000, 20_000, 40, 9
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer"
_PEM = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = re.compile(
    # a value ends before a key block
    rf"(?i:(?P<name>{NAMES})\w*+[\"']?\s{{0,3}}(?:=|:|=>)\s{{0,3}}[\"']?(?P<value>(?:(?!(?-i:{_PEM}))[^\s\"',;]){{6,}}+))"
    r"|(?P<known>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{24})"
    # a block through its end; without one, through the runs of key characters that follow
    rf"|(?P<pem>{_PEM}(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]{{0,30}}PRIVATE KEY-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{{20,}}+={{0,2}})*+))"
    r"|(?<![A-Za-z0-9+/_=-])(?P<run>[A-Za-z0-9+/_-]{20,}+={0,2})(?![A-Za-z0-9+/_=-])"
)
#: A JWT; if the first eyJ of a run of its characters begins none, no later one of that run does.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(?P<jwt>eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)")
#: A text without any of these has no candidate (for Arrow's engine; Python folds the dotted and dotless i with i).
MAY = rf"(?i)(?:{NAMES.replace('i', '[iİı]')})|[A-Za-z0-9+/_-]{{20}}|-----BEGIN|xox[abprs]-|eyJ"
KINDS = ("value", "known", "pem", "run")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
OUT = "doc_id long, kind string, start long, end long, secret_sha256 string, score double, is_secret boolean"


def corpus_words(docs: DataFrame, size: int = DICTIONARY) -> list[tuple[str, int]]:
    """The words of three letters or more that are frequent enough in all documents that at most ``size`` are, with their counts.

    The least count is found from a histogram of the counts' logarithms and, within the one step
    where ``size`` is passed, from the different counts there: few rows, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 12_000_000):
            flat = pc.split_pattern(pc.replace_substring(pc.utf8_lower(texts_of(batch, "text")), "\n", " "), " ").flatten()
            counted = pc.value_counts(pc.ascii_trim(flat, ".,;:!?()\"'"))
            word, n = counted.field(0), counted.field(1)
            ok = pc.match_substring_regex(word, "^\\p{L}{3,}$")
            yield pa.RecordBatch.from_pydict({"word": word.filter(ok), "n": n.filter(ok)})

    counts = materialise(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the least count that at most ``size`` words reach
    least, total, step = None, 0, F.floor(F.log2("n") * 16)
    for r in sorted(counts.groupBy(step.alias("k")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r["k"]):
        if total + r["words"] <= size:
            total, least = total + r["words"], r["n"]
            continue
        for s in sorted(counts.where(step == r["k"]).groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda s: -s["n"]):
            total += s["words"]
            if total > size:
                break
            least = s["n"]
        break
    rows = counts.where(F.col("n") >= least).collect() if least is not None else []
    return sorted(((r["word"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _letter(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else 27


class Features:
    """What the forest sees of a candidate."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words = frozenset(w for w, _ in words if len(w) >= 4) | frozenset(NAMES.replace("[_-]?", "").split("|"))
        self.sizes = sorted({len(w) for w in self.words}, reverse=True)
        counts = np.ones((28, 28))  # a to z, a word's ends, other letters
        for w, n in words:
            s = [_letter(c) for c in w]
            for a, b in zip([26, *s], [*s, 26]):
                counts[a, b] += n
        self.log = np.log(counts / counts.sum(1, keepdims=True)).tolist()

    def _covered(self, low: str) -> float:
        """The share of the characters that words of the dictionary cover, longest first from the left."""
        got = 0
        for m in _LETTERS.finditer(low):
            run, at = m[0], 0
            while at < len(run):
                for n in self.sizes:
                    if at + n <= len(run) and run[at : at + n] in self.words:
                        got += n
                        at += n
                        break
                else:
                    at += 1
        return got / max(len(low), 1)

    def of(self, kind: str, text: str, before: str, after: str, path: str) -> list[float]:
        n, low = len(text), text.lower()
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in text]
        turns = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1)
        share = [kinds.count(k) / n for k in "duls"]
        by = {c: text.count(c) for c in set(text)}
        entropy = -sum(v / n * math.log2(v / n) for v in by.values())
        letters = [_letter(c) for c in low if c.isalpha()]
        likely = sum(self.log[a][b] for a, b in zip(letters, letters[1:])) / max(len(letters) - 1, 1)
        near = before[-40:].lower()
        named = bool(re.search(NAMES, near)) or kind == "value"
        return [
            n, entropy, turns, *share, likely, self._covered(low), float(named), float(bool(re.search(r"[=:]\W{0,4}$", before))),
            float(bool(re.search(r"sha|md5|commit|digest|hash|checksum|rev|uuid|version|etag|id", near))), float(bool(re.search(r"example|sample|test|mock|fixture|doc|readme|lock", path.lower()))),
            float(bool(re.search(r"example|placeholder|changeme|your|xxx|dummy|sample", low + " " + near))), float(kind == "known"), float(kind == "pem"),
            float(bool(re.fullmatch(r"[0-9a-f]+", low))), text.count("-") / n, text.count("/") / n, float("{" in text or "$" in text or "(" in text or "<" in text), len(after.split()) / 5,
        ]


def labelled_findings(words: list[tuple[str, int]], n: int = 6000, seed: int = 5) -> list[tuple[str, str, str, str, str, int]]:
    """(kind, text, before, after, path, secret) made from published formats and look-alikes."""
    r = random.Random(seed)
    vocabulary = [w for w, _ in words if len(w) >= 3] or ["the", "value", "name", "house", "which"]
    pick = lambda k: [r.choice(vocabulary) for _ in range(k)]
    chars = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    out = []
    for _ in range(n):
        before, after = " ".join(pick(4)), " ".join(pick(r.randint(0, 5)))
        path = r.choice(["src/app.py", "conf/prod.yml", "deploy.sh", "src3", "mail", ""])
        if r.random() < 0.5:
            secret, which = 1, r.randrange(7)
            name = r.choice(["password", "token", "api_key", "secret", "access_key", "auth_token"])
            if which == 0:
                kind, text = "known", "AKIA" + chars(string.ascii_uppercase + r.choice(["", string.digits]), 16)
            elif which == 1:
                kind, text = "known", "ghp_" + chars(alnum, 36)
            elif which == 2:
                which = r.choice(["RSA ", "EC ", ""])
                kind, text = "pem", f"-----BEGIN {which}PRIVATE KEY-----"
                if r.random() < 0.7:
                    text += "\n" + "".join(chars(alnum + "+/", 64) + "\n" for _ in range(r.randint(2, 26))) + f"-----END {which}PRIVATE KEY-----"
            elif which == 3:
                kind, text, before = "run", chars(alnum + "+/", r.randint(28, 60)), before + r.choice([" key ", f' {name} is "', " Bearer "])
            else:
                kind, text = "value", chars(r.choice([hexa, alnum, alnum + "+/_-", alnum + "!@#%^&*"]), r.randint(10, 64))
                before += f" {name}" + r.choice(["=", " = ", ": ", '="'])
        else:
            secret, which = 0, r.randrange(7)
            if which == 0:
                kind, text, before = "run", chars(hexa, r.choice([32, 40, 64])), before + r.choice([" commit ", " sha256:", " md5 ", " digest "])
            elif which == 1:
                kind, text = "run", "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12))
                before += r.choice([" uuid ", " id ", " "])
            elif which == 2:
                kind, text = "run", r.choice(["_", "-", "/", ""]).join(pick(r.randint(3, 7)))[:200]
            elif which == 3:
                kind, text = "value", r.choice(["${TOKEN}", "<your-token>", "changeme", "xxxxxxxxxx", "os.environ[KEY]", "get_password()", "placeholder", "example-password", "process.env.SECRET"])
                before += r.choice([" password=", " token: "])
            elif which == 4:
                kind, text = "value", r.choice(["", "_", "-"]).join(pick(r.randint(1, 3))) + "xx"
                before += r.choice([" password: ", " the token: ", " secret = "])
            elif which == 5:
                kind, text = "run", r.choice(["-", "_", "/"]) * r.randint(20, 60)
            else:
                kind, text = "run", "".join(w.title() for w in pick(r.randint(4, 6)))[:200]
                path = r.choice(["test/fixtures.py", "docs/readme.md", "package-lock.json", path])
            if len(text) < 6:
                text += "value"
        out.append((kind, text, before, after, path, secret))
    return out


class Forest:
    """Trees in flat arrays, all of one depth limit; a leaf's children are itself."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, seed: int = 3):
        self.trees, self.depth, self.rng = trees, depth, np.random.default_rng(seed)
        self.rows: list[list[float]] = []  # feature, cut, left, right, value

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.roots = np.array([self._grow(x, y, self.rng.integers(0, len(y), len(y)), 0) for _ in range(self.trees)])
        table = np.array(self.rows)
        self.feature, self.cut, self.left, self.right, self.value = table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, level: int) -> int:
        k, p = len(self.rows), float(y[rows].mean())
        self.rows.append([0, 0.0, k, k, p])
        if level == self.depth or len(rows) < 8 or p in (0.0, 1.0):
            return k
        best = (p * (1 - p) * len(rows) - 1e-9, None)
        for f in self.rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, self.rng.random(6))):
                low = v <= cut
                a = int(low.sum())
                if a < 3 or len(rows) - a < 3:
                    continue
                pl, pr = y[rows[low]].mean(), y[rows[~low]].mean()
                cost = pl * (1 - pl) * a + pr * (1 - pr) * (len(rows) - a)
                if cost < best[0]:
                    best = (cost, (int(f), float(cut), rows[low], rows[~low]))
        if best[1] is not None:
            f, cut, low, high = best[1]
            self.rows[k] = [f, cut, self._grow(x, y, low, level + 1), self._grow(x, y, high, level + 1), p]
        return k

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), self.trees)).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.value[at].mean(1)


def train(words: list[tuple[str, int]], findings: DataFrame | None = None) -> tuple[Features, Forest]:
    seen = Features(words)
    if findings is None:
        rows = labelled_findings(words)
    else:
        got = findings.orderBy(F.xxhash64("text", "before", "after", "path")).limit(FIT_ROWS).collect()
        rows = [("value" if re.search(NAMES, (r["before"] or "")[-40:].lower()) else "run", r["text"] or " ", r["before"] or "", r["after"] or "", r["path"] or "", int(bool(r["secret"]))) for r in got]
    x = np.array([seen.of(*r[:5]) for r in rows], float)
    return seen, Forest().fit(x, np.array([r[5] for r in rows], float))


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end), leftmost and non-overlapping, in code points."""
    m, jwt = CANDIDATE.search(text), _JWT.search(text)
    while m or jwt:
        if jwt and (not m or jwt.start("jwt") <= m.start()):
            kind, (a, b) = "known", jwt.span("jwt")
        else:
            kind = next(k for k in KINDS if m[k] is not None)
            a, b = m.span(kind)
        yield kind, a, b
        if m and m.start() < b:
            m = CANDIDATE.search(text, b)
        while jwt and jwt.start("jwt") < b:
            jwt = _JWT.search(text, jwt.end())


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """A row for every candidate of every document, with the forest's verdict."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(train(corpus_words(docs), findings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, forest = shared.value
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            likely = np.flatnonzero(pc.match_substring_regex(texts, MAY).to_numpy(zero_copy_only=False))
            found, x = [], []
            for i in likely.tolist():
                text, path = texts[i].as_py(), batch.column(1)[i].as_py() or ""
                for kind, a, b in candidates(text):
                    found.append((i, kind, a, b, hashlib.sha256(text[a:b].encode()).hexdigest()))
                    x.append(seen.of(kind, text[a:b], text[max(0, a - 80) : a], text[b : b + 60], path))
            score = forest.score(np.array(x, float)) if x else np.zeros(0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()).take(pa.array([f[0] for f in found], pa.int64())), "kind": pa.array([f[1] for f in found], pa.string()),
                "start": pa.array([f[2] for f in found], pa.int64()), "end": pa.array([f[3] for f in found], pa.int64()),
                "secret_sha256": pa.array([f[4] for f in found], pa.string()), "score": pa.array(score, pa.float64()), "is_secret": pa.array(score >= threshold, pa.bool_()),
            })

    return docs.select("doc_id", "source", "text").mapInArrow(run, OUT)
