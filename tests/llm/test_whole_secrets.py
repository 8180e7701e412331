import hashlib
import random
import string
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from postloom.llm import secrets

ALNUM = string.ascii_letters + string.digits
R = random.Random(12)


def chars(n):
    return "".join(R.choice(ALNUM) for _ in range(n))


def pem(end="\n"):
    return "-----BEGIN RSA PRIVATE KEY-----" + end + "".join(chars(64) + end for _ in range(25)) + "-----END RSA PRIVATE KEY-----"


LONG = [("run", chars(201)), ("run", chars(3000) + "=="), ("value", chars(500) + "!"), ("known", f"eyJ{chars(700)}.{chars(900)}.{chars(600)}"), ("known", "xoxb-" + chars(150)), ("pem", pem()), ("pem", pem("\\n"))]


@pytest.mark.parametrize("kind, secret", LONG)
def test_a_long_secret_is_one_whole_candidate(kind, secret):
    name = "token: " if kind == "value" else ""
    text = f"see {name}{secret} and so on"
    assert [(k, text[a:b]) for k, a, b in secrets.candidates(text)] == [(kind, secret)]


def test_keys_of_a_kind_have_hashes_of_their_own(spark):
    blocks = [pem(), pem()]
    docs = spark.createDataFrame([(k, "", f'{pre}{b}" end') for k, b in enumerate(blocks) for pre in ("private_key=", 'private_key = "', "token: ", "")], "doc_id long, source string, text string")
    rows = secrets.scan(docs).collect()
    assert len(rows) == 8 and all(r.kind == "pem" and r.is_secret and r.secret_sha256 == hashlib.sha256(blocks[r.doc_id].encode()).hexdigest() for r in rows)


def test_a_block_without_end_spans_the_key_that_is_there():
    text = "-----BEGIN PRIVATE KEY-----\n" + chars(64) + "\n" + chars(64)
    assert [text[a:b] for _, a, b in secrets.candidates(text + "\n\nhello you\n" + pem())][0] == text


def test_no_text_with_a_candidate_is_skipped():
    texts = ["xoxb-abcdefghij", "eyJabcdefghij.abcdefghij.abcdefghij", "ap\u0130_key=abcdef", "ap\u0131-key=abcdef", "pas\u017fword=abcdef", "to\u212aen=abcdef", "AKIA" + "A" * 16, "ghp_" + chars(36), "AIza" + chars(35), "sk_live_" + chars(24), chars(20), pem()]
    assert all(list(secrets.candidates(t)) for t in texts)
    assert all(pc.match_substring_regex(pa.array(texts), secrets.MAY).to_pylist())


def test_jwts_among_other_candidates():
    jwt = f"eyJ{chars(40)}.{chars(40)}.{chars(40)}"
    text = f"{chars(30)} x{jwt} token={jwt} AKIA{'A' * 16} {jwt} eyJeyJ.eyJ"
    got = [(k, text[a:b]) for k, a, b in secrets.candidates(text)]
    # a run begins before the first, and its parts are runs
    assert [k for k, _ in got] == ["run", "run", "run", "run", "value", "known", "known"]
    assert got[-1][1] == jwt and got[-3][1] == jwt


def test_long_texts_stay_linear():
    begun = time.time()
    for t in ("a" * 10**6, "-----BEGIN PRIVATE KEY-----\n" * 20_000, "token=" + "a-" * 300_000, "=" + "eyJ" * 300_000, "eyJ" + "a." * 300_000):
        list(secrets.candidates(t))
    assert time.time() - begun < 20


def test_formats_that_are_not_among_the_labelled_findings(spark):
    """Held apart: neither the shapes of these secrets nor of these look-alikes are made by ``labelled_findings``."""
    r = random.Random(5)
    dash = lambda *n: "-".join("".join(r.choice(ALNUM) for _ in range(k)) for k in n)
    b64 = lambda n: "".join(r.choice(ALNUM + "+/") for _ in range(n))
    words = [("house", 50), ("garden", 40), ("window", 30), ("river", 20), ("straße", 20), ("mountain", 10), ("letter", 9)] * 20
    rows = []
    for _ in range(40):
        rows += [("client_secret = " + b64(44) + "=", 1), ("x AIza" + "".join(r.choice(ALNUM + "_-") for _ in range(35)) + " y", 1), ("xoxb-" + dash(12, 12, 24), 1), ("passwd: " + b64(20), 1)]
        rows += [("see /usr/share/doc/house/garden/window/river/index.html now", 0), ("the mountain_letter_house_garden_window_river is", 0), ("password: straße", 0), ("token=<mountain>", 0), ("------------------------------------", 0)]
    seen, forest = secrets.train(words)
    hit = {0: [], 1: []}
    for text, secret in rows:
        got = [(k, a, b) for k, a, b in secrets.candidates(text)]
        x = [seen.of(k, text[a:b], text[max(0, a - 80) : a], text[b : b + 60], "") for k, a, b in got]
        hit[secret].append(bool(x) and bool((forest.score(np.array(x, float)) >= 0.5).any()))
    assert np.mean(hit[1]) >= 0.9 and np.mean(hit[0]) <= 0.1


def test_the_dictionary_by_brute_force(spark):
    from collections import Counter

    texts = ["Straße straße house House, HOUSE a bb ccc ccc ddd", "ccc eee eee fff x1y", None, "ggg\nggg hhh " + "l" * 40]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    every = Counter(w for t in texts for w in (x.strip(".,;:!?()\"'") for x in (t or "").lower().split()) if len(w) >= 3 and w.isalpha())
    for size in (1, 2, 4, 5, 50):
        levels = sorted(set(every.values()), reverse=True)
        least = next((n for n in reversed(levels) if sum(c >= n for c in every.values()) <= size), None)
        want = {w: c for w, c in every.items() if least is not None and c >= least}
        assert dict(secrets.corpus_words(docs, size)) == want
