import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.functions import text as X
from postloom.functions import tokens as T
from postloom.operators import answers as A
from postloom.operators import headers as H
from postloom.operators import prompts as P
from postloom.plans import pipelines
from postloom.schemas import MESSAGE
from postloom.sources import mail
from postloom.sources.client import FakeClient, HttpClient, cached_call, call, run_one, strict
from postloom.sources.models import list_models
from postloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def message(**own):
    return {"message_id": "m", "headers": [], "attachments": [], "text": "", "html": None} | own


def frame(spark, *messages):
    return spark.createDataFrame([[m[k] for k in ("message_id", "headers", "attachments", "text", "html")] for m in messages], MESSAGE)


@pytest.mark.parametrize("base,path,want", [(None, None, "https://api.openai.com/"), ("https://a.example/v1", "/v1/models", "https://a.example/v1/models"), ("https://a.example/v1/", "/v1", "https://a.example/v1/"), ("http://h:1/p", "/v1/x", "http://h:1/p/v1/x"), ("http://h/v1", "/v12", "http://h/v1/v12")])
def test_urls(base, path, want):
    assert P.resolve_url(base, path) == want


@pytest.mark.parametrize("value,want", [(0, None), ("0", 0.0), (0.5, 0.5), ("0.5", 0.5), (None, None), ("", None), ("x", None), (1, 1.0)])
def test_numbers(value, want):
    assert P.number(value) == want


def test_allowed_keys():
    assert H.allowed_keys() == list(H.ALLOWED)
    own = H.allowed_keys([" X-A ", "FROM", "", None])
    assert own[:2] == ["x-a", "from"] and len(own) == len(H.ALLOWED) + 1


@pytest.mark.parametrize("s", ["a😀b", "", "é", "😀" * 5])
def test_utf16(spark, s):
    n = len(s.encode("utf-16-le")) // 2
    assert one(spark, X.utf16_length(F.lit(s))) == n
    for k in range(n + 1):
        want = s.encode("utf-16-le")[: 2 * k].decode("utf-16-le", "ignore")
        assert one(spark, X.utf16_prefix(F.lit(s), k)) == want


@pytest.mark.parametrize("s,want", [("  a b﻿\n", "a b"), ("x\n", "x"), ("\n", "")])
def test_trim(spark, s, want):
    assert one(spark, X.js_trim(F.lit(s))) == want


@pytest.mark.parametrize("s,want", [("see https://a.example:8080/x?y#z now", "see https://a.example:8080 now"), ("https://u:p@h.example/x", "https://h.example"), ("git://g.example/r.git", "git://g.example"), ("me@b.example", "mailto://"), ("www.site.com/a", "http://www.site.com"), ("no links", "no links")])
def test_links(spark, s, want):
    assert one(spark, X.reduce_links(F.lit(s))) == want


@pytest.mark.parametrize("v,want", [("Fri, 2 Feb 2024 05:04:05 +0200", "Fri, 02 Feb 2024 03:04:05 GMT"), ("2 Feb 2024 05:04:05 +0000 (UTC)", "Fri, 02 Feb 2024 05:04:05 GMT"), ("2024-02-02T05:04:05Z", "Fri, 02 Feb 2024 05:04:05 GMT"), ("nonsense", None)])
def test_dates(spark, v, want):
    assert one(spark, H.last_date(F.array(F.struct(F.lit("date").alias("key"), F.lit(v).alias("value"))))) == want


def test_addresses(spark):
    df = spark.createDataFrame([("Ann <a@x.example>, b@y.example",), ("List: =?iso-8859-1?q?J=F6rg?= <j@xn--bcher-kva.example>;",), (None,), ("",)], "v string")
    got = [r[0] for r in df.select(H.render_addresses(H.parse_addresses("v"))).collect()]
    assert got == ["Ann <a@x.example> ; <b@y.example>", "Jörg <j@bücher.example>", None, None]


@settings(max_examples=30, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=12))
def test_pruning_twice_changes_nothing(value):
    once = A.prune(value)
    assert A.prune(once) == once


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a":1} x',), ('{"a":1,"a":2}',), ("{},{}",), (None,), ('{"a":NaN}',), ('{"a":{"b":null,"c":""},"d":[null,""],"e":false}',)], "v string")
    got = [tuple(r[0]) for r in df.select(A.strict_json("v")).collect()]
    assert [g[0] for g in got] == [None, '{"a":2}', None, None, None, '{"a":{},"d":[null,""],"e":false}']
    assert [g[1] is None for g in got] == [False, True, False, False, False, True]


@pytest.mark.parametrize("v,want", [("3", 3.0), ("high", -1.0), ("0", -1.0), ("true", 1.0), ("1d", -1.0), ("", -1.0), ("2.5", 2.5), (" 4 ", 4.0)])
def test_risk(spark, v, want):
    assert one(spark, A.coerce_risk(F.lit(v))) == want


@pytest.mark.parametrize("v,answer,ids", [("Answer: yes\nMessage-ID: <a>, <b>, <a>", "yes", ["<a>", "<b>"]), ("no label", "", None), ("*Answer:* x\r\nanswer: y", "x\ny", None), ("Message-ID: <a>\nAnswer:", "", ["<a>"])])
def test_sections(spark, v, answer, ids):
    s = A.sections(F.lit(v))
    row = spark.range(1).select(s.answer.alias("a"), A.message_ids(s.ids).alias("i")).first()
    assert (row.a, row.i) == (answer, ids)


def test_chunks_lose_nothing_and_keep_their_size(spark):
    text = " ".join(f"word{k}, and" for k in range(900))
    got = spark.range(1).select(T.chunks(F.lit("subject: s\n\n"), F.lit(text), F.lit(text)).alias("c"), T.count(F.lit("subject: s\n\n")).alias("n")).first()
    bodies = [c.removeprefix("subject: s\n\n") for c in got.c]
    assert "".join(bodies) == text
    sizes = [one(spark, T.count(F.lit(b))) for b in bodies]
    assert all(s <= 400 - got.n for s in sizes) and set(sizes[:-1]) == {400 - got.n}


def test_too_long_prompts_are_errors(spark):
    df = frame(spark, message(text="a b c " * 50, headers=[("from", "x " * 100)]))
    out = pipelines.summarize(df, FakeClient, P.Options(max_tokens=60)).first()
    assert out.error.code == "PROMPT_TOO_LONG" and out.summary is None
    short = pipelines.summarize(frame(spark, message(text="x " * 6000)), FakeClient, P.Options(model=P.INSTRUCT_MODEL)).first()
    assert short.error is not None
    fine = pipelines.prepare_summary(frame(spark, message(text="x " * 6000)), P.Options(max_tokens=1000)).first()
    assert fine.n_tokens <= 1000 and fine.chars_removed > 0 and fine.refused is None


def test_results_have_the_reply(spark):
    reply = json.dumps({"id": "r1", "choices": [{"index": 1, "message": {"role": "assistant", "content": ' "sentiment": "neutral", "replyText": null, "x": ""} done'}}, {"index": 0, "message": {"role": "assistant", "content": 'Sure: {"summary": "s",'}}], "usage": {"total_tokens": 9}})
    out = pipelines.summarize(frame(spark, message(text="hi")), lambda: FakeClient({"hi": (200, reply)})).first()
    assert (out.req_id, out.tokens, out.model, out.summary, out.sentiment, out.raw_json) == ("r1", 9, P.CHAT_MODEL, "s", "neutral", '{"summary":"s","sentiment":"neutral"}')
    risky = lambda content: json.dumps({"id": "r", "choices": [{"index": 0, "message": {"role": "assistant", "content": content}}], "usage": {"total_tokens": 1}})
    ask = lambda content: pipelines.assess_risk(frame(spark, message()), lambda: FakeClient({"model": (200, risky(content))})).first()
    assert ask('"{\\"risk\\": 1}"').error is not None
    assert ask('{"risk": "3", "assessment": "a"}').risk == 3.0 and ask('{"risk": "high"}').risk == -1.0
    bad = ask("no json")
    assert bad.error.code == "OutputParseFailed" and bad.error.textContent == "no json" and bad.risk is None


def test_questions(spark):
    df = spark.createDataFrame([("1", "when?", None, None, None), ("2", "  ", None, None, None), ("3", None, None, None, None)], "message_id string, question string, user_name string, user_email string, context string")
    got = {r.message_id: r for r in pipelines.plan_question(df, FakeClient).collect()}
    assert got["1"].error is None and got["1"].model == P.INSTRUCT_MODEL and got["2"].error.code == got["3"].error.code == "EmptyInput"
    body = json.loads(pipelines.prepare_question(df).where("message_id = '1'").first().body)
    assert body["temperature"] == 0.2 and body["max_tokens"] < 4000 and body["prompt"].startswith(P.QUESTION_SYSTEM)
    assert pipelines.answer(df, FakeClient).where("error is not null").count() == 0


def test_nested_embeddings(spark):
    text = "some words here " * 300
    chunks = pipelines.embed(frame(spark, message(text=text, headers=[("to", "b@x.example"), ("from", "A <a@x.example>"), ("subject", "=?utf-8?q?Hi?=")])), lambda: FakeClient(size=3))
    out = pipelines.nest(chunks).first()
    assert len(out.embeddings) > 1 and len(out.embeddings[0].embedding) == 3 and out.embeddings[0].chunk.startswith("to: <b@x.example>\nfrom: A <a@x.example>\nsubject: Hi\n\n")
    failed = pipelines.nest(pipelines.embed(frame(spark, message(text=text)), lambda: FakeClient({"model": (401, '{"error":"no"}')}))).first()
    assert failed.embeddings is None and failed.error.message == "no" and failed.error.statusCode == 401


class Scripted:
    def __init__(self, *replies):
        self.replies, self.calls = list(replies), 0

    def send(self, path, body):
        self.calls += 1
        return self.replies[min(self.calls, len(self.replies)) - 1]


@pytest.mark.parametrize("replies,attempts,text", [([(429, "{}"), (200, '{"a":1}')], 2, None), ([(429, '{"error":{"message":"slow"}}')], 5, "slow"), ([(429, "busy")], 1, "Expecting"), ([(500, '{"error":"text"}')], 1, "text"), ([(200, "{}")], 1, None), ([(200, "null")], 1, "Failed to POST"), ([(503, "[]")], 1, "Failed to run")])
def test_retries(replies, attempts, text):
    client = Scripted(*replies)
    out = run_one(client, "/x", "{}", 0.0)
    assert out["attempts"] == client.calls == attempts
    if replies == [(200, "{}")]:
        return  # an empty object: as a falsy body
    assert (out["error"] is None) == (text is None) and (text is None or out["error"]["message"].startswith(text))


def test_strict_raises(spark):
    df = spark.createDataFrame([(1, "/x", "{}")], "k int, path string, body string")
    with pytest.raises(Exception, match="nope"):
        strict(call(df, lambda: FakeClient({"{}": (400, '{"error":{"message":"nope"}}')}), ["k"])).collect()


def test_cached_calls_are_sent_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "/x", "{}"), (2, "/x", "{}"), (3, "/y", "{}")], "k int, path string, body string")
    cache = str(tmp_path / "cache")
    first = cached_call(df, FakeClient, ["k"], cache).collect()
    again = cached_call(df, lambda: FakeClient({"{}": (500, "{}")}), ["k"], cache).collect()
    assert len(first) == 3 and sorted(map(str, first)) == sorted(map(str, again)) and spark.read.parquet(cache).count() == 2


def test_http_on_the_loopback(monkeypatch):
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.update(dict(self.headers), path=self.path, body=self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.send_response(401 if "bad" in seen["body"] else 200)
            self.end_headers()
            self.wfile.write(b'{"error":{"message":"denied"}}' if "bad" in seen["body"] else b'{"ok":1}')

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("API_TOKEN", "t0k")
    client = HttpClient(f"http://127.0.0.1:{server.server_port}/v1", allowed_hosts=("127.0.0.1",))
    assert run_one(client, P.CHAT, '{"a":1}')["response"] == '{"ok":1}'
    assert seen["path"] == "/v1/chat/completions" and seen["Authorization"] == "Bearer t0k"
    assert run_one(client, P.CHAT, '"bad"')["error"]["statusCode"] == 401
    assert "not allowed" in run_one(HttpClient("http://x.example", allowed_hosts=()), "/v1", "{}")["error"]["message"]
    server.shutdown()


def test_models(spark):
    listed = Scripted((200, json.dumps({"data": [{"id": "gpt-4-0613"}, {"id": "gpt-4", "owned_by": "openai"}, {"id": "ada", "owned_by": "openai-dev"}]})))
    assert [(r.id, r.name) for r in list_models(spark, listed).collect()] == [("gpt-4", "GPT-4"), ("gpt-4-0613", "GPT-4 0613")]
    assert list_models(spark, Scripted((200, '{"data":[]}'))).count() == 0
    with pytest.raises(RuntimeError):
        list_models(spark, Scripted((500, '{"error":{"message":"x"}}')))


def test_eml_files(spark, tmp_path):
    raw = b"From: A <a@x.example>\r\nSubject: one\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>hello</p>"
    for k in range(5):
        (tmp_path / f"m{k}.{'EML' if k % 2 else 'eml'}").write_bytes(raw)
    (tmp_path / "other.txt").write_bytes(b"no")
    got = mail.read_eml(spark, str(tmp_path))
    assert got.count() == 5 and got.first().html == "<p>hello</p>" and got.first().headers[1].value == "one"
    assert mail.read_eml(spark, str(tmp_path), seed=1, most="-2").count() == 2 and mail.read_eml(spark, str(tmp_path), most="x").count() == 5
    out = str(tmp_path / "out")
    mail.write_json(pipelines.summarize(got, FakeClient), out)
    assert spark.read.json(out).count() == 5


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(message(text="hello there")) + "\n")
    stream = ingest.read_messages(spark, str(tmp_path / "in"))
    ingest.run(stream, lambda df: pipelines.summarize(df, FakeClient), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


VOCABULARY = "public_tokenizers"


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip(VOCABULARY).path("byte_bpe_50k.json")


def test_chunks_with_a_vocabulary(spark, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    size = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    text, front = " ".join(f"wörd{k}, and 日本 x" for k in range(700)), "subject: s\n\n"
    rows = frame(spark, message(text=text, headers=[("subject", "s")]), message(message_id="e", headers=[("subject", "s")]), message(message_id="q", text="> all quoted", headers=[("subject", "s")]))
    got = pipelines.chunk(rows, 400, vocabulary).collect()
    bodies = [r.chunk.removeprefix(front) for r in sorted(got, key=lambda r: r.chunk_no) if r.message_id == "m"]
    ids, n = t.encode(text, add_special_tokens=False).ids, 400 - size(front)
    assert bodies == [t.decode(ids[k : k + n], skip_special_tokens=False) for k in range(0, len(ids), n)] and len(bodies) > 5
    assert [r.chunk for r in got if r.message_id == "e"] == [front] and not [r for r in got if r.message_id == "q"]


@pytest.mark.parametrize("old", [False, True])
def test_budgets_with_a_vocabulary(spark, vocabulary, old):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    size = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    texts = ["short", 'say "what"\n' * 400, "wörd 😀 " * 900, ""]
    o = P.Options(max_tokens=700, tokenizer=vocabulary, old_count=old)
    rows = frame(spark, *(message(message_id=str(k), text=x) for k, x in enumerate(texts)))
    got = {r.message_id: r for r in pipelines.prepare_risk(rows, o).collect()}
    for k, text in enumerate(texts):
        r = got[str(k)]
        assert r.refused is None and r.n_tokens == size(r.prompt) <= 700 and text.startswith(r.text_used)
        units, removed = len(text.encode("utf-16-le")) // 2, 0
        while True:
            cut = text.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "ignore")
            if size(P.RISK_USER + "\n\n" + json.dumps({"headers": [], "attachments": [], "text": cut}, ensure_ascii=False, separators=(",", ":"))) <= 700:
                break
            d = 1024 if units > 2048 else 256 if units > 512 else 100 if units > 200 else 10 if units > 20 else 1
            units, removed = units - d, removed + (255 if old and d == 256 else d)
        assert (r.text_used, r.chars_removed) == (cut, removed)
    refused = pipelines.summarize(rows, FakeClient, P.Options(max_tokens=5, tokenizer=vocabulary)).collect()
    assert {(r.error.code, r.error.maxAllowedTokens) for r in refused} == {("PROMPT_TOO_LONG", 5)}


def test_a_connection_is_kept(monkeypatch):
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            ports.append(self.client_address[1])
            self.send_response(200)
            self.send_header("Content-Length", "8")
            self.end_headers()
            self.wfile.write(b'{"ok":1}')
            if len(ports) == 3:
                self.close_connection = True

        def log_message(self, *a):
            pass

    ports = []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpClient(f"http://127.0.0.1:{server.server_port}/v1")
    assert [run_one(client, P.CHAT, "{}")["error"] for _ in range(5)] == [None] * 5
    assert len(set(ports[:3])) == 1 and len(set(ports[3:])) == 1 and ports[0] != ports[3]
    client._kept.__dict__.clear()
    server.shutdown()


def test_diagnostics(caplog):
    from postloom.sources import client as module

    with caplog.at_level("INFO", "postloom.calls"):
        out = module.told(FakeClient({"{}": (500, '{"error":"no"}')}), "/x", "{}", 0.0)
    logged = [json.loads(r.getMessage()) for r in caplog.records]
    assert [x["requestId"] for x in logged] == [out["request_id"]] * 2 and logged[0]["payload"] == "{}" and logged[1]["error"]["message"] == "no"


def test_long_runs_stay_linear(spark):
    import time

    hard = ["\n" * 60_000 + "x", "a@" + "b." * 60_000 + "c", "a." * 60_000, "x" * 120_000 + "@", " " * 60_000 + "\n" + " " * 60_000]
    began = time.time()
    for s in hard:
        one(spark, F.length(X.strip_quotes(F.lit(s))) + F.length(X.reduce_links(F.lit(s))))
    assert time.time() - began < 40
    assert one(spark, X.strip_quotes(F.lit("a \n \n > q\n  > r\nb\n\n"))) == "a \n\nb\n"


def test_the_word_true_is_no_number(spark):
    kind = lambda j: A.json_kind(F.lit(j), "$.risk")
    assert one(spark, A.coerce_risk(F.lit("true"), kind('{"risk":"true"}'))) == -1.0 and one(spark, A.coerce_risk(F.lit("true"), kind('{"risk":true}'))) == 1.0
