import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from strandix import cli, settings
from strandix.config import ModelConfig, RankingOptions
from strandix.plans.qa import Retriever
from strandix.providers import hashed_embedder
from strandix.serve import Service, server


def test_settings():
    m = settings.chat_model({"LLM_PROVIDER": "deepseek", "DEEPSEEK_API_KEY": "k"})
    assert (m.provider, m.api_key) == ("deepseek", "k") and settings.embedding_model({}).provider == "lmstudio"
    assert settings.embedding_model({"EMBEDDING_PROVIDER": "ollama", "OLLAMA_API_KEY": "x", "OLLAMA_EMBEDDING_MODEL": "m"}) == ModelConfig("ollama", "m", "http://127.0.0.1:11434")
    assert settings.ranking({"TOP_K": "7"}) == RankingOptions(7) and settings.runtime({"REQUEST_RETRIES": "0"}).retries == 0
    for bad in (lambda: settings.embedding_model({"EMBEDDING_PROVIDER": "deepseek"}), lambda: settings.ranking({"TOP_K": "0"}), lambda: settings.runtime({"LLM_TEMPERATURE": "3"})):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def env(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("cli")
    (at / "docs").mkdir()
    (at / "docs/a.md").write_text("# Cache\n\ncache entries expire")
    (at / "docs/b.txt").write_text("queues hold tasks")
    env = {"DOCUMENTS_DIR": str(at / "docs"), "VECTOR_STORE": f"file://{at}/store", "STREAM": "false"}
    for last in ("done: 2 documents, 2 chunks, 0 cached, 2 embedded", "unchanged: 2 documents"):
        out = io.StringIO()
        assert cli.run_ingest(spark, env, out, hashed_embedder(16)) == 0 and last in out.getvalue()
    return env


def test_command_line(spark, env):
    out = io.StringIO()
    assert cli.run_query(spark, "cache entries", env, out, hashed_embedder(16), lambda m: f"{len(m)} messages") == 0
    lines = out.getvalue().splitlines()
    assert lines[0].startswith(" 1  ") and "a.md#0" in lines[0] and lines[-1] == "2 messages"
    out = io.StringIO()
    assert cli.run_query(spark, "zzz", env | {"MIN_SCORE": "1"}, out, hashed_embedder(16), None) == 0 and out.getvalue() == "我不知道\n"
    for args, code in ((["nonsense"], 1), ([], 0), (["help"], 0)):
        assert cli.main(args, {}, io.StringIO()) == code
    assert cli.read_question([], io.StringIO(" two\nlines \n")) == "two\nlines" and cli.read_question(["a", "b"], io.StringIO()) == "a b"


def test_server(spark, env):
    service = Service(spark, lambda: Retriever.open(spark, env["VECTOR_STORE"]), hashed_embedder(16), lambda m: "yes", RankingOptions(), "t", 1, {"llm": "x/y"})
    s = server(service, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(method, path, body=None, token="t"):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", data, {"Authorization": f"Bearer {token}"}, method=method)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("GET", "/health", token="") == (200, {"ok": True, "records": 2, "llm": "x/y"})
        status, got = call("POST", "/query", {"question": "cache entries", "topK": 1, "perSourceLimit": "no", "includeContext": True})
        assert status == 200 and got["answer"] == "yes" and [h["id"] for h in got["hits"]] == ["a.md#0"] and "expire" in got["context"] and "candidates" not in got and got["meta"]["dim"] == 16
        got = call("POST", "/query", {"question": "q", "minScore": 1, "includeCandidates": True, "prompt": {"unknownAnswer": "?"}})[1]
        assert (got["answer"], got["noAnswerReason"], got["hits"], got["candidates"]) == ("?", "no-hits", [], [])
        assert call("POST", "/reload", {})[1]["records"] == 2
        for want, args in ((401, ("POST", "/query", {}, "bad")), (400, ("POST", "/query", {"question": " "})), (400, ("POST", "/query", b"{")), (413, ("POST", "/query", b"x" * (1 << 20) + b"yy")), (500, ("POST", "/query", {"question": "q", "topK": 0})), (404, ("GET", "/nowhere"))):
            assert call(*args)[0] == want
        service.slots.acquire()
        assert call("POST", "/query", {"question": "q"})[0] == 503
    finally:
        s.shutdown()
