import json
import threading
import time

import pytest

from strandix.config import ModelConfig, RuntimeOptions
from strandix.operators.embedding import checked
from strandix.providers import create_chat, create_embedder, hashed_embedder, ndjson_tokens, post, sse_tokens


class Server:
    def __init__(self, *answers):
        self.answers, self.calls = list(answers), []

    def __call__(self, url, body, headers, timeout, stream=False):
        self.calls.append((url, json.loads(body), headers, timeout))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        status, content = a if isinstance(a, tuple) else (200, a)
        return status, content if isinstance(content, bytes) or stream else json.dumps(content).encode()


def test_vectors_come_back_in_the_inputs_order():
    s = Server({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]})
    assert create_embedder(ModelConfig("openai", "m", "http://h/v1/"), send=s)(["a", "b"]) == [[1], [2]]
    url, body, headers, timeout = s.calls[0]
    assert url == "http://h/v1/embeddings" and body == {"model": "m", "input": ["a", "b"]} and headers["Authorization"] == "Bearer sk-none" and timeout == 60


def test_one_call_for_each_input():
    s = Server({"embedding": [1]}, {"embedding": [1]})
    assert create_embedder(ModelConfig("ollama", "m", "http://h"), RuntimeOptions(concurrency=1), s)(["a", "b"]) == [[1], [1]]
    assert [c[1]["prompt"] for c in s.calls] == ["a", "b"]


@pytest.mark.parametrize("answers, calls, ok", [(((500, b""), OSError("x"), {"ok": 1}), 3, True), (((429, b"slow"),), 1, False), (((503, b""),) * 3, 3, False), (((302, b""), {"ok": 1}), 2, True)])
def test_retries(answers, calls, ok):
    s, slept = Server(*answers), []
    run = lambda: post("u", {}, {}, RuntimeOptions(), s, slept.append)
    if ok:
        assert json.loads(run()) == {"ok": 1}
    else:
        with pytest.raises(RuntimeError):
            run()
    assert len(s.calls) == calls and slept == [0.5, 1.0][: calls - 1]


@pytest.mark.parametrize("vectors", [[[1.0]], [[1.0], []], [[1.0], [1.0, 2.0]], [[1.0], [float("nan")]]])
def test_vectors_are_checked(vectors):
    with pytest.raises(ValueError):
        checked(["a", "b"], vectors)


def test_chat():
    s = Server({"choices": [{"message": {"content": "hi"}}]})
    assert create_chat(ModelConfig("deepseek", "m", "http://h", "k"), send=s)([{"role": "user", "content": "q"}]) == "hi"
    assert s.calls[0][0] == "http://h/chat/completions" and s.calls[0][1]["temperature"] == 0.2 and s.calls[0][2]["Authorization"] == "Bearer k"
    s = Server({"message": {"content": "yo"}})
    assert create_chat(ModelConfig("ollama", "m", "http://h"), send=s)([]) == "yo" and s.calls[0][1]["options"] == {"temperature": 0.2}


def test_streams():
    event = lambda **delta: "data:" + json.dumps(dict(choices=[dict(delta=delta)]))
    sse = "\n".join([event(content="你") + "\r", "\r", ": note", "data: {broken", event(), event(content="好"), "data: [DONE]", event(content="no")]).encode()
    assert list(sse_tokens(sse)) == ["你", "好"]
    lines = "\n".join([json.dumps(dict(message=dict(content="a"))), "", "bad", json.dumps(dict(message={})), json.dumps(dict(message=dict(content="b"), done=True))]).encode()
    assert list(ndjson_tokens(lines)) == ["a", "b"]
    told = []
    assert create_chat(ModelConfig("lmstudio", "m", "http://h"), send=Server((200, sse)), on_token=told.append)([]) == "你好" and told == ["你", "好"]


def test_hashed_embedder():
    a, b = hashed_embedder(8)(["x y", ""])
    assert abs(sum(v * v for v in a) - 1) < 1e-9 and b[0] == 1


def test_tokens_are_told_as_they_arrive():
    """A server that sends its second event only after the first token was told, with a character cut in two."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    first, told = threading.Event(), []
    event = lambda text: ("data: " + json.dumps({"choices": [{"delta": {"content": text}}]}, ensure_ascii=False) + "\n\n").encode()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            one, two = event("你"), event("好")
            at = one.index("你".encode()) + 1
            for piece in (one[:at], one[at:]):
                self.wfile.write(piece)
                self.wfile.flush()
                time.sleep(0.05)
            assert first.wait(20)
            self.wfile.write(two + b"data: [DONE]")

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        chat = create_chat(ModelConfig("lmstudio", "m", f"http://127.0.0.1:{server.server_port}"), on_token=lambda t: (told.append(t), first.set()))
        assert chat([]) == "你好" and told == ["你", "好"]
    finally:
        server.shutdown()


def test_lines_cut_anywhere_are_put_together():
    raw = "".join(json.dumps({"message": {"content": c}}, ensure_ascii=False) + "\r\n" for c in "aé你𝄞b").encode()
    for n in (1, 2, 3, 7, len(raw)):
        assert list(ndjson_tokens([raw[i : i + n] for i in range(0, len(raw), n)])) == list("aé你𝄞b")
