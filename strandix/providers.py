"""Embedding and chat functions: over HTTP for the usual servers, and a deterministic one that needs no network.

A streamed answer is read as it arrives: bytes are decoded and cut to lines piece by piece, and each token is told when its line is whole.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from strandix.config import ModelConfig, RuntimeOptions

#: (url, body, headers, timeout in seconds[, stream]) to a status and the body, or with stream its pieces as they arrive.
Fetch = Callable[..., "tuple[int, bytes | Iterable[bytes]]"]


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors of hashed bags of words: deterministic, for tests and demonstrations."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else [1.0] + [0.0] * (dim - 1))
        return out

    return run


def post(url: str, body: dict, headers: dict[str, str], runtime: RuntimeOptions, send: Fetch | None = None, sleep: Callable[[float], None] = time.sleep, stream: bool = False) -> bytes | Iterable[bytes]:
    """A request with retries: 4xx fails at once; 5xx, redirects and broken connections are tried again after 0.5, 1, 2 ... seconds. Of a stream only its beginning is tried again."""
    send = send or _send
    for i in range(runtime.retries + 1):
        try:
            status, content = send(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers, runtime.timeout_ms / 1000, *([True] if stream else []))
        except OSError as e:
            status, content = 599, str(e).encode()
        if 200 <= status < 300:
            return content
        if 400 <= status < 500 or i == runtime.retries:
            said = content if isinstance(content, bytes) else b"".join(content)
            raise RuntimeError(f"{url} answered {status}: {said[:300].decode('utf-8', 'replace')}")
        sleep(0.5 * 2**i)
    raise AssertionError


def _send(url: str, body: bytes, headers: dict[str, str], timeout: float, stream: bool = False) -> tuple[int, bytes | Iterable[bytes]]:
    try:
        r = urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout)
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    if stream:
        return r.status, _arriving(r)
    with r:
        return r.status, r.read()


def _arriving(response) -> Iterator[bytes]:
    with response:
        # read1 gives what is there, without waiting for a full buffer.
        while piece := response.read1(1 << 16):
            yield piece


def create_embedder(config: ModelConfig, runtime: RuntimeOptions = RuntimeOptions(), send: Fetch | None = None) -> Callable[[list[str]], list[list[float]]]:  # noqa: B008
    base = config.base_url.rstrip("/")
    if config.provider == "ollama":

        def one(text: str) -> list[float]:
            return json.loads(post(f"{base}/api/embeddings", {"model": config.model, "prompt": text}, {}, runtime, send))["embedding"]

        def many(texts: list[str]) -> list[list[float]]:
            with ThreadPoolExecutor(runtime.concurrency) as pool:
                return list(pool.map(one, texts))

        return many

    def batch(texts: list[str]) -> list[list[float]]:
        got = json.loads(post(f"{base}/embeddings", {"model": config.model, "input": texts}, _auth(config), runtime, send))["data"]
        return [x["embedding"] for x in sorted(got, key=lambda x: x.get("index", 0))]

    return batch


def create_chat(config: ModelConfig, runtime: RuntimeOptions = RuntimeOptions(), send: Fetch | None = None, on_token: Callable[[str], None] | None = None) -> Callable[[list[dict]], str]:  # noqa: B008
    """A chat function; with on_token the answer is asked for as a stream and told piece by piece."""
    base, ollama, stream = config.base_url.rstrip("/"), config.provider == "ollama", on_token is not None

    def run(messages: list[dict]) -> str:
        body = {"model": config.model, "messages": messages, "stream": stream} | ({"options": {"temperature": runtime.temperature}} if ollama else {"temperature": runtime.temperature})
        raw = post(f"{base}/api/chat" if ollama else f"{base}/chat/completions", body, {} if ollama else _auth(config), runtime, send, stream=stream)
        if not stream:
            got = json.loads(raw)
            return got["message"]["content"] if ollama else got["choices"][0]["message"]["content"]
        pieces = []
        for piece in (ndjson_tokens if ollama else sse_tokens)(raw):
            pieces.append(piece)
            on_token(piece)
        return "".join(pieces)

    return run


def _auth(config: ModelConfig) -> dict[str, str]:
    return {"Authorization": f"Bearer {config.api_key or 'sk-none'}"}


def _lines(raw: bytes | Iterable[bytes]) -> Iterator[str]:
    """Non-empty lines, each as soon as its end has arrived; characters cut between pieces are put together."""
    decode, held = codecs.getincrementaldecoder("utf-8")("replace").decode, ""
    for piece in [raw] if isinstance(raw, bytes) else raw:
        *whole, held = (held + decode(piece)).split("\n")
        yield from (line for x in whole if (line := x.removesuffix("\r")))
    if line := (held + decode(b"", True)).strip():
        yield line


def sse_tokens(raw: bytes | Iterable[bytes]) -> Iterator[str]:
    for line in _lines(raw):
        if not line.startswith("data:"):
            continue
        if (data := line[5:].strip()) == "[DONE]":
            return
        try:
            if token := json.loads(data)["choices"][0]["delta"].get("content"):
                yield token
        except (ValueError, LookupError, TypeError):
            continue


def ndjson_tokens(raw: bytes | Iterable[bytes]) -> Iterator[str]:
    for line in _lines(raw):
        try:
            if token := json.loads(line)["message"].get("content"):
                yield token
        except (ValueError, LookupError, TypeError):
            continue
