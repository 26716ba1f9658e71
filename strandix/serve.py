"""A small HTTP front over a retriever: GET /health, POST /query, POST /reload. For single questions; batches belong in a job."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from strandix import providers, settings
from strandix.config import PromptOptions, RankingOptions, env_int, env_text
from strandix.operators.embedding import EmbedFunction
from strandix.operators.prompts import ChatFunction
from strandix.plans import qa

BODY_BYTES = 1 << 20
ROUTES = {"/health": "GET", "/query": "POST", "/reload": "POST"}
_RANKING = {"topK": "top_k", "minScore": "min_score", "perSourceLimit": "per_source_limit", "keywordWeight": "keyword_weight", "keywordHeadingWeight": "keyword_heading_weight"}
_PROMPT = {"unknownAnswer": "unknown_answer", "contextLabel": "context_label", "questionLabel": "question_label", "systemPrompt": "system_prompt"}


class Refused(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


class Service:
    """What the routes do, without sockets. The retriever is swapped once its successor is whole."""

    def __init__(self, spark: SparkSession, open_retriever: Callable[[], qa.Retriever], embed: EmbedFunction, chat: ChatFunction, ranking: RankingOptions, token: str = "", most: int = 4, labels: dict[str, str] | None = None) -> None:
        self.spark, self.open, self.embed, self.chat, self.ranking, self.token, self.labels = spark, open_retriever, embed, chat, ranking, token, labels or {}
        self.slots = threading.BoundedSemaphore(most)
        self.retriever = open_retriever()

    def handle(self, method: str, path: str, authorization: str, read: Callable[[int], bytes], length: int) -> tuple[int, dict]:
        try:
            if (method, path) == ("GET", "/health"):
                return 200, {"ok": True, "records": self.retriever.record_count} | self.labels
            if (method, path) == ("POST", "/query"):
                self._authorize(authorization)
                if not self.slots.acquire(blocking=False):
                    raise Refused(503, "busy, try again later")
                try:
                    return 200, self.query(self._body(read, length))
                finally:
                    self.slots.release()
            if (method, path) == ("POST", "/reload"):
                self._authorize(authorization)
                # The new one is whole before it is swapped in; the old one's caches go then, and what still reads it is recomputed.
                old, self.retriever = self.retriever, self.open()
                old.free()
                return 200, {"ok": True, "records": self.retriever.record_count, "meta": self.retriever.meta.to_json() if self.retriever.meta else None}
            return 404, {"error": "not_found", "endpoints": [f"{m} {p}" for p, m in ROUTES.items()]}
        except Refused as e:
            return e.status, {"error": str(e)}
        except Exception as e:  # noqa: BLE001 - a request must not end the server
            print(f"request failed: {e!r}", flush=True)
            return 500, {"error": "internal_error"}

    def _authorize(self, header: str) -> None:
        if self.token and header != f"Bearer {self.token}":
            raise Refused(401, "unauthorized")

    def _body(self, read: Callable[[int], bytes], length: int) -> dict[str, Any]:
        if length > BODY_BYTES:
            raise Refused(413, "the body exceeds 1 MiB")
        try:
            body = json.loads(raw) if (raw := read(length).decode("utf-8", "replace").strip()) else {}
        except ValueError:
            raise Refused(400, "the body is not JSON") from None
        return body if isinstance(body, dict) else {}

    def query(self, body: dict[str, Any]) -> dict[str, Any]:
        question = body.get("question")
        if not isinstance(question, str) or not question.strip():
            raise Refused(400, "question must be a non-empty string")
        given = {ours: body[k] for k, ours in _RANKING.items() if isinstance(body.get(k), (int, float)) and not isinstance(body.get(k), bool)}
        prompt = PromptOptions(**{ours: body["prompt"][k] for k, ours in _PROMPT.items() if isinstance((body.get("prompt") or {}).get(k), str)})
        began = time.monotonic()
        wanted = body.get("includeCandidates") is True
        answers = qa.answer(self.spark.createDataFrame([(0, question)], "question_id long, question string"), self.retriever, self.embed, self.chat, replace(self.ranking, **given), prompt, include_candidates=wanted)
        try:
            row = answers.rows.first().asDict(recursive=True)
        finally:
            answers.free()
        out = {"question": row["question"], "answer": row["answer"], "hits": row["hits"] or [], "elapsedMs": round((time.monotonic() - began) * 1000)}
        out |= {"candidates": row["candidates"] or []} if wanted else {}
        out |= {"context": row["context"]} if body.get("includeContext") is True else {}
        out |= {"noAnswerReason": row["no_answer_reason"]} if row["no_answer_reason"] else {}
        return out | ({"meta": self.retriever.meta.to_json()} if self.retriever.meta else {})


def server(service: Service, host: str = "127.0.0.1", port: int = 8787) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            status, body = service.handle(self.command, self.path.partition("?")[0], self.headers.get("Authorization", ""), self.rfile.read, length)
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = _run  # noqa: N815

        def log_message(self, *a: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    spark = SparkSession.builder.appName("strandix-serve").getOrCreate()
    model, llm, runtime, path = settings.embedding_model(), settings.chat_model(), settings.runtime(), settings.store_path()
    labels = {"vectorStore": path} | {k: f"{c.provider}/{c.model}" for k, c in (("embedding", model), ("llm", llm))}
    service = Service(spark, lambda: qa.Retriever.open(spark, path, model), providers.create_embedder(model, runtime), providers.create_chat(llm, runtime), settings.ranking(), env_text("SERVE_AUTH_TOKEN"), env_int("SERVE_MAX_CONCURRENCY", 4), labels)
    at = (env_text("SERVE_HOST", "127.0.0.1"), env_int("SERVE_PORT", 8787))
    print(f"listening on {at[0]}:{at[1]}, {asdict(service.ranking)}", flush=True)
    server(service, *at).serve_forever()


if __name__ == "__main__":
    os.environ.setdefault("PYTHONUNBUFFERED", "1")
    main()
