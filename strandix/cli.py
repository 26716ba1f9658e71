"""Command line: ``python -m strandix.cli ingest`` and ``python -m strandix.cli query "a question"``."""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Mapping, Sequence
from typing import TextIO

from pyspark.sql import SparkSession

from strandix import providers, settings
from strandix.config import env_bool, env_list, env_text
from strandix.operators.ingest import ingest
from strandix.operators.prompts import build_context, build_messages, hit_table
from strandix.operators.search import select_diverse
from strandix.plans.qa import Retriever, embed_questions
from strandix.sources.documents import load_documents

USAGE = 'usage: python -m strandix.cli ingest | query "a question"'


def duration(seconds: float) -> str:
    """Milliseconds below a second, else seconds with two decimals."""
    return f"{seconds * 1000:.0f} ms" if seconds < 1 else f"{seconds:.2f} s"


def colored(text: str, code: str, out: TextIO, env: Mapping[str, str] = os.environ) -> str:
    """In a terminal's colours, unless it isn't one or NO_COLOR is set."""
    return f"\x1b[{code}m{text}\x1b[0m" if getattr(out, "isatty", lambda: False)() and not env.get("NO_COLOR") else text


def read_question(args: Sequence[str], given: TextIO) -> str:
    """The arguments, else all lines of standard input, else what is typed."""
    if text := " ".join(args).strip():
        return text
    return (input("question: ") if given.isatty() else given.read()).strip()


def run_ingest(spark: SparkSession, env: Mapping[str, str], out: TextIO, embedder=None) -> int:
    model = settings.embedding_model(env)
    folder = os.path.abspath(env_text("DOCUMENTS_DIR", "./documents", env))
    docs = load_documents(spark, folder, env_list("DOCUMENT_EXTENSIONS", (), env) or None, exclude=env_list("EXCLUDE_SOURCES", (), env))
    began = time.monotonic()
    tell = lambda stage, facts: print(stage, *(f"{k}={v}" for k, v in facts.items()), file=out)
    r = ingest(docs, settings.store_path(env), model, embedder or providers.create_embedder(model, settings.runtime(env)), settings.ingest_options(env), progress=tell)
    print(f"{r.skipped or 'done'}: {r.documents} documents, {r.chunks} chunks, {r.cached} cached, {r.embedded} embedded, {duration(time.monotonic() - began)}", file=out)
    return 0


def run_query(spark: SparkSession, question: str, env: Mapping[str, str], out: TextIO, embedder=None, chat=None) -> int:
    model, llm, runtime, options = settings.embedding_model(env), settings.chat_model(env), settings.runtime(env), settings.ranking(env)
    retriever = Retriever.open(spark, settings.store_path(env), model)
    asked = embed_questions(spark.createDataFrame([(0, question)], "question_id long, question string"), embedder or providers.create_embedder(model, runtime)).persist()
    hits = select_diverse(retriever.search(asked, options), options.per_source_limit, options.top_k).persist()
    try:
        lines = hit_table(hits).orderBy("rank").collect()
        for row in lines:
            print(colored(row.line, "2", out, env), file=out)
        if not lines:
            from strandix.config import UNKNOWN_ANSWER

            print(UNKNOWN_ANSWER, file=out)
            return 0
        rows = build_context(hits).join(asked, "question_id")
        messages = [m.asDict() for m in rows.select(build_messages(rows["context"], rows["question"])).first()[0]]
    finally:
        hits.unpersist()
        asked.unpersist()
        retriever.free()
    # Tokens of a single answer are told on the driver as they come.
    stream = env_bool("STREAM", True, env)
    tell = (lambda t: print(t, end="", flush=True, file=out)) if stream else None
    answer = (chat or providers.create_chat(llm, runtime, on_token=tell))(messages)
    print("" if stream and chat is None else answer, file=out)
    return 0


def main(args: Sequence[str], env: Mapping[str, str] = os.environ, out: TextIO = sys.stdout, spark: SparkSession | None = None) -> int:
    command = args[0] if args else "help"
    if command in ("help", "-h", "--help"):
        print(USAGE, file=out)
        return 0
    if command not in ("ingest", "query"):
        print(f"unknown command {command!r}\n{USAGE}", file=out)
        return 1
    question = read_question(args[1:], sys.stdin) if command == "query" else ""
    if command == "query" and not question:
        print("no question", file=out)
        return 1
    spark = spark or SparkSession.builder.appName("strandix").getOrCreate()
    return run_ingest(spark, env, out) if command == "ingest" else run_query(spark, question, env, out)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
