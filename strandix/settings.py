"""Configurations from environment variables, for the command line and the server."""

from __future__ import annotations

import os
from collections.abc import Mapping

from strandix.config import IngestOptions, ModelConfig, RankingOptions, RuntimeOptions, check, env_choice, env_int, env_number, env_text

#: Provider: address, key and models where the environment names none. A key of None: the server takes none.
SERVERS = {
    "lmstudio": ("http://127.0.0.1:1234/v1", "lm-studio", "qwen2.5-7b-instruct", "text-embedding-nomic-embed-text-v1.5"),
    "ollama": ("http://127.0.0.1:11434", None, "qwen2.5:7b", "nomic-embed-text"),
    "openai": ("https://api.openai.com/v1", "", "gpt-4o-mini", "text-embedding-3-small"),
    "deepseek": ("https://api.deepseek.com", "", "deepseek-v4-pro", None),
}


def _model(kind: str, env: Mapping[str, str]) -> ModelConfig:
    at = 2 if kind == "LLM" else 3
    provider = env_choice(f"{kind}_PROVIDER", [p for p, s in SERVERS.items() if s[at]], "lmstudio", env)
    server, prefix = SERVERS[provider], provider.upper()
    key = "" if server[1] is None else env_text(f"{prefix}_API_KEY", server[1], env)
    return ModelConfig(provider, env_text(f"{prefix}_{kind}_MODEL", server[at], env), env_text(f"{prefix}_BASE_URL", server[0], env), key)


def chat_model(env: Mapping[str, str] = os.environ) -> ModelConfig:
    return _model("LLM", env)


def embedding_model(env: Mapping[str, str] = os.environ) -> ModelConfig:
    return _model("EMBEDDING", env)


def runtime(env: Mapping[str, str] = os.environ) -> RuntimeOptions:
    out = RuntimeOptions(env_int("REQUEST_TIMEOUT_MS", 60_000, env), env_int("REQUEST_RETRIES", 2, env), env_int("OLLAMA_EMBED_CONCURRENCY", 4, env), env_number("LLM_TEMPERATURE", 0.2, env))
    check(out.temperature <= 2, "LLM_TEMPERATURE must be at most 2")
    return out


def ranking(env: Mapping[str, str] = os.environ) -> RankingOptions:
    return RankingOptions(env_int("TOP_K", 4, env), env_int("PER_SOURCE_LIMIT", 2, env), env_number("MIN_SCORE", 0.0, env), env_number("KEYWORD_WEIGHT", 0.3, env), env_number("KEYWORD_HEADING_WEIGHT", 2.0, env))


def ingest_options(env: Mapping[str, str] = os.environ) -> IngestOptions:
    return IngestOptions(env_int("CHUNK_SIZE", 600, env), env_int("CHUNK_OVERLAP", 80, env), env_number("HEADING_WEIGHT", 2.0, env), env_int("EMBED_BATCH_SIZE", 32, env), env_int("CONCURRENCY", 1, env))


def store_path(env: Mapping[str, str] = os.environ) -> str:
    return env_text("VECTOR_STORE", "./vector-store", env)
