"""Byte-level BPE with a public vocabulary, given by path (it must be readable on every node and is never copied here)."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    """Text to its ids as little-endian uint16 bytes. Strings of special tokens in a text are ordinary text, so END_OF_DOCUMENT never occurs inside."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= END_OF_DOCUMENT:
        raise ValueError("the vocabulary must leave id 50256 free and fit 16 bits")
    encode = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str | None) -> bytes:
        return array("H", encode(text)).tobytes() if text else b""

    return ids


@lru_cache(maxsize=4)
def decoder(path: str = TOKENIZER):
    with open(path, "rb") as f:
        pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return lambda ids: b"".join(pieces[i] for i in ids).decode("utf-8", "replace")
