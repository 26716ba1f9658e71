"""Queries and SQL of this subpackage."""

from __future__ import annotations

from strandix.llm import chat, decontaminate, mixing, quality, secrets, simhash, substrings, token_counts, token_files, winnow

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_quality": quality.query,
    "op3_substrings": substrings.query,
    "op4_simhash": simhash.query,
    "op5_winnowing": winnow.query,
    "op6_mixing": mixing.query,
    "op7_token_files": token_files.query,
    "op8_decontamination": decontaminate.query,
    "op9_chat_repair": chat.query,
    "op10_secrets": secrets.query,
}
SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op8_decontamination": decontaminate.SQL}
