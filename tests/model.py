"""What the operators must compute, in plain Python: chunking, tokens, BM25 and the two-stage ranking."""

import math
import re
from collections import Counter

WHITE = " \t\n\r\x0b\x0c                 　﻿"


def trim(s):
    return s.strip(WHITE)


def tokens(text):
    out = []
    for run in re.findall(r"[一-鿿]+|[a-z0-9]+", text.lower()):
        out += [run[i : i + 2] for i in range(len(run) - 1)] if "一" <= run[0] <= "鿿" and len(run) > 1 else [run]
    return out


def hard(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while True:
        out.append(trim(text[at : at + size]))
        if at + size >= len(text):
            return [x for x in out if x]
        at += size - overlap


def chunks(text, size, overlap):
    """(heading, content) in order."""
    text, stack, body, parts = text.replace("\r\n", "\n"), [], [], []
    for line in text.split("\n"):
        if m := re.fullmatch(rf"(#{{1,6}})[{WHITE}]+([^\n\r  ]*)", line):
            if body:
                parts.append((" > ".join(t for _, t in stack), "\n".join(body)))
            body, level = [], len(m[1])
            stack = [x for x in stack if x[0] < level] + [(level, trim(m[2]))]
        else:
            body.append(line)
    if body:
        parts.append((" > ".join(t for _, t in stack), "\n".join(body)))
    out = []
    for heading, body in parts or [("", text)]:
        buf = ""
        for p in filter(None, map(trim, re.split(r"\n{2,}", body))):
            if len(buf) + len(p) + 2 <= size:
                buf = f"{buf}\n\n{p}" if buf else p
                continue
            if buf:
                out.append((heading, buf))
            buf = p if len(p) <= size else ""
            if len(p) > size:
                out += [(heading, c) for c in hard(p, size, overlap)]
        if buf:
            out.append((heading, buf))
    return out


def rank(rows, question, q, top_k=4, per=2, least=0.0, w=0.3, heading_weight=2.0):
    """rows: (ord, source, heading, content, vector). The candidates and the hits, as (ord, score, vector score, keyword score)."""
    rep, asked = math.floor(heading_weight), Counter(tokens(question))
    stats = [(Counter(tokens(c)), Counter(tokens(h))) for _, _, h, c, _ in rows]
    raw = [0.0] * len(rows)
    if w > 0 and asked:
        df = Counter(t for c, h in stats for t in ({*c, *h} if rep else c))
        length = [c.total() + h.total() * rep for c, h in stats]
        mean = sum(length) / len(rows)
        for i, (c, h) in enumerate(stats):
            for t, n in asked.items():
                tf = c[t] + h[t] * rep
                if tf and mean:
                    raw[i] += n * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[i] / mean))
    best, out = max(raw, default=0), []
    for (o, s, *_, e), r in zip(rows, raw):
        v, k = sum(a * b for a, b in zip(e, q)), r / best if best else 0.0
        out.append((o, round((1 - w) * v + w * k, 9), round(v, 9), round(k, 9), s))
    pool = sorted((x for x in out if least <= 0 or x[1] >= least), key=lambda x: (-x[1], x[0]))[: top_k * per]
    seen, hits = Counter(), []
    for x in pool:
        seen[x[4]] += 1
        if seen[x[4]] <= per:
            hits.append(x[:4])
    return [x[:4] for x in pool], hits[:top_k]
