"""Splitting and counting over whole batches of texts: plain Python on strings, each linear in a text's length, called by Arrow-fed functions;
term lists are handled as flat Arrow arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Every Unicode white space, line ends and the byte order mark.
WHITE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Bytes of a part of a batch; a longer row is a part of its own.
PART_BYTES = 1 << 20
_HEADING = re.compile(rf"(#{{1,6}})[{WHITE}]+([^\n\r\u2028\u2029]*)")
_BLANK = re.compile(r"\n{2,}")

PIECES = pa.list_(pa.struct([("heading", pa.string()), ("content", pa.string())]))


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of `size` characters that overlap, trimmed, without empty ones; a text that fits stays as it is."""
    if len(text) <= size:
        return [text]
    step = size - overlap
    last = -(-(len(text) - size) // step) * step
    return [w for i in range(0, last + 1, step) if (w := text[i : i + size].strip(WHITE))]


def packed(body: str, size: int, overlap: int) -> list[str]:
    """Paragraphs joined by blank lines as long as they fit; longer ones are split hard on their own."""
    out: list[str] = []
    held: list[str] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            out.append("\n\n".join(held))
            held.clear()
        n = 0

    for raw in _BLANK.split(body):
        p = raw.strip(WHITE)
        if not p:
            continue
        if n + len(p) + 2 <= size:
            n += len(p) + (2 if held else 0)
            held.append(p)
            continue
        flush()
        if len(p) > size:
            out += windows(p, size, overlap)
        else:
            held.append(p)
            n = len(p)
    flush()
    return out


def sections(text: str) -> list[tuple[str, str]]:
    """(path of the headings above, body) of each run of lines below a heading of any level."""
    stack: list[tuple[int, str]] = []
    lines: list[str] = []
    out: list[tuple[str, str]] = []

    def close() -> None:
        if lines:
            out.append((" > ".join(t for _, t in stack), "\n".join(lines)))
            lines.clear()

    text = text.replace("\r\n", "\n")
    for line in text.split("\n"):
        m = _HEADING.fullmatch(line) if line[:1] == "#" else None
        if not m:
            lines.append(line)
            continue
        close()
        level = len(m[1])
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, m[2].strip(WHITE)))
    close()
    return out or [("", text)]


def pieces(text: str, size: int, overlap: int) -> list[dict]:
    return [{"heading": h, "content": c} for h, body in sections(text) for c in packed(body, size, overlap)]


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements; null lists have none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten()


def codes(terms: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the terms in their order, and the distinct terms."""
    coded = terms.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64), coded.dictionary.take(order)


def lists_of(rows: np.ndarray, n: int, fields: dict[str, pa.Array], missing: pa.Array | None = None) -> pa.Array:
    """A column of n lists of structs from the row of each element, ascending; `missing` marks lists that are null."""
    offsets = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
    if missing is not None and missing.true_count:
        offsets = pc.if_else(pa.concat_arrays([missing, pa.array([False])]), pa.scalar(None, pa.int32()), offsets)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def counted(tokens: pa.Array) -> pa.Array:
    """(term, count) of each list of tokens, by term."""
    owner, elements = flat(tokens)
    code, terms = codes(elements)
    pair, n = np.unique(owner * max(len(terms), 1) + code, return_counts=True)
    rows, code = pair // max(len(terms), 1), pair % max(len(terms), 1)
    return lists_of(rows, len(tokens), {"term": terms.take(pa.array(code)), "count": pa.array(n.astype(np.int32))}, tokens.is_null())


def merged(content: pa.Array, heading: pa.Array) -> pa.Array:
    """(term, c, h) of each term of either list of (term, count), by term."""
    (co, ce), (ho, he) = flat(content), flat(heading)
    code, terms = codes(pa.concat_arrays([ce.field("term"), he.field("term")]))
    v = max(len(terms), 1)
    pair, at = np.unique(np.concatenate([co, ho]) * v + code, return_inverse=True)
    c = np.bincount(at[: len(co)], ce.field("count").to_numpy(zero_copy_only=False), len(pair)).astype(np.int32)
    h = np.bincount(at[len(co) :], he.field("count").to_numpy(zero_copy_only=False), len(pair)).astype(np.int32)
    return lists_of(pair // v, len(content), {"term": terms.take(pa.array(pair % v)), "c": pa.array(c), "h": pa.array(h)})


def term_stats(content: pa.Array, heading: pa.Array) -> pa.Array:
    """Like ``merged`` from the lists of tokens."""
    (co, ce), (ho, he) = flat(content), flat(heading)
    code, terms = codes(pa.concat_arrays([ce, he]))
    v = max(len(terms), 1)
    # The lowest bit tells headings from contents, so one sort counts both.
    seen, n = np.unique((np.concatenate([co, ho]) * v + code) * 2 + (np.arange(len(code)) >= len(co)), return_counts=True)
    pair, at = np.unique(seen >> 1, return_inverse=True)
    of = [np.bincount(at, n * ((seen & 1) == k), len(pair)).astype(np.int32) for k in (0, 1)]
    return lists_of(pair // v, len(content), {"term": terms.take(pa.array(pair % v)), "c": pa.array(of[0]), "h": pa.array(of[1])})


def pairs(terms: pa.Array) -> pa.Array:
    """[[term, count], ...] as JSON, of each list of (term, count)."""
    owner, elements = flat(terms)
    code, distinct = codes(elements.field("term"))
    quoted = pa.array([json.dumps(t, ensure_ascii=False) for t in distinct.to_pylist()], pa.string()).take(pa.array(code))
    one = pc.binary_join_element_wise("[", quoted, ",", elements.field("count").cast(pa.string()), "]", "")
    offsets = pa.array(np.searchsorted(owner, np.arange(len(terms) + 1)).astype(np.int32))
    joined = pc.binary_join_element_wise("[", pc.binary_join(pa.ListArray.from_arrays(offsets, one), ","), "]", "")
    return pc.if_else(terms.is_null(), pa.scalar(None, pa.string()), joined)


def unpaired(lines: pa.Array) -> pa.Array:
    """The inverse of ``pairs``; null for anything that isn't a list of pairs of a string and a number."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and -(2**31) <= x < 2**31
    rows, terms, counts, missing = [], [], [], []
    for i, text in enumerate(lines.to_pylist()):
        try:
            got = None if text is None else json.loads(text)
        except ValueError:
            got = None
        good = isinstance(got, list) and all(isinstance(r, list) and len(r) == 2 and isinstance(r[0], str) and number(r[1]) for r in got)
        missing.append(not good)
        if good:
            rows.append(np.full(len(got), i))
            terms += [r[0] for r in got]
            counts += [int(r[1]) for r in got]
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return lists_of(rows, len(lines), {"term": pa.array(terms, pa.string()), "count": pa.array(counts, pa.int32())}, pa.array(missing))


def parts(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of one batch in runs of rows of `PART_BYTES` at most, in order, none copied."""
    n = len(columns[0])
    if n < 2 or sum(c.nbytes for c in columns) <= PART_BYTES:
        yield columns
    else:
        for run in (slice(None, n // 2), slice(n // 2, None)):
            yield from parts(tuple(c[run] for c in columns))


def each(f: Callable, kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """A function of whole Arrow columns from one of single values; None stays None where f lets it."""
    return lambda column: pa.array([f(x) for x in column.to_pylist()], kind)
