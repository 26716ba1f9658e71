"""Operator 3, substring dedup by recompression.

Texts are strings of words. In rounds, runs of one symbol become a symbol named after it and the run's length, then pairs of neighbours become a
symbol named after both, where a coin of the left symbol and of the round falls 0 and that of the right one 1. Names and coins are hashes of what
they stand for, so they are global: every task names alike without an exchange, and equal substrings get equal symbols but for a few at their
ends. A symbol that spans ANCHOR words or more takes no part in further rounds; it is an anchor.

Spark then groups the anchors: one that occurs in two documents is shared. Every window of MIN_WORDS words that holds a shared anchor is a
candidate; windows are grouped by 95 bits of two hashes of their words, which verifies them: a window that occurs in two documents is a repeat, and a
document's overlapping repeats are merged to spans. So each span is a union of windows each of which occurs in another document too.

What HOT documents of one slice share is known there to be shared. Its rows in that task aren't grouped then; two of its documents stand for them where
the value's other rows are grouped. So a passage in a third of all documents sends two rows from each task to one place, not all.

Copies of a whole text are set apart first: one of them stands for all, and each of them is a repeat from end to end.

Cases: texts of fewer than MIN_WORDS words have no repeats; null and empty texts neither; rows of one doc_id are one document, so what repeats only
among them is no repeat, and spans of equal texts are reported once; rows without doc_id are left out; an empty table gives no rows; other
columns are ignored. Runs of equal words longer than any window are named alike whatever their length, so passages within them are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandix.llm.common import U, Words, cut, mix, prefixes, slices, spans, table, utf8

MIN_WORDS = 50
ANCHOR = 8
ROUNDS = 14
#: Documents of a slice that must share a value for its rows to be left out of the grouping.
HOT = 8


def recompress(symbols: np.ndarray, owner: np.ndarray, anchor: int = ANCHOR, window: int = MIN_WORDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols of all texts on end and the text of each, to the anchors: symbol, first word, number of words."""
    at, size = np.arange(len(symbols)), np.ones(len(symbols), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in range(rounds):
        if len(symbols) < 2:
            break
        # Runs.
        new = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])])
        if not new.all():
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(symbols)))
            total = np.add.reduceat(size, start)
            times = np.minimum(n, -(-window // size[start]))
            symbols = np.where(n > 1, mix(symbols[start] ^ mix(times.astype(U) + U(0x632BE59BD9B4E019))), symbols[start])
            at, owner, size = at[start], owner[start], total
        # Anchors leave; what they part doesn't meet again, so a cut is kept as an owner of its own.
        big = size >= anchor
        if big.any():
            found.append((symbols[big], at[big], size[big]))
            keep = ~big
            part = np.cumsum(big)
            owner = owner.astype(np.int64) * (int(part[-1]) + 1) + part
            symbols, at, size, owner = symbols[keep], at[keep], size[keep], owner[keep]
            _, owner = np.unique(owner, return_inverse=True) if len(owner) else (None, owner)
            if len(symbols) < 2:
                break
        # Pairs.
        coin = (mix(symbols ^ U((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) & U(1)).astype(bool)
        left = np.flatnonzero(~coin[:-1] & coin[1:] & (owner[:-1] == owner[1:]))
        symbols = symbols.copy()
        symbols[left] = mix(symbols[left] * U(0xD1342543DE82EF95) + symbols[left + 1])
        size = size.copy()
        size[left] += size[left + 1]
        keep = np.ones(len(symbols), bool)
        keep[left + 1] = False
        symbols, at, size, owner = symbols[keep], at[keep], size[keep], owner[keep]
    big = size >= anchor
    found.append((symbols[big], at[big], size[big]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))  # type: ignore[return-value]


class Known:
    """Values that a task knows to be shared, each with the least and the greatest document of the slice that told."""

    def __init__(self, hot: int = HOT) -> None:
        self.hot, self.values, self.low, self.high = hot, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which rows are known to be shared, another document for each of them, values and documents of rows that stand for them elsewhere)."""
        if not len(values):
            return np.zeros(0, bool), docs, values, docs
        order = np.lexsort((docs, values))
        v, d = values[order], docs[order]
        new = np.concatenate([[True], v[1:] != v[:-1]])
        start = np.flatnonzero(new)
        count = np.add.reduceat((new | np.concatenate([[True], d[1:] != d[:-1]])).astype(np.int64), start)
        fresh = (count >= self.hot) & ~np.isin(v[start], self.values)
        told, low, high = v[start][fresh], d[start][fresh], d[np.append(start[1:], len(v)) - 1][fresh]
        if len(told):
            both = np.concatenate([self.values, told])
            order = np.argsort(both)
            self.values, self.low, self.high = both[order], np.concatenate([self.low, low])[order], np.concatenate([self.high, high])[order]
        if not len(self.values):
            return np.zeros(len(values), bool), docs, told, low
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        return self.values[at] == values, np.where(docs == self.low[at], self.high[at], self.low[at]), np.concatenate([told, told]), np.concatenate([low, high])


def _emitted(known: Known, values: np.ndarray, docs: np.ndarray, first: np.ndarray, more: np.ndarray, standing: int) -> list[pa.Array]:
    """(key, doc_id, first, more, other) of a slice's rows.

    A row that is known to be shared has an odd key of its own and `other`; all others have the value with its lowest bit cleared, by which they are
    grouped. Rows that only stand for others have first -1. more: a further number of each row, which those have by value too if `standing`.
    """
    told, other, values2, docs2 = known.split(values, docs)
    if standing and len(values2):
        order = np.argsort(values)
        more2 = more[order[np.searchsorted(values, values2, sorter=order)]]
    else:
        more2 = np.zeros(len(values2), more.dtype)
    own = mix(values + docs.view(U) * U(0x9E3779B97F4A7C15) + first.astype(U)) | U(1)
    key = np.where(told, own, values & ~U(1))
    return [
        pa.array(np.concatenate([key, values2 & ~U(1)]).view(np.int64)), pa.array(np.concatenate([docs, docs2])), pa.array(np.concatenate([first, np.full(len(values2), -1)]).astype(np.int32)), pa.array(np.concatenate([more, more2]).astype(np.int32)),
        pa.array(np.concatenate([other, docs2]), mask=np.concatenate([~told, np.ones(len(values2), bool)])),
    ]


def anchors(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) to (symbol, doc_id, first, n, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(hot)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1])
                own = words.owner()
                symbols, at, size = recompress(words.hash, own, window=min_words)
                keep = words.counts[own[at]] >= min_words
                symbols, at, size = symbols[keep], at[keep], size[keep]
                yield pa.RecordBatch.from_arrays(_emitted(known, symbols, ids[lo:hi][own[at]], at - words.first[own[at]], size, 0), ["symbol", "doc_id", "first", "n", "other"])

    return docs.mapInArrow(run, "symbol bigint, doc_id bigint, first int, n int, other bigint")


def windows(marked: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """marked(doc_id, text, firsts, sizes) of shared anchors to (hash, doc_id, first, check, other) of every window that holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(hot)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            fo, firsts = batch.column(2).offsets.to_numpy(), batch.column(2).flatten().to_numpy()
            fo = fo - fo[0]
            sizes = batch.column(3).flatten().to_numpy()
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1])
                n = len(words.hash)
                part = slice(fo[lo], fo[hi])
                own = np.repeat(np.arange(hi - lo), np.diff(fo[lo : hi + 1]))
                base = words.first[own]
                last = words.first[own + 1] - min_words
                whole = np.minimum(sizes[part], min_words)
                begin = np.maximum(base + firsts[part] + whole - min_words, base)
                end = np.minimum(base + firsts[part] + sizes[part] - whole, last)
                good = begin <= end
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, begin[good], 1)
                np.add.at(step, end[good] + 1, -1)
                at = np.flatnonzero(np.cumsum(step[:n]) > 0)
                hashes = spans(prefixes(words.hash), at, at + min_words)
                check = (spans(prefixes(mix(words.hash ^ U(0x2545F4914F6CDD1D))), at, at + min_words) >> U(32)).astype(np.uint32).view(np.int32)
                who = np.searchsorted(words.first, at, "right") - 1
                for i in range(0, max(len(at), 1), 200_000):
                    p = slice(i, i + 200_000)
                    yield pa.RecordBatch.from_arrays(_emitted(known, hashes[p], ids[lo:hi][who[p]], at[p] - words.first[who[p]], check[p], 1), ["hash", "doc_id", "first", "check", "other"])

    return marked.mapInArrow(run, "hash bigint, doc_id bigint, first int, check int, other bigint")


def shared(rows: DataFrame, *by: str) -> DataFrame:
    """The rows whose value in `by` occurs in two doc_ids, with `other`: the least doc_id that has it, or the greatest for the least itself; where rows tell another already, that one. One shuffle; groups stream."""
    w = Window.partitionBy(*by)
    both = rows.withColumn("_low", F.min("doc_id").over(w)).withColumn("_high", F.max("doc_id").over(w)).where("other IS NOT NULL OR (_low <> _high AND first >= 0)")
    return both.withColumn("other", F.coalesce("other", F.when(F.col("doc_id") == F.col("_low"), F.col("_high")).otherwise(F.col("_low")))).drop("_low", "_high")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, first_word, n_words, other_doc_id): each passage of a document that is repeated in others, one of which is named."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0").withColumn("h", F.unhex(F.md5("text")))
    # One document stands for all with its text.
    keys = rows.select("doc_id", "h", F.regexp_count("text", F.lit("[^ \\t\\n\\r\\x0B\\f]+")).alias("n_words")).where(F.col("n_words") >= min_words).distinct()
    w = Window.partitionBy("h")
    keys = cut(keys.withColumn("low", F.min("doc_id").over(w)).withColumn("high", F.max("doc_id").over(w)))
    copies = keys.where("low <> high").select("doc_id", F.lit(0).alias("first_word"), "n_words", F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other_doc_id"))
    found = shared(anchors(rows.select("doc_id", "text"), min_words, hot), "symbol").groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("a"))
    found = found.join(keys.where("doc_id = low").select("doc_id", "h"), "doc_id")
    marked = rows.hint("merge").join(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h"), (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h"))).select("doc_id", "text", F.col("a.first").alias("firsts"), F.col("a.n").alias("sizes"))
    same = shared(windows(marked, min_words, hot), "hash", "check")
    order = Window.partitionBy("doc_id").orderBy("first")
    same = same.groupBy("doc_id", "first").agg(F.min("other").alias("other"))
    parts = same.withColumn("new", F.coalesce(F.col("first") - F.lag("first").over(order) > min_words, F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(order))
    merged = parts.groupBy("doc_id", "part").agg(F.min("first").alias("first_word"), (F.max("first") - F.min("first") + min_words).cast("int").alias("n_words"), F.min("other").alias("other_doc_id")).drop("part")
    whole = copies.select("doc_id").distinct()
    return merged.join(whole, "doc_id", "left_anti").unionByName(copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
