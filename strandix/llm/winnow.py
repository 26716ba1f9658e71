"""Operator 5, document fingerprints by winnowing.

Every run of K characters is hashed; of every window of W successive hashes the least is chosen, the rightmost of equal ones, and each choice is
kept once with its position. Two texts that share a run of at least W + K - 1 characters share a fingerprint from it (match guarantee), and
no run of fewer than K characters makes one. Hashing and the sliding minimum are vector operations over all texts of a slice; nothing is
shuffled and the positions refer to characters of the text as it is.

Cases: a text shorter than K characters is one gram; a text of fewer than W grams is one window; a null or empty text has empty arrays; repeated
rows have a row each; null doc_ids stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import prefixes, slices, spans, table, utf8

K, W = 50, 100
SCHEMA = "doc_id bigint, positions array<int>, hashes array<bigint>"


def choose(hashes: np.ndarray, first: np.ndarray, w: int) -> np.ndarray:
    """Positions that winnowing keeps. hashes: of all texts on end; first: where each text's begin, and the end."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    size = np.diff(first)
    own = np.repeat(np.arange(len(size)), size)
    # best[i]: position of the rightmost least hash among i..i+span-1; spans double until two of them cover a window.
    best, span = np.arange(n), 1

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[b] <= hashes[a], b, a)

    while span * 2 <= w:
        best[: n - span] = np.where(own[: n - span] == own[span:], lower(best[: n - span], best[span:]), best[: n - span]) if span < n else best[: n - span]
        span *= 2
    # A window at i ends at i + w - 1, or at its text's end where the text has fewer grams.
    windows = np.flatnonzero((np.arange(n) + w <= first[own + 1]) | (np.arange(n) == first[own]))
    end = np.minimum(windows + w, first[own[windows] + 1])
    second = np.maximum(end - span, windows)
    return np.unique(lower(best[windows], best[second]))


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                raw = data[offsets[lo] : offsets[hi]]
                chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                at = lead[offsets[lo : hi + 1] - offsets[lo]]
                size = np.diff(at)
                grams = np.where(size == 0, 0, np.maximum(size - k + 1, 1))
                first = np.concatenate([[0], np.cumsum(grams)])
                own = np.repeat(np.arange(hi - lo), grams)
                start = np.arange(first[-1]) - first[own] + at[own]
                hashes = spans(prefixes((chars + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)), start, np.minimum(start + k, at[own + 1]))
                kept = choose(hashes, first, w)
                bounds = np.searchsorted(kept, first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.ListArray.from_arrays(bounds, pa.array((start - at[own])[kept].astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(hashes[kept].view(np.int64)))],
                    ["doc_id", "positions", "hashes"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
