"""Shared by the operators: the shared scratch folder, and numpy kernels over the flat UTF-8 buffers of Arrow batches.

The kernels look at all texts of a slice at once: bytes are hashed with a polynomial modulo 2**64 whose prefix sums give the hash of any
span, so words, shingles and windows cost a few vector operations and no Python loop over words.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.sources.tables import spread

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Where that is unset, on a local master only, in one made for this session and deleted with the process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_strandix_scratch", None)
        if not base:
            if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = spark._strandix_scratch = tempfile.mkdtemp(prefix="strandix-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def filesystem(path: str):
    """The file system of a path and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def discard(path: str) -> None:
    """Deletes a folder of scratch that nothing reads any more."""
    files, root = filesystem(path)
    try:
        files.delete_dir(root)
    except FileNotFoundError:
        pass


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; the plan above starts from reliable files."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with columns _0, _1, ... and those names, so that no column of the caller's can clash with one of an operator's."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def text_key(text: Column) -> Column:
    """The hash by which texts are told apart; a null text is as an empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


#: Rows of doc_ids and text hashes, about 50 bytes each in memory, up to which they are broadcast so that the texts needn't be shuffled.
MOST_GONE = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id and text aren't in gone(doc_id, h), nulls like values; columns as they were. The texts are shuffled only where `gone` has over MOST_GONE rows."""
    gone = cut(gone)
    few = gone.count() <= MOST_GONE
    doc_id, text = docs.columns.index("doc_id"), docs.columns.index("text")
    rows, names = plain(docs)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"))
    gone = F.broadcast(gone) if few else gone.hint("merge")
    kept = rows.join(gone, F.col(names[doc_id]).cast("bigint").eqNullSafe(F.col("gone_id")) & (text_key(F.col(names[text])) == F.col("gone_h")), "left_anti")
    return kept.toDF(*docs.columns)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U), dtype=U)]) for b in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def prefixes(values: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], dtype=U, out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of values[start:end] for each pair; equal spans have equal hashes wherever they lie."""
    _, down = _POWERS.get(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and row offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        if column.null_count:
            column = column.fill_null("")
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        n = len(column)
        _, offsets, data = column.buffers()
        o = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o
    return utf8(column.cast(pa.string()))


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each, one row at least: whole texts, however long."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words (runs of bytes other than ASCII white space) of some texts: start and end in the buffer, hash, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        buf = data[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        n = len(buf)
        space = _SPACE[buf]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:] = space
        before[at] = True
        after[:n] = space
        after[at] = True
        self.buf = buf
        self.starts = np.flatnonzero(~space & before[:n])
        self.ends = np.flatnonzero(~space & after[1:]) + 1
        self.first = np.searchsorted(self.starts, at)  # len(texts) + 1
        self.hash = spans(prefixes(_BYTE[buf]), self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the runs of k words within a text, the first word of each, and its text."""
        if len(self.hash) < k:
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = self.owner()
        at = np.flatnonzero(own[: len(own) - k + 1] == own[k - 1 :])
        g = np.zeros(len(self.hash) - k + 1, U)
        for j in range(k):
            g = g * U(0xC2B2AE3D27D4EB4F) + self.hash[j : j + len(g)]
        return mix(g[at]), at, own[at]


def text_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hash of each whole text."""
    at = offsets - offsets[0]
    return spans(prefixes(_BYTE[data[offsets[0] : offsets[-1]]]), at[:-1], at[1:])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
