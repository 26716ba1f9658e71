"""The embedding cache join, embedding of its misses, and what holds before a store is written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandix.functions.vectors import is_valid, normalize

EmbedFunction = Callable[[list[str]], list[list[float]]]


def latest(cache: DataFrame) -> DataFrame:
    """(hash, embedding): of entries with one hash the last by ord; entries without hash or with a broken vector don't count."""
    return cache.where(F.col("hash").isNotNull() & is_valid(F.col("embedding"))).groupBy("hash").agg(F.max_by("embedding", "ord").alias("embedding"))


def hits(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(latest(cache), "hash")


def misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    return chunks.join(latest(cache), "hash", "left_anti")


def checked(inputs: list[str], vectors: list[list[float]]) -> list[list[float]]:
    """One finite, non-empty vector for each input, all of one length."""
    if len(vectors) != len(inputs):
        raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(inputs)} inputs")
    if len({len(v) for v in vectors}) > 1 or any(not len(v) or not np.isfinite(v).all() for v in vectors):
        raise ValueError("the embedder gave vectors that are empty, not finite, or of several lengths")
    return vectors


def embed(chunks: DataFrame, cache: DataFrame, embedder: EmbedFunction, batch: int = 32, concurrency: int | None = None) -> DataFrame:
    """chunks with a normalised embedding, from the cache or, each distinct text once, from the embedder."""

    @F.pandas_udf("array<double>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts, out = series.tolist(), []
            for i in range(0, len(texts), batch):
                out += checked(texts[i : i + batch], embedder(texts[i : i + batch]))
            yield pd.Series(out, dtype=object)

    wanted = misses(chunks, cache).select("hash", "embedding_text").dropDuplicates(["hash"])
    if concurrency:
        wanted = wanted.repartition(concurrency)
    fresh = wanted.select("hash", call.asNondeterministic()("embedding_text").alias("embedding"))
    known = latest(cache).select("hash", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(fresh)
    return chunks.join(known, "hash").withColumn("embedding", normalize(F.col("embedding")))


def dimension(store: DataFrame) -> int:
    """The one dimension of all vectors; fails where there are several."""
    low, high = store.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low is None or low < 1 or low != high:
        raise ValueError(f"vectors have dimensions from {low} to {high}")
    return low
