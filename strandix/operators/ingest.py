"""Ingest: documents to chunks to vectors to the store, skipping what hasn't changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandix.config import IngestOptions, ModelConfig, StoreMeta
from strandix.operators.chunks import Chunker, build_chunks, fingerprint
from strandix.operators.embedding import EmbedFunction, dimension, embed, latest
from strandix.sources.store import read_store, write_store


@dataclass(frozen=True)
class IngestResult:
    documents: int
    chunks: int
    cached: int
    embedded: int
    skipped: str | None = None
    meta: StoreMeta | None = None


#: Bits of a chunk's index in ord; the documents' order has the 39 above.
CHUNK_BITS = 24


def record_order(doc_ord: Column, chunk_index: Column) -> Column:
    """The documents' order and then the chunk's index, in one number: no two are alike, and what doesn't fit fails."""
    fits = (doc_ord >= 0) & (doc_ord < 1 << 39) & (chunk_index < 1 << CHUNK_BITS)
    return F.when(fits, F.shiftleft(doc_ord.cast("bigint"), CHUNK_BITS).bitwiseOR(chunk_index.cast("bigint"))).otherwise(F.raise_error(F.lit("doc_ord must lie in [0, 2**39) and a document has at most 2**24 chunks")).cast("bigint"))


def counters(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: (records, cached, embedded): chunks, those whose hash the cache has a sound vector for, and the others."""
    known = latest(cache).select("hash").withColumn("_known", F.lit(True))
    return chunks.select("hash").join(known, "hash", "left").agg(F.count("*").alias("records"), F.count("_known").alias("cached"), F.count_if(F.col("_known").isNull()).alias("embedded"))


def ingest(documents: DataFrame, path: str, config: ModelConfig, embedder: EmbedFunction, options: IngestOptions = IngestOptions(), chunker: Chunker | None = None, progress: Callable[[str, dict], None] | None = None) -> IngestResult:  # noqa: B008
    """documents(source, content, doc_ord) into the store at `path`. Nothing is written where there are no documents, no chunks, or no changes."""
    spark = documents.sparkSession
    tell = progress or (lambda stage, facts: None)
    n_docs = documents.count()
    tell("documents", {"documents": n_docs})
    if not n_docs:
        return IngestResult(0, 0, 0, 0, "no-docs")
    chunks = build_chunks(documents, options, chunker).persist()
    try:
        n_chunks = chunks.count()
        tell("chunks", {"chunks": n_chunks})
        if not n_chunks:
            return IngestResult(n_docs, 0, 0, 0, "no-chunks")
        mark = fingerprint(chunks, options, config.provider, config.model).first().fingerprint
        try:
            meta, old = read_store(spark, path, config)
        except (FileNotFoundError, ValueError):
            meta, old = None, None
        if meta is not None and meta.ingest_fingerprint == mark:
            return IngestResult(n_docs, n_chunks, n_chunks, 0, "unchanged", meta)
        cache = old.select("ord", "hash", "embedding") if old is not None else spark.createDataFrame([], "ord long, hash string, embedding array<double>")
        cached = counters(chunks, cache).first().cached
        tell("cache", {"cached": cached, "missing": n_chunks - cached})
        rows = embed(chunks, cache, embedder, options.embed_batch_size, options.concurrency).withColumn("ord", record_order(F.col("doc_ord"), F.col("chunk_index"))).persist()
        dim = dimension(rows)
        meta = StoreMeta(config.provider, config.model, dim, options.chunk_size, options.chunk_overlap, datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), options.heading_weight, mark)
        write_store(rows.select("ord", "id", "source", "chunk_index", "heading", "content", "hash", "kw_heading_terms", "kw_heading_count", "kw_content_terms", "kw_content_count", "embedding"), meta, path)
        rows.unpersist()
        tell("written", {"records": n_chunks})
        return IngestResult(n_docs, n_chunks, cached, n_chunks - cached, None, meta)
    finally:
        chunks.unpersist()
