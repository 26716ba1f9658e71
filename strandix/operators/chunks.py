"""Documents to chunk records."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandix.config import IngestOptions
from strandix.functions.text import embedding_text, split_semantic, term_counts, tokenize

Chunker = Callable[[dict, dict], list[dict]]


def build_chunks(documents: DataFrame, options: IngestOptions = IngestOptions(), chunker: Chunker | None = None) -> DataFrame:  # noqa: B008
    """documents(source, content, doc_ord) to chunk rows in the order (doc_ord, chunk_index).

    With a chunker, a function of ({source, content}, {chunk_size, chunk_overlap}) that lists {heading, content}, it is called instead of the
    built-in splitting, in batches of an Arrow-fed UDF.
    """
    if chunker is None:
        pieces = split_semantic(F.col("content"), options.chunk_size, options.chunk_overlap)
    else:
        sizes = {"chunk_size": options.chunk_size, "chunk_overlap": options.chunk_overlap}

        @F.pandas_udf("array<struct<heading:string,content:string>>")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for sources, contents in batches:
                yield pd.Series([[{"heading": c.get("heading") or "", "content": c["content"]} for c in chunker({"source": s, "content": t}, sizes)] for s, t in zip(sources, contents)])

        pieces = run("source", "content")
    rows = documents.select("doc_ord", "source", F.posexplode(pieces).alias("chunk_index", "c"))
    rows = rows.select("doc_ord", "source", "chunk_index", F.concat_ws("#", "source", "chunk_index").alias("id"), F.coalesce("c.heading", F.lit("")).alias("heading"), F.col("c.content").alias("content"))
    rows = rows.withColumn("embedding_text", embedding_text(F.col("heading"), F.col("content"), options.heading_weight)).withColumn("hash", F.sha1(F.encode("embedding_text", "UTF-8")))
    return with_keyword_stats(rows)


def with_keyword_stats(rows: DataFrame) -> DataFrame:
    # Tokens are a column of their own first, so that a text is tokenised once for both of what is made of them.
    rows = rows.withColumns({f"_{n}": tokenize(F.col(n)) for n in ("heading", "content")})
    return rows.withColumns({c: x for n in ("heading", "content") for c, x in ((f"kw_{n}_terms", term_counts(F.col(f"_{n}"))), (f"kw_{n}_count", F.size(f"_{n}")))}).drop("_heading", "_content")


def complete_keyword_stats(rows: DataFrame) -> DataFrame:
    """Rows that lack any of the four statistics get all of them anew; the others aren't tokenised."""
    names = [f"kw_{n}_{k}" for n in ("heading", "content") for k in ("terms", "count")]
    if not {*names} <= {*rows.columns}:
        return with_keyword_stats(rows.drop(*names))
    lacking = F.lit(False)
    for n in names:
        lacking = lacking | F.col(n).isNull()
    return rows.where(~lacking).unionByName(with_keyword_stats(rows.where(lacking).drop(*names)).select(rows.columns))


#: Base and modulus of the hash that joins the documents' digests: hash(a then b) = hash(a) * BASE ** len(b) + hash(b), so it may be cut anywhere.
_BASE, _PRIME = 0x9E3779B97F4A7C15F39CC0605CEDC835, 2**521 - 1
LANES = 3


def fingerprint(chunks: DataFrame, options: IngestOptions, provider: str, model: str) -> DataFrame:
    """One row: a SHA-1 over the settings and, in the documents' order, each chunk's identity, hash and keyword statistics.

    Each chunk is digested where it lies. A chunk's digest holds its index, so a document's are combined in any order (exclusive or, partial sums before the
    shuffle), and the documents' digests are folded in each partition of a distributed sort. What meets in one place is a row for each
    partition, and the result doesn't depend on where partitions end.
    """
    digest = F.sha1(F.encode(F.concat_ws("|", F.to_json(F.struct("id", "source", "chunk_index", "hash", "kw_heading_count", "kw_content_count")), F.xxhash64("kw_heading_terms").cast("string"), F.xxhash64("kw_content_terms").cast("string")), "UTF-8"))
    lanes = chunks.select("doc_ord", digest.alias("digest")).groupBy("doc_ord").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("digest", F.lit(i))).alias(f"x{i}") for i in range(LANES)])
    per_doc = lanes.select("doc_ord", F.sha1(F.encode(F.concat_ws(",", "n", *[F.col(f"x{i}").cast("string") for i in range(LANES)]), "UTF-8")).alias("digest"))
    head = f"2|1|{provider}|{model}|{options.chunk_size}|{options.chunk_overlap}|{options.heading_weight:g}\n"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, h = None, 0, 0
        for batch in batches:
            for key, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first, n, h = (key if first is None else first), n + 1, (h * _BASE + int(d, 16)) % _PRIME
        if n:
            yield pa.RecordBatch.from_pydict({"first": [first], "n": [n], "h": [str(h)]})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, h = 0, 0
        for row in sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["first"]):
            n, h = n + row["n"], (h * pow(_BASE, row["n"], _PRIME) + int(row["h"])) % _PRIME
        yield pa.RecordBatch.from_pydict({"fingerprint": [hashlib.sha1(f"{head}{n}:{h}".encode()).hexdigest()]})

    return per_doc.orderBy("doc_ord").mapInArrow(fold, "first bigint, n bigint, h string").repartition(1).mapInArrow(join, "fingerprint string")
