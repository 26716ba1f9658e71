"""Postings, corpus statistics, and the index that BM25 is scored from.

A chunk is one row, so its term counts need no shuffle. The index holds the chunks in blocks: hashed terms with their counts, lengths and vectors as
flat arrays. A search multiplies blocks with portions of questions inside tasks (``operators.search``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandix.functions import kernels as K
from strandix.functions.text import arrow, tokenize
from strandix.operators.chunks import complete_keyword_stats

K1, B = 1.2, 0.75
#: Chunks of a block, and bytes beyond which it is closed earlier.
BLOCK, BLOCK_BYTES = 1024, 8 << 20


_TERMS = "array<struct<term:string,c:int,h:int>>"
_STATS = ("kw_heading_terms", "kw_heading_count", "kw_content_terms", "kw_content_count")


def with_terms(chunks: DataFrame) -> DataFrame:
    """The chunks with the column terms: (term, c, h) of each term of content or heading. Statistics that rows carry are taken; the others are counted."""
    if {*_STATS} <= {*chunks.columns}:
        return complete_keyword_stats(chunks).withColumn("terms", arrow(K.merged, _TERMS)("kw_content_terms", "kw_heading_terms"))
    rows = chunks.drop(*_STATS).withColumns({"_c": tokenize(F.col("content")), "_h": tokenize(F.col("heading"))})
    return rows.withColumns({"terms": arrow(K.term_stats, _TERMS)("_c", "_h"), "kw_content_count": F.size("_c"), "kw_heading_count": F.size("_h")}).drop("_c", "_h")


def postings(chunks: DataFrame) -> DataFrame:
    """(ord, term, content_tf, heading_tf, content_tokens, heading_tokens), made where the chunks lie."""
    rows = with_terms(chunks).select("ord", F.col("kw_content_count").alias("content_tokens"), F.col("kw_heading_count").alias("heading_tokens"), F.explode("terms").alias("t"))
    return rows.select("ord", F.col("t.term").alias("term"), F.col("t.c").alias("content_tf"), F.col("t.h").alias("heading_tf"), "content_tokens", "heading_tokens")


def doc_freq(p: DataFrame) -> DataFrame:
    """(term, df_content, df_any)."""
    return p.groupBy("term").agg(F.count_if(F.col("content_tf") > 0).alias("df_content"), F.count("*").alias("df_any"))


def corpus(chunks: DataFrame) -> DataFrame:
    """One row: (n, total_content_tokens, total_heading_tokens)."""
    sizes = (F.col(f"kw_{n}_count") if f"kw_{n}_count" in chunks.columns else F.size(tokenize(F.col(n))) for n in ("content", "heading"))
    content, heading = (F.coalesce(F.sum(s), F.lit(0)) for s in sizes)
    return chunks.agg(F.count("*").alias("n"), content.alias("total_content_tokens"), heading.alias("total_heading_tokens"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term, qtf)."""
    return questions.select("question_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))


def known_terms(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(question_id, n_terms, n_known): a question's distinct terms, and those of them that vocabulary(term) has. One with no known term has no keyword score."""
    known = vocabulary.select(F.col("term").alias("known")).distinct()
    return question_terms(questions).join(known, F.col("term") == F.col("known"), "left").groupBy("question_id").agg(F.count("term").alias("n_terms"), F.count("known").alias("n_known"))


class Block:
    """Chunks of a store as flat arrays, by ord."""

    def __init__(self, ord_: np.ndarray, vectors: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, c: np.ndarray, h: np.ndarray, ct: np.ndarray, ht: np.ndarray) -> None:
        self.ord, self.vectors, self.offsets, self.hashes, self.c, self.h, self.ct, self.ht = ord_, vectors, offsets, hashes, c, h, ct, ht

    def pack(self) -> bytes:
        parts = [self.ord, self.vectors, self.offsets, self.hashes, self.c, self.h, self.ct, self.ht]
        return b"".join([np.array([len(self.ord), self.vectors.shape[1], len(self.hashes)], np.int64).tobytes(), *(np.ascontiguousarray(x).tobytes() for x in parts)])

    @classmethod
    def unpack(cls, raw: memoryview) -> Block:
        n, dim, m = np.frombuffer(raw, np.int64, 3).tolist()
        out, at = [], 24
        for kind, size in ((np.int64, n), (np.float32, n * dim), (np.int64, n + 1), (np.int64, m), (np.int32, m), (np.int32, m), (np.int32, n), (np.int32, n)):
            out.append(np.frombuffer(raw, kind, size, at))
            at += size * np.dtype(kind).itemsize
        out[1] = out[1].reshape(n, dim)
        return cls(*out)


def blocks(chunks: DataFrame, rows: int = BLOCK) -> DataFrame:
    """chunks with terms and embedding to rows (block). Vectors of several lengths fail."""
    flat = chunks.select(
        "ord", F.col("embedding").cast("array<float>"), F.transform("terms", lambda t: F.xxhash64(t["term"])), F.col("terms.c"), F.col("terms.h"), F.col("kw_content_count").cast("int"), F.col("kw_heading_count").cast("int")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                hi = min(lo + rows, batch.num_rows)
                while hi - lo > 1 and batch.slice(lo, hi - lo).nbytes > BLOCK_BYTES:
                    hi = lo + (hi - lo) // 2
                part = batch.slice(lo, hi - lo).sort_by("ord")
                lengths = np.unique(pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))
                if len(lengths) != 1:
                    raise ValueError("the stored vectors differ in dimension")
                flat = [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
                sizes = pa.compute.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                one = lambda i: part.column(i).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                block = Block(
                    one(0).astype(np.int64), flat[0].astype(np.float32).reshape(part.num_rows, int(lengths[0])), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                    flat[1].astype(np.int64), flat[2].astype(np.int32), flat[3].astype(np.int32), one(5).astype(np.int32), one(6).astype(np.int32),
                )
                yield pa.RecordBatch.from_arrays([pa.array([block.pack()], pa.binary())], ["block"])
                lo = hi

    import pyarrow.compute  # noqa: F401

    return flat.toDF("ord", "e", "t", "c", "h", "ct", "ht").mapInArrow(pack, "block binary")


@dataclass
class KeywordIndex:
    """What searches reuse: the chunks in blocks, the terms' document frequencies, and the corpus's totals."""

    blocks: DataFrame
    doc_freq: DataFrame
    corpus: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, keep: bool = False) -> KeywordIndex:
        """With keep, what is made is cached; ``free`` lets it go. Statistics that a store carries are taken from it."""
        rows = with_terms(chunks if "embedding" in chunks.columns else chunks.withColumn("embedding", F.array().cast("array<float>")))
        if keep:
            rows = rows.select("ord", "embedding", "terms", "kw_content_count", "kw_heading_count").persist()
        terms = rows.select(F.explode("terms").alias("t")).select(F.col("t.term").alias("term"), F.col("t.c").alias("content_tf"))
        out = cls(blocks(rows), doc_freq(terms), corpus(rows))
        if keep:
            out.blocks, out.doc_freq = out.blocks.persist(), out.doc_freq.persist()
            out.blocks.count(), out.doc_freq.count(), out.totals  # noqa: B018
            rows.unpersist()
        return out

    @cached_property
    def totals(self) -> tuple[int, int, int]:
        return tuple(self.corpus.first())  # type: ignore[return-value]

    def free(self) -> None:
        self.blocks.unpersist()
        self.doc_freq.unpersist()

    def bm25(self, questions: DataFrame, repeat: int = 2) -> DataFrame:
        """(question_id, ord, raw) of chunks that share a term with the question, made inside the blocks: nothing of it is shuffled."""
        from strandix.operators.search import raw_scores

        return raw_scores(self, questions, repeat)
