"""Hybrid search of a batch of questions: exact dense product fused with max-normalised BM25, a pool per question, then diversification.

Both sides are packed: the store in blocks of about a thousand chunks, the questions in portions of at most PORTION: one portion is broadcast, more
are joined with the blocks and don't pass through the driver. Each block meets each portion in a task, which computes all scores of that cell as matrices and keeps every question's pool over all blocks of its partition. So no row for a
question and a chunk exists outside a task but those of the pools. The greatest keyword score
of each question, by which BM25 is normalised, comes from a first pass that emits one number per question and partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandix.config import RankingOptions
from strandix.operators.keywords import B, K1, Block, KeywordIndex, question_terms

PORTION = 2048
#: Rows of pools up to which they go to the store's rows by broadcast: their number is known from the questions'.
MOST_POOLED = 100_000
HIT = "question_id bigint, rank int, ord bigint, id string, source string, chunk_index int, heading string, content string, score double, vector_score double, keyword_score double"
POOL = "question_id bigint, ord bigint, score double, vector_score double, keyword_score double"


class Portion:
    """Questions as flat arrays: vectors, the greatest raw keyword score of each, and their distinct terms with the questions that ask for each, weighted."""

    def __init__(self, rows: list[dict], totals: tuple[int, int, int]) -> None:
        n = totals[0]
        self.ids = np.array([r["question_id"] for r in rows], np.int64)
        vectors = [r["embedding"] for r in rows]
        if len({len(v) for v in vectors}) > 1:
            raise ValueError("the questions' vectors differ in dimension")
        self.vectors = np.array(vectors, np.float32).astype(np.float64).reshape(len(rows), len(vectors[0]) if vectors else 0)
        self.best = np.array([r["best"] or 0.0 for r in rows])
        terms = [(t["term"], i, t["qtf"], t["df"]) for i, r in enumerate(rows) for t in r["terms"] or []]
        hashes, who, qtf, df = (np.array(x, k) for x, k in zip(zip(*terms) if terms else ((),) * 4, (np.int64, np.int64, np.float64, np.float64)))
        weight = qtf * np.log(1 + (n - df + 0.5) / (df + 0.5))
        order = np.argsort(hashes, kind="stable")
        self.who, self.weight = who[order], weight[order]
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(order))

    def raw(self, block: Block, totals: tuple[int, int, int], repeat: int) -> np.ndarray:
        """(questions, chunks): BM25. Terms that many questions ask for go through a matrix product, the others are added one by one."""
        q, n = len(self.ids), len(block.ord)
        out = np.zeros((q, n))
        if not len(self.hashes) or not len(block.hashes):
            return out
        mean = (totals[1] + totals[2] * repeat) / totals[0]
        at = np.minimum(np.searchsorted(self.hashes, block.hashes), len(self.hashes) - 1)
        tf = block.c + block.h.astype(np.float64) * repeat
        hit = np.flatnonzero((self.hashes[at] == block.hashes) & (tf > 0))
        if not len(hit):
            return out
        at, tf = at[hit], tf[hit]
        row = np.searchsorted(block.offsets, hit, "right") - 1
        length = block.ct + block.ht.astype(np.float64) * repeat
        value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
        asked = np.diff(self.first)
        heavy = asked[at] > max(8, q // 16)
        if heavy.any():
            terms, column = np.unique(at[heavy], return_inverse=True)
            left = np.zeros((q, len(terms)))
            for j, t in enumerate(terms):
                part = slice(self.first[t], self.first[t + 1])
                np.add.at(left[:, j], self.who[part], self.weight[part])
            right = np.zeros((len(terms), n))
            right[column, row[heavy]] = value[heavy]
            out += left @ right
        at, row, value = at[~heavy], row[~heavy], value[~heavy]
        if len(at):
            times = asked[at]
            place = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            cell = self.who[place] * n + np.repeat(row, times)
            out += np.bincount(cell, self.weight[place] * np.repeat(value, times), q * n).reshape(q, n)
        return out


@dataclass
class Asked:
    """Questions ready to meet blocks: at most PORTION of them as one portion that is broadcast, more as rows (name, portion) that are joined."""

    totals: tuple[int, int, int]
    rows: DataFrame
    one: Portion | None
    size: int

    def packed(self) -> DataFrame:
        portion = self.size

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, portion):
                    part, sink = batch.slice(lo, portion), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["name", "portion"])

        return self.rows.repartition(max(1, -(-self.rows.count() // portion))).mapInArrow(pack, "name string, portion binary")


def _asked(questions: DataFrame, index: KeywordIndex | None, repeat: int, portion: int = PORTION) -> Asked:
    """index: None where keywords don't count."""
    rows = questions.select(F.col("question_id").cast("bigint").alias("question_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    totals = (0, 0, 0)
    if index is None:
        rows = rows.withColumn("terms", F.lit(None).cast("array<struct<term:bigint,qtf:bigint,df:bigint>>"))
    else:
        totals = index.totals
        df = index.doc_freq.select("term", F.col("df_content" if repeat == 0 else "df_any").alias("df")).where("df > 0")
        asked = question_terms(questions.select(F.col("question_id").cast("bigint").alias("question_id"), "question")).join(df, "term")
        lists = asked.groupBy("question_id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("term"), "qtf", "df")).alias("terms"))
        rows = rows.join(lists, "question_id", "left")
    rows = rows.select("question_id", "embedding", "terms", F.lit(None).cast("double").alias("best"))
    few = [r.asDict(recursive=True) for r in rows.limit(portion + 1).collect()]
    return Asked(totals, rows, Portion(few, totals) if len(few) <= portion else None, portion)


def _cells(blocks: DataFrame, asked: Asked, collector: Callable[[], object], schema: str) -> DataFrame:
    """A collector made in each task takes each block with each portion; what its `rows` gives, now and at the end, is emitted.

    This is a stated set of questions in portions against all rows in blocks. Beyond one portion Spark broadcasts the smaller side if its
    size is small enough and otherwise pairs partitions.
    """
    if asked.one is not None:
        shared = blocks.sparkSession.sparkContext.broadcast(asked.one)

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            into = collector()
            for batch in batches:
                for raw in batch.column(0):
                    into.add("", shared.value, Block.unpack(memoryview(raw.as_buffer())))
                    yield from into.rows(False)
            yield from into.rows(True)

        return blocks.select("block").mapInArrow(alone, schema)
    totals = asked.totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portions: dict[str, Portion] = {}
        into = collector()
        for batch in batches:
            for raw, name, packed in zip(*batch.columns):
                name = name.as_py()
                if name not in portions:
                    if len(portions) >= 32:
                        portions.pop(next(iter(portions)))
                    portions[name] = Portion(pa.ipc.open_stream(packed.as_buffer()).read_all().to_pylist(), totals)
                into.add(name, portions[name], Block.unpack(memoryview(raw.as_buffer())))
                yield from into.rows(False)
        yield from into.rows(True)

    return blocks.crossJoin(asked.packed()).select("block", "name", "portion").mapInArrow(run, schema)


def raw_scores(index: KeywordIndex, questions: DataFrame, repeat: int = 2) -> DataFrame:
    """(question_id, ord, raw) of the chunks that share a term with the question."""
    if "embedding" not in questions.columns:
        questions = questions.withColumn("embedding", F.array().cast("array<float>"))
    asked = _asked(questions, index, repeat)
    totals = index.totals

    class Pairs:
        def __init__(self) -> None:
            self.out: list[pa.RecordBatch] = []

        def add(self, name: str, p: Portion, b: Block) -> None:
            raw = p.raw(b, totals, repeat)
            i, j = np.nonzero(raw)
            self.out.append(pa.RecordBatch.from_arrays([pa.array(p.ids[i]), pa.array(b.ord[j]), pa.array(raw[i, j])], ["question_id", "ord", "raw"]))

        def rows(self, end: bool) -> Iterator[pa.RecordBatch]:
            out, self.out = self.out, []
            return iter(out)

    return _cells(index.blocks, asked, Pairs, "question_id bigint, ord bigint, raw double")


def _with_best(index: KeywordIndex, asked: Asked, repeat: int) -> Asked:
    """The questions with the greatest raw keyword score of each."""
    totals = asked.totals

    class Best:
        def __init__(self) -> None:
            self.held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(self, name: str, p: Portion, b: Block) -> None:
            top = p.raw(b, totals, repeat).max(axis=1, initial=0.0)
            self.held[name] = (p.ids, np.maximum(self.held[name][1], top) if name in self.held else top)

        def rows(self, end: bool) -> Iterator[pa.RecordBatch]:
            for ids, top in self.held.values() if end else ():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top)], ["question_id", "best"])

    best = _cells(index.blocks, asked, Best, "question_id bigint, best double").groupBy("question_id").agg(F.max("best").alias("best"))
    if asked.one is None:
        return replace(asked, rows=asked.rows.drop("best").join(best, "question_id", "left"))
    known = {r.question_id: r.best for r in best.collect()}
    asked.one.best = np.array([known.get(i, 0.0) for i in asked.one.ids.tolist()])
    return asked


def top_of(keys: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest keys of each row; keys of a row differ."""
    return np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:] if keys.shape[1] > k else np.broadcast_to(np.arange(keys.shape[1]), keys.shape)


def candidates(store: DataFrame, questions: DataFrame, options: RankingOptions = RankingOptions(), index: KeywordIndex | None = None, portion: int = PORTION) -> DataFrame:  # noqa: B008
    """store(ord, id, source, chunk_index, heading, content, embedding), questions(question_id, question, embedding) to each question's pool, ranked.

    Scores are ranked after rounding to 9 decimals, equal ones by ord. Vectors that differ in length from the question's fail.
    """
    w, pool, least, repeat = options.keyword_weight, options.pool, options.min_score, options.repeat
    index = index or KeywordIndex.build(store)
    asked = _asked(questions, index if w > 0 else None, repeat, portion)
    if asked.one is not None and not len(asked.one.ids):
        return store.sparkSession.createDataFrame([], HIT)
    if w > 0:
        asked = _with_best(index, asked, repeat)
    totals = asked.totals

    class Pools:
        def __init__(self) -> None:
            self.held: dict[str, list[tuple[np.ndarray, ...]]] = {}

        def add(self, name: str, p: Portion, b: Block) -> None:
            if p.vectors.shape[1] != b.vectors.shape[1]:
                raise ValueError("a stored vector's dimension is not the question's")
            v = p.vectors @ b.vectors.astype(np.float64).T
            k = p.raw(b, totals, repeat) / np.where(p.best > 0, p.best, 1.0)[:, None] if w > 0 else np.zeros_like(v)
            score = np.round((1 - w) * v + w * k, 9)
            m = len(b.ord)
            # Chunks of a block lie by ord, so rounded score and place make one key, exact as long as it fits.
            if np.abs(score).max(initial=0.0) < 4e6:
                at = top_of(np.rint(score * 1e9).astype(np.int64) * m + np.arange(m - 1, -1, -1), pool)
            else:
                at = np.argsort(-score, axis=1, kind="stable")[:, :pool]
            i = np.repeat(np.arange(len(p.ids)), at.shape[1])
            j = at.ravel()
            if least > 0:
                good = score[i, j] >= least
                i, j = i[good], j[good]
            parts = self.held.setdefault(name, [])
            parts.append((p.ids[i], b.ord[j], score[i, j], v[i, j], k[i, j]))
            if len(parts) >= 16:
                self.held[name] = [self.merged(parts)]

        @staticmethod
        def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            q, o, s, v, k = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((o, -s, q))
            q = q[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = order[rank < pool]
            return tuple(x[keep] for x in (np.concatenate([p[0] for p in parts]), o, s, v, k))

        def rows(self, end: bool) -> Iterator[pa.RecordBatch]:
            for parts in self.held.values() if end else ():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in self.merged(parts)], ["question_id", "ord", "score", "vector_score", "keyword_score"])

    pools = _cells(index.blocks, asked, Pools, POOL)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "ord")
    top = pools.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)
    wide = store.select("ord", "id", "source", "chunk_index", "heading", "content")
    joined = wide.join(F.broadcast(top) if asked.one is not None and len(asked.one.ids) * pool <= MOST_POOLED else top, "ord")
    return joined.select("question_id", "rank", "ord", "id", "source", "chunk_index", "heading", "content", "score", "vector_score", "keyword_score")


def select_diverse(hits: DataFrame, per_source: int = 2, most: int | None = None) -> DataFrame:
    """At most so many hits of a source and in all, by rank within each question; ranks are made new."""
    by = Window.partitionBy("question_id", "source").orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= max(1, per_source)).drop("_n")
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))
    return kept if most is None else kept.where(F.col("rank") <= max(1, most))


def search(store: DataFrame, questions: DataFrame, options: RankingOptions = RankingOptions(), index: KeywordIndex | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(candidates, hits): the pool by score, and of it the diversified top."""
    pool = candidates(store, questions, options, index)
    return pool, select_diverse(pool, options.per_source_limit, options.top_k)
