"""Questions to answers, end to end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.config import ModelConfig, PromptOptions, RankingOptions, StoreMeta
from strandix.functions.text import text_trim
from strandix.functions.vectors import normalize
from strandix.operators import prompts
from strandix.operators.embedding import EmbedFunction, checked
from strandix.operators.keywords import KeywordIndex
from strandix.operators.search import candidates, select_diverse
from strandix.sources.store import read_store


class Searcher(Protocol):
    """What answers questions; a store of one's own need only have these."""

    meta: StoreMeta | None
    record_count: int

    def search(self, questions: DataFrame, options: RankingOptions) -> DataFrame: ...


@dataclass
class Retriever:
    """A store with its keyword index, both cached; ``reload`` builds the new one first and then lets the old one go."""

    meta: StoreMeta | None
    store: DataFrame
    index: KeywordIndex
    record_count: int

    @classmethod
    def of(cls, store: DataFrame, meta: StoreMeta | None = None) -> Retriever:
        store = store.persist()
        return cls(meta, store, KeywordIndex.build(store, keep=True), store.count())

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: ModelConfig | None = None) -> Retriever:
        meta, store = read_store(spark, path, config)
        return cls.of(store, meta)

    def search(self, questions: DataFrame, options: RankingOptions = RankingOptions()) -> DataFrame:  # noqa: B008
        return candidates(self.store, questions, options, self.index)

    def free(self) -> None:
        self.index.free()
        self.store.unpersist()

    def reload(self, path: str, config: ModelConfig | None = None) -> Retriever:
        new = Retriever.open(self.store.sparkSession, path, config)
        self.free()
        return new


def embed_questions(questions: DataFrame, embedder: EmbedFunction) -> DataFrame:
    """questions(question_id, question) trimmed and with a unit vector; a blank question fails before it is sent."""

    @F.pandas_udf("array<double>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if (texts.isna() | (texts == "")).any():
                raise ValueError("a question is blank")
            yield pd.Series(checked(texts.tolist(), embedder(texts.tolist())), dtype=object)

    trimmed = questions.select("question_id", text_trim(F.col("question")).alias("question"))
    return trimmed.withColumn("embedding", call.asNondeterministic()("question")).withColumn("embedding", normalize(F.col("embedding")).cast("array<float>"))


@dataclass
class Answers:
    """Rows of answers, and what is cached for them until ``free``."""

    rows: DataFrame
    cached: tuple[DataFrame, ...]

    def free(self) -> None:
        for df in self.cached:
            df.unpersist()


def answer(
    questions: DataFrame, retriever: Searcher, embedder: EmbedFunction, chat: prompts.ChatFunction, ranking: RankingOptions = RankingOptions(), prompt: PromptOptions = PromptOptions(),  # noqa: B008
    on_retrieved: Callable[[DataFrame], None] | None = None, include_candidates: bool = True, on_meta: Callable[[StoreMeta | None], None] | None = None,
) -> Answers:
    """(question_id, question, answer, context, no_answer_reason, hits[, candidates]); calls to the models are made once, before the joins. Free the answers once they are read."""
    if on_meta:
        on_meta(retriever.meta)
    asked = embed_questions(questions, embedder).persist()
    pool = retriever.search(asked, ranking).persist()
    hits = select_diverse(pool, ranking.per_source_limit, ranking.top_k)
    if on_retrieved:
        on_retrieved(hits)
    out = prompts.answer(asked, hits, chat, prompt)
    for name, rows in (("hits", hits), *((("candidates", pool),) if include_candidates else ())):
        one = F.struct("rank", "id", "source", "chunk_index", "heading", "content", "score", "vector_score", "keyword_score")
        out = out.join(rows.groupBy("question_id").agg(F.array_sort(F.collect_list(one)).alias(name)), "question_id", "left")
    return Answers(out, (asked, pool))
