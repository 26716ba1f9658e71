"""Structured Streaming: documents arriving as files are ingested, questions arriving as rows are answered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from strandix.config import IngestOptions, RankingOptions
from strandix.operators.chunks import build_chunks
from strandix.operators.search import select_diverse
from strandix.plans.qa import Searcher


def upsert(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Chunks of new documents replace all chunks of the same source."""
    if old is None:
        return new
    return old.join(new.select("source").distinct(), "source", "left_anti").unionByName(new)


def ingest_stream(documents: DataFrame, path: str, checkpoint: str, options: IngestOptions = IngestOptions(), available_now: bool = True) -> StreamingQuery:  # noqa: B008
    """A stream of (source, content, doc_ord) into chunk tables, one per batch under `path`; a batch that is run again writes the same table again. ``current`` reads them."""

    def write(batch: DataFrame, epoch: int) -> None:
        last = Window.partitionBy("source").orderBy(F.desc("doc_ord"))
        newest = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        build_chunks(newest, options).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(chunks: DataFrame) -> DataFrame:
    """Of each source the chunks of its last epoch."""
    last = chunks.groupBy("source").agg(F.max("epoch").alias("epoch"))
    return chunks.join(last, ["source", "epoch"], "left_semi")


def answer_stream(questions: DataFrame, retriever: Callable[[], Searcher], sink: Callable[[DataFrame, int], None], checkpoint: str, ranking: RankingOptions = RankingOptions(), available_now: bool = True) -> StreamingQuery:  # noqa: B008
    """A stream of (question_id, question, embedding); `retriever` is asked anew for each batch, so a reloaded index takes effect at once."""

    def run(batch: DataFrame, epoch: int) -> None:
        sink(select_diverse(retriever().search(batch, ranking), ranking.per_source_limit, ranking.top_k), epoch)

    writer = questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
