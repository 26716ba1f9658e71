"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixture, token shards.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of documents. Between
stages ``run`` writes Parquet in the shared folder and reads it again, so a lost executor costs one stage's tasks at most.

Cases: nulls in any column, empty texts, ties and repeated rows are decided as each stage says; columns beyond those of documents, whatever their
names, go along to the last stage, which ignores them; an empty table passes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandix.llm import decontaminate, mixing, quality, simhash, token_files
from strandix.llm.common import discard, scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents beyond their language's perplexity threshold go, and those without a text. A null language is one of its own; repeated rows share their fate."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near duplicates the least doc_id, then the least text hash, stays. Repeated rows of one doc_id and text stay or go together; rows without doc_id stay."""
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose text holds a benchmark item go, rows without doc_id too; other rows of the same doc_id stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: a row for each copy that the mixture takes. Rows of one doc_id and source are taken together; a null source is a source."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token shards with seek tables, in files of the shared folder; the rows name them."""
    return token_files.token_shards(docs, scratch(spark, "shards"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_copies), ("decontamination", drop_leaks), ("mixture", mix_sources), ("token_shards", write_shards)]

#: The model, the graphs and the compressed frames have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # The stage before was read for the last time.
        if before:
            discard(before)
        before = path
    return docs
