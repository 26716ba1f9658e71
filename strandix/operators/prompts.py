"""Context, messages and answers as Columns and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandix.config import PromptOptions

ChatFunction = Callable[[list[dict]], str]


def block(rank: Column, source: Column, heading: Column, content: Column) -> Column:
    line = F.when(F.coalesce(heading, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("heading="), heading, F.lit("\n")))
    return F.concat(F.lit("---\n["), rank.cast("string"), F.lit("] source="), source, F.lit("\n"), line, content, F.lit("\n---"))


def build_context(hits: DataFrame) -> DataFrame:
    """(question_id, context): the hits' blocks by rank."""
    rows = hits.select("question_id", F.struct("rank", block(F.col("rank"), F.col("source"), F.col("heading"), F.col("content")).alias("b")).alias("x"))
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("context"))


def build_messages(context: Column, question: Column, options: PromptOptions = PromptOptions()) -> Column:  # noqa: B008
    user = F.concat(F.lit(f"{options.context_label}：\n"), context, F.lit(f"\n\n{options.question_label}：\n"), question)
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(options.system)), message("user", user))


def answer(questions: DataFrame, hits: DataFrame, chat: ChatFunction, options: PromptOptions = PromptOptions(), messages: Callable[[Column, Column], Column] | None = None) -> DataFrame:  # noqa: B008
    """(question_id, question, context, answer, no_answer_reason). A question without hits isn't sent to the model."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda m: None if m is None else chat([dict(x) for x in m]))

    rows = questions.select("question_id", "question").join(build_context(hits), "question_id", "left")
    build = messages or (lambda c, q: build_messages(c, q, options))
    asked = rows.where("context IS NOT NULL").withColumn("answer", run.asNondeterministic()(build(F.col("context"), F.col("question")))).withColumn("no_answer_reason", F.lit(None).cast("string"))
    silent = rows.where("context IS NULL").withColumns({"context": F.lit(""), "answer": F.lit(options.unknown_answer), "no_answer_reason": F.lit("no-hits")})
    return asked.unionByName(silent)


def serialize(rows: DataFrame, include_context: bool = False) -> DataFrame:
    """(question_id, json) of answers; null fields and, unless asked for, the context are left out."""
    columns = ["question", "answer", "no_answer_reason", *(["context"] if include_context else [])]
    return rows.select("question_id", F.to_json(F.struct(*[F.col(c) for c in columns])).alias("json"))


def hit_table(hits: DataFrame, width: int = 40) -> DataFrame:
    """(question_id, rank, line): fixed-width lines of hits for a terminal."""
    short = F.when(F.length("content") > width, F.concat(F.substring("content", 1, width - 3), F.lit("..."))).otherwise(F.col("content"))
    widest = F.max(F.length("id")).over(Window.partitionBy("question_id"))
    return hits.select("question_id", "rank", F.concat(F.lpad(F.col("rank").cast("string"), 2, " "), F.lit("  "), F.expr("format_number(score, '0.0000')"), F.lit("  "), F.rpad(F.col("id"), widest, F.lit(" ")), F.lit("  "), F.replace(short, F.lit("\n"), F.lit(" "))).alias("line"))
