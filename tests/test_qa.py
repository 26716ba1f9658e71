import json

import pytest
from pyspark.sql import functions as F

from strandix.config import PromptOptions, RankingOptions
from strandix.operators import prompts
from strandix.plans import qa
from strandix.streaming import flows

from .test_search import frame


def chat(messages):
    assert [m["role"] for m in messages] == ["system", "user"]
    return "answer to " + messages[1]["content"].rpartition("\n")[2]


@pytest.fixture(scope="module")
def retriever(spark):
    return qa.Retriever.of(frame(spark, [(0, "a.md", "Cache TTL", "cache entries", [1.0, 0.0]), (1, "b.md", "", "queue", [0.0, 1.0])]))


def ask(spark, retriever, text, **k):
    return qa.answer(spark.createDataFrame([(1, text)], "question_id long, question string"), retriever, lambda texts: [[3.0, 0.0] for _ in texts], k.pop("chat", chat), **k).rows


def test_answers(spark, retriever):
    seen = []
    r = ask(spark, retriever, "  cache ttl? ", on_retrieved=lambda h: seen.extend(h.collect())).first()
    assert (r.question, r.answer, r.no_answer_reason) == ("cache ttl?", "answer to cache ttl?", None)
    assert r.context.startswith("---\n[1] source=a.md\nheading=Cache TTL\ncache entries\n---\n\n---\n[2] source=b.md\nqueue\n---")
    assert [h.id for h in r.hits] == ["a.md#0", "b.md#1"] and len(r.candidates) == 2 and seen[0].id == "a.md#0"
    assert "candidates" not in ask(spark, retriever, "x", include_candidates=False).columns
    assert retriever.record_count == 2


def test_what_an_answer_caches_is_freed(spark, retriever):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    metas = []
    got = qa.answer(spark.createDataFrame([(1, "cache")], "question_id long, question string"), retriever, lambda texts: [[3.0, 0.0] for _ in texts], chat, on_meta=metas.append)
    assert got.rows.count() == 1 and metas == [None] and len(spark.sparkContext._jsc.getPersistentRDDs()) > before
    got.free()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_no_hits_and_no_call(spark, retriever):
    def never(messages):
        raise AssertionError

    r = ask(spark, retriever, "zzz", chat=never, ranking=RankingOptions(min_score=0.9), prompt=PromptOptions(unknown_answer="?")).first()
    assert (r.answer, r.context, r.no_answer_reason, r.hits) == ("?", "", "no-hits", None)


def test_blank_questions_fail(spark, retriever):
    with pytest.raises(Exception, match="blank"):
        ask(spark, retriever, " \n　").collect()


def test_own_messages_and_json(spark, retriever):
    questions = spark.createDataFrame([(1, "q", [1.0, 0.0])], "question_id long, question string, embedding array<float>")
    hits = retriever.search(questions, RankingOptions(1, 1))
    own = lambda c, q: F.array(F.struct(F.lit("user").alias("role"), F.concat(q, F.lit("/"), F.length(c).cast("string")).alias("content")))
    rows = prompts.answer(questions, hits, lambda m: m[0]["content"], messages=own)
    r = rows.first()
    assert r.answer == f"q/{len(r.context)}"
    assert json.loads(prompts.serialize(rows).first().json) == {"question": "q", "answer": r.answer}
    assert "context" in json.loads(prompts.serialize(rows, True).first().json)


def test_questions_as_a_stream(spark, retriever, tmp_path):
    got = []
    spark.createDataFrame([(i, "cache", [1.0, 0.0]) for i in range(3)], "question_id long, question string, embedding array<float>").write.parquet(f"file://{tmp_path}/q")
    stream = spark.readStream.schema("question_id long, question string, embedding array<float>").parquet(f"file://{tmp_path}/q")
    flows.answer_stream(stream, lambda: retriever, lambda df, i: got.extend(df.collect()), f"file://{tmp_path}/ck", RankingOptions(1, 1)).awaitTermination()
    assert sorted((r.question_id, r.id) for r in got) == [(i, "a.md#0") for i in range(3)]
