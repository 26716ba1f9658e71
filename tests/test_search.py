import random

import pytest
from pyspark.sql import functions as F

from strandix.config import RankingOptions
from strandix.operators.keywords import KeywordIndex
from strandix.operators.search import candidates, search, select_diverse

from . import model

STORE = "ord long, id string, source string, chunk_index int, heading string, content string, embedding array<float>"
QUESTION = "question_id long, question string, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(o, f"{s}#{o}", s, o, h, c, e) for o, s, h, c, e in rows], STORE).repartition(3)


def shown(df):
    return [(r.ord, r.score, round(r.vector_score, 9), round(r.keyword_score, 9)) for r in df.orderBy("question_id", "rank").collect()]


def close(a, b):
    assert [x[0] for x in a] == [x[0] for x in b]
    assert all(abs(x - y) < 2e-6 for p, q in zip(a, b) for x, y in zip(p, q))


def test_keywords_can_outrank_vectors(spark):
    rows = [(0, "overview.md", "Overview", "an introduction", [0.95, 0.0]), (1, "cache.md", "Cache TTL", "cache entries expire by ttl", [0.2, 0.0])]
    asked = spark.createDataFrame([(7, "cache ttl", [1.0, 0.0])], QUESTION)
    pool, hits = search(frame(spark, rows), asked, RankingOptions(1, 1, 0, 0.8, 2))
    assert [(r.id, r.rank) for r in hits.collect()] == [("cache.md#1", 1)] and pool.first().keyword_score > 0


def test_random_stores_match_the_model(spark):
    rng = random.Random(3)
    words = ["cache", "ttl", "queue", "缓存", "缓存配置", "a", "b", "c1", "-"]
    rows = []
    for i in range(90):
        if rows and rng.random() < 0.3:
            rows.append((i, rng.choice("abcd"), *rng.choice(rows)[2:]))
        else:
            rows.append((i, rng.choice("abcd"), rng.choice(words), " ".join(rng.choices(words, k=rng.randint(0, 12))), [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(3)]))
    questions = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5))), [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(12)] + [(50, "zzz ???", [0.0, 0.0, 1.0])]
    store, asked = frame(spark, rows), spark.createDataFrame(questions, QUESTION)
    for o in (RankingOptions(), RankingOptions(3, 1, 0.4, 1.0, 0.5), RankingOptions(2, 3, -1, 0.0), RankingOptions(5, 2, 0.2, 0.5, 2.9)):
        want = [model.rank(rows, q, e, o.top_k, o.per_source_limit, o.min_score, o.keyword_weight, o.keyword_heading_weight) for _, q, e in sorted(questions)]
        pool, hits = search(store, asked, o)
        close(shown(pool), [x for p, _ in want for x in p])
        close(shown(hits), [x for _, h in want for x in h])


def test_portions_of_questions_change_nothing(spark):
    rows = [(i, "s", "", f"t{i % 7} x", [float(i % 5), 1.0]) for i in range(40)]
    asked = spark.createDataFrame([(i, f"t{i}", [1.0, i / 10]) for i in range(9)], QUESTION)
    store = frame(spark, rows)
    assert shown(candidates(store, asked, portion=2)) == shown(candidates(store, asked))


def test_no_pair_of_question_and_chunk_is_exchanged(spark):
    rows = [(i, "s", "", f"common t{i % 7}", [1.0]) for i in range(5000)]
    store = frame(spark, rows)
    asked = spark.createDataFrame([(i, f"common t{i}", [1.0]) for i in range(7)], QUESTION)
    index = KeywordIndex.build(store, keep=True)
    pools = candidates(store, asked, RankingOptions(), index)
    assert pools.count() == 7 * 8
    plan = pools._jdf.queryExecution().executedPlan()
    shuffled = [int(m.value()) for m in _metrics(plan, "shuffleRecordsWritten")]
    index.free()
    assert shuffled and max(shuffled) < 7 * 8 * 40


def _metrics(plan, name):
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        if p.metrics().contains(name):
            found.append(p.metrics().apply(name))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_stored_statistics_are_used_and_missing_ones_completed(spark):
    from strandix.operators.chunks import with_keyword_stats

    stored = with_keyword_stats(frame(spark, [(0, "s", "", "alpha", [1.0]), (1, "s", "", "beta", [1.0])]))
    # A store's own counts win over its text; rows without any are counted anew.
    kept = stored.withColumn("content", F.lit("gamma")).withColumn("kw_content_terms", F.when(F.col("ord") == 0, F.col("kw_content_terms")))
    raw = KeywordIndex.build(kept).bm25(spark.createDataFrame([(0, "alpha"), (1, "beta"), (2, "gamma")], "question_id long, question string"))
    assert sorted((r.question_id, r.ord) for r in raw.collect()) == [(0, 0), (2, 1)]


def test_vectors_of_any_size_are_ranked(spark):
    rows = [(i, f"s{i}", "", "x", [1e9 * i]) for i in range(20)]
    pool = candidates(frame(spark, rows), spark.createDataFrame([(0, "", [1.0])], QUESTION), RankingOptions(keyword_weight=0))
    assert [r.ord for r in pool.orderBy("rank").collect()] == list(range(19, 11, -1))


def test_one_source_may_fill_the_pool(spark):
    rows = [(i, "a", "", "x", [1.0 - i / 100]) for i in range(8)] + [(9, "b", "", "x", [0.1])]
    hits = search(frame(spark, rows), spark.createDataFrame([(0, "", [1.0])], QUESTION))[1]
    assert [r.ord for r in hits.orderBy("rank").collect()] == [0, 1]


def test_ties_go_to_the_earlier_record(spark):
    rows = [(i, f"s{i}", "", "same", [0.5]) for i in range(30)]
    hits = search(frame(spark, rows), spark.createDataFrame([(0, "same", [1.0])], QUESTION), RankingOptions(5, 1))[1]
    assert [r.ord for r in hits.orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_no_keyword_keeps_the_vector_share(spark):
    hits = search(frame(spark, [(0, "s", "", "abc", [1.0])]), spark.createDataFrame([(0, "zzz", [1.0])], QUESTION))[1]
    assert hits.first().score == 0.7


def test_repeated_question_words_count(spark):
    rows = [(0, "s", "", "cache", [0.0]), (1, "s", "", "queue", [0.0])]
    raw = {r.question_id: r.raw for r in KeywordIndex.build(frame(spark, rows)).bm25(spark.createDataFrame([(0, "cache", [1.0]), (1, "cache cache", [1.0])], QUESTION)).collect()}
    assert abs(raw[1] - 2 * raw[0]) < 1e-12


def test_dimension_must_fit_and_empty_questions_give_nothing(spark):
    store = frame(spark, [(0, "s", "", "abc", [1.0, 0.0])])
    with pytest.raises(Exception, match="dimension"):
        candidates(store, spark.createDataFrame([(0, "q", [1.0])], QUESTION)).collect()
    none = candidates(store, spark.createDataFrame([], QUESTION))
    assert none.count() == 0 and "score" in none.columns
    assert candidates(store.where("false"), spark.createDataFrame([(0, "q", [1.0, 0.0])], QUESTION)).count() == 0


def test_select_diverse(spark):
    hits = spark.createDataFrame([(0, i + 1, s, x) for i, (s, x) in enumerate([("a", 0.9), ("a", 0.85), ("a", 0.8), ("b", 0.7), ("c", 0.6)])], "question_id long, rank int, source string, score double")
    assert [(r.source, r.rank) for r in select_diverse(hits, 2, 4).orderBy("rank").collect()] == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    assert [r.source for r in select_diverse(hits, 0, 0).collect()] == ["a"]
