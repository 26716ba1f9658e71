import random

import duckdb
import pytest

from strandix.llm import mixing


def test_epochs_then_least_keys(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 30), "big" if i < 300 else "small" if i < 320 else None, i) for i in range(330)]
    rows += [(5, "again x", "big", 0), (400, None, "big", 0), (401, "", "empty", 0), (None, "one two", "big", 0), (402, "v " * 40000, "long", 1)]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 200, 3)] + [(3, 1, None), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.sample(docs, marks).collect()
    assert len(got) == len(rows)
    total = sum(r.n_tokens for r in got)
    assert total == sum(len((t or "").split()) for _, t, *_ in rows)
    sources = {r.source for r in got}
    tokens = {s: sum(r.n_tokens for r in got if r.source == s) for s in sources}
    share = {s: round(tokens[s] ** 0.5 * 1000) for s in sources}
    for s in sources:
        if not tokens[s]:
            assert all(r.copies == 1 for r in got if r.source == s)
            continue
        budget = int(total * share[s] / sum(share.values()))
        epochs, rest = divmod(budget, tokens[s])
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0))
        for r in mine:
            upto = sum(x.n_tokens for x in mine if (x.key, x.doc_id is not None, x.doc_id or 0) <= (r.key, r.doc_id is not None, r.doc_id or 0))
            assert r.copies == epochs + (upto <= rest), (s, r)
        assert sum(r.n_tokens * r.copies for r in mine) <= budget
    mixed = mixing.mix(docs, marks)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.sample(docs.where("false"), marks).count() == 0 and mixing.sample(docs, marks.where("false")).count() == len(rows)


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "a b c d", "x" if i < 2000 else "y") for i in range(2100)]
    marks = [(i, i % 2, 0) for i in range(2100)]
    got = mixing.sample(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).where("source = 'x'").collect()
    good, bad = (sum(r.copies for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.2 * bad > 0


def test_given_target_weights(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", None, "left out"])) for i in range(600)]
    marks = [(i, i % 2, int(i % 9 == 0)) for i in range(0, 600, 2)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    targets = {"a": 0.2, "b": 0.5, None: 0.3, "absent": 9.0}
    got = mixing.sample(docs, labels, 1.5, targets=targets).collect()
    assert all(r.copies == 0 for r in got if r.source == "left out") and len(got) == 600
    total = 1.5 * sum(r.n_tokens for r in got if r.source != "left out")
    for s, w in (("a", 0.2), ("b", 0.5), (None, 0.3)):
        taken = sum(r.n_tokens * r.copies for r in got if r.source == s)
        assert total * w - 40 <= taken <= total * w
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.execute(mixing.sql(1.5, targets)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert sorted(r.doc_id for r in mixing.mix(docs, labels, 1.5, targets=targets).collect()) == sorted(r.doc_id for r in got for _ in range(r.copies))
    for bad in ({"a": -1.0}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            mixing.sample(docs, labels, targets=bad)


def test_columns_of_any_name_stay_and_many_labels_need_no_broadcast(spark, monkeypatch):
    names = ["_mix_id", "_mix_copies", "_key", "_bucket", "of_source", "budget", "epochs", "cut_id", "_copy", "weight", "_0"]
    docs = spark.createDataFrame([(i, "some words here", "s", *range(11)) for i in range(9)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels)
    assert got.columns == docs.columns and got.count() == 9 and tuple(got.first())[1:] == ("some words here", "s", *range(11))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, mixing.mix(docs, labels, 0.5).collect())) == sorted(map(tuple, mixing.mix(docs, labels, 0.5).collect())) and mixing.mix(docs, labels, 0.5).count() == 4
