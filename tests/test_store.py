import json

import pytest
from pyspark.sql import functions as F

from strandix.config import ModelConfig, StoreMeta
from strandix.operators import chunks as C
from strandix.operators import embedding as E
from strandix.sources import cache
from strandix.sources import store as S

META = StoreMeta("lmstudio", "test-embedding", 2, 100, 10, "2026-01-01T00:00:00.000Z", 2)
CONFIG = ModelConfig("lmstudio", "test-embedding")


def put(tmp_path, *lines, name="store.ndjson"):
    path = tmp_path / name
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines))
    return f"file://{path}"


def record(**k):
    return {"id": "doc.md#0", "source": "doc.md", "chunkIndex": 0, "heading": "Cache", "content": "cache ttl", "hash": "h", "embedding": [1, 0.5]} | k


def test_broken_records_are_set_apart(spark, tmp_path):
    lines = [{"_meta": META.to_json()}, "{bad json", "", record(id="x", embedding=[1, 2, 3]), {"id": "y", "embedding": [1, 0]}, {k: v for k, v in record().items() if k != "heading"}, "null", "0", '""', "false", {"_meta": {}}]
    meta, store, rejects = S.read_ndjson(spark, put(tmp_path, *lines), CONFIG)
    assert meta == META
    row = store.collect()
    assert [(r.id, r.heading, r.embedding) for r in row] == [("doc.md#0", "", [1.0, 0.5])]
    assert [(r.reason, r.id) for r in rejects.orderBy("ord").collect()] == [("unparseable", None), ("embedding", "x"), ("incomplete", "y"), *[("unparseable", None)] * 4, ("embedding", "unknown")]


@pytest.mark.parametrize("field, value", [("id", 1), ("source", None), ("chunkIndex", "0"), ("content", 5)])
def test_types_are_strict(spark, tmp_path, field, value):
    _, store, rejects = S.read_ndjson(spark, put(tmp_path, {"_meta": META.to_json()}, record(**{field: value})))
    assert store.count() == 0 and rejects.first().reason == "incomplete"


def test_keyword_statistics_are_kept_or_made_anew(spark, tmp_path):
    full = record(keywordHeadingTerms=[["cache", 1]], keywordHeadingTokenCount=1, keywordContentTerms=[["cache", 1], ["ttl", 1]], keywordContentTokenCount=2)
    broken = full | {"id": "b", "keywordContentTerms": [["cache", "one"]], "keywordContentTokenCount": 99}
    _, store, _ = S.read_ndjson(spark, put(tmp_path, {"_meta": META.to_json()}, full, record(id="a"), broken))
    rows = {r.id: r for r in store.collect()}
    assert rows["a"].kw_heading_terms is None and rows["b"].kw_content_terms is None and rows["b"].kw_content_count == 99
    for r in C.complete_keyword_stats(store).collect():
        assert [tuple(t) for t in r.kw_content_terms] == [("cache", 1), ("ttl", 1)] and (r.kw_heading_count, r.kw_content_count) == (1, 2)


@pytest.mark.parametrize("lines, message", [([], "empty"), (["{bad"], "broken"), ([record()], "_meta"), ([{"_meta": META.to_json() | {"model": "other"}}], "ingest again"), ([{"_meta": META.to_json() | {"version": 2}}], "version")])
def test_header_must_fit(spark, tmp_path, lines, message):
    with pytest.raises(ValueError, match=message):
        S.read_ndjson(spark, put(tmp_path, *lines), CONFIG)


@pytest.mark.parametrize("change", [{"dim": 0}, {"chunkOverlap": 100}, {"chunkSize": 1.5}, {"headingWeight": -1}, {"createdAt": "yesterday"}, {"provider": ""}])
def test_header_validation(change):
    with pytest.raises(ValueError):
        StoreMeta.from_json(META.to_json() | change)


def test_ndjson_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"d#{i}", "d", i, "标题", f'text "{i}"\n\\ é', "h", [i / 7, 1.0]) for i in range(20)], "ord long, id string, source string, chunk_index int, heading string, content string, hash string, embedding array<double>").repartition(4)
    rows = C.with_keyword_stats(rows)
    S.write_ndjson(rows, META, f"file://{tmp_path}/out")
    meta, back, rejects = S.read_ndjson(spark, f"file://{tmp_path}/out", CONFIG)
    assert meta == META and rejects.count() == 0
    plain = lambda df: [tuple(r) for r in df.select([c for c in S.COLUMNS if c != "ord"]).orderBy("chunk_index").collect()]
    assert plain(back) == plain(rows)


def test_store_versions_are_swapped(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0])], "ord long, embedding array<double>")
    path = f"file://{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        S.read_store(spark, path)
    S.write_store(rows, META, path)
    _, old = S.read_store(spark, path)
    S.write_store(rows.unionAll(rows), META, path)
    assert old.count() == 1 and S.read_store(spark, path, CONFIG)[1].count() == 2
    with pytest.raises(ValueError):
        S.read_store(spark, path, ModelConfig("lmstudio", "other"))


def test_cache_takes_the_last_sound_entry(spark):
    cache = spark.createDataFrame([(0, "a", [1.0]), (1, "a", [2.0]), (2, None, [3.0]), (3, "b", [float("nan")]), (4, "a", [])], "ord long, hash string, embedding array<double>")
    assert [tuple(r) for r in E.latest(cache).collect()] == [("a", [2.0])]
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "hash string, embedding_text string")
    assert E.hits(chunks, cache).count() == 1 and E.misses(chunks, cache).count() == 2


def test_lines_are_numbered_within_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    big = [f"line {i} " + "x" * 50 for i in range(2000)]
    (tmp_path / "d/b.txt").write_text("\n".join(["", *big[:3], "  ", *big[3:]]))
    (tmp_path / "d/a.txt").write_text("first\n\nsecond\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = S.read_lines(spark, f"file://{tmp_path}/d").withColumn("line", S.line_number(F.col("ord"))).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.value, r.line) for r in rows] == [("first", 1), ("second", 3), *[(x, i + 2) for i, x in enumerate(big[:3])], *[(x, i + 6) for i, x in enumerate(big[3:])]]


def test_rejects_name_their_line(spark, tmp_path):
    said = []
    lines = [{"_meta": META.to_json()}, record(), "{bad", "", record(id="x", embedding=[1])]
    _, _, rejects = S.read_ndjson(spark, put(tmp_path, *lines), CONFIG, said.append)
    assert [(r.reason, r.line) for r in rejects.orderBy("ord").collect()] == [("unparseable", 3), ("embedding", 5)]
    assert said == ["1 records left out: embedding (line 5 first)", "1 records left out: unparseable (line 3 first)"]


def test_json_lines_are_replaced_whole_or_not_at_all(spark, tmp_path):
    rows = C.with_keyword_stats(spark.createDataFrame([(0, "d#0", "d", 0, "", "text", "h", [1.0, 0.5])], "ord long, id string, source string, chunk_index int, heading string, content string, hash string, embedding array<double>"))
    path = f"file://{tmp_path}/out"
    S.write_ndjson(rows, META, path)
    with pytest.raises(Exception, match="broken on purpose"):
        S.write_ndjson(rows.withColumn("content", F.raise_error(F.lit("broken on purpose")).cast("string")), META, path)
    assert S.read_ndjson(spark, path, CONFIG)[1].count() == 1
    S.write_ndjson(rows.unionAll(rows), META, path)
    assert S.read_ndjson(spark, path, CONFIG)[1].count() == 2 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_parsed_stores_are_kept_until_their_source_changes(spark, tmp_path, monkeypatch):
    path, folder = put(tmp_path, {"_meta": META.to_json()}, record(), "{bad"), f"file://{tmp_path}/kept"
    said = []
    assert cache.read_cached(spark, path, folder, CONFIG, said.append)[1].count() == 1 and len(said) == 1
    monkeypatch.setattr(cache, "read_ndjson", lambda *a: 1 / 0)
    meta, rows = cache.read_cached(spark, path, folder, CONFIG)
    assert meta == META and [r.id for r in rows.collect()] == ["doc.md#0"]
    with pytest.raises(ValueError, match="ingest again"):
        cache.read_cached(spark, path, folder, ModelConfig("lmstudio", "other"))
    monkeypatch.undo()
    put(tmp_path, {"_meta": META.to_json()}, record(), record(id="two"))
    assert cache.read_cached(spark, path, folder, CONFIG)[1].count() == 2
    (tmp_path / "kept/note.txt").write_text("mine")
    assert len([p for p in (tmp_path / "kept").iterdir() if p.name[:1] != "."]) == 3
    assert cache.clear_cache(spark, folder) == 2 and [p.name for p in (tmp_path / "kept").iterdir() if p.name[:1] != "."] == ["note.txt"]
    assert cache.clear_cache(spark, f"file://{tmp_path}/none") == 0
    with pytest.raises(FileNotFoundError):
        cache.read_cached(spark, f"file://{tmp_path}/none", folder)
