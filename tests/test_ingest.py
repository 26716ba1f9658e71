import hashlib
import json

import pytest
import xxhash
from pyspark.sql import functions as F

from strandix.config import IngestOptions, ModelConfig
from strandix.operators.chunks import build_chunks, fingerprint
from strandix.operators.ingest import ingest, record_order
from strandix.providers import hashed_embedder
from strandix.sources import documents as D
from strandix.sources.store import read_store
from strandix.streaming import flows

CONFIG = ModelConfig("lmstudio", "test-embedding")
DOCS = "source string, content string, doc_ord long"


def docs(spark, *rows):
    return spark.createDataFrame([(s, c, i) for i, (s, c) in enumerate(rows)], DOCS)


def test_chunk_records(spark):
    rows = build_chunks(docs(spark, ("a.md", "# T\n\none\n\ntwo"), ("b.md", "x" * 25)), IngestOptions(20, 5, 2)).orderBy("doc_ord", "chunk_index").collect()
    assert [(r.id, r.heading, r.content) for r in rows] == [("a.md#0", "T", "one\n\ntwo"), ("b.md#0", "", "x" * 20), ("b.md#1", "", "x" * 10)]
    assert rows[0].embedding_text == "T\nT\none\n\ntwo" and rows[0].kw_content_count == 2 and rows[0].kw_heading_count == 1


def test_custom_chunker(spark):
    cut = lambda d, o: [{"content": f"{d['source']}:{o['chunk_size']}"}, {"content": "two", "heading": "h"}]
    rows = build_chunks(docs(spark, ("a", "zzz")), IngestOptions(), cut).orderBy("chunk_index").collect()
    assert [(r.heading, r.content) for r in rows] == [("", "a:600"), ("h", "two")]


def test_ingest_skips_what_has_not_changed(spark, tmp_path):
    path, told = f"file://{tmp_path}/store", []
    d = docs(spark, ("a.md", "alpha"), ("b.md", "beta"), ("c.md", "alpha"))
    first = ingest(d, path, CONFIG, hashed_embedder(8), progress=lambda s, f: told.append(s))
    assert (first.documents, first.chunks, first.cached, first.embedded, first.skipped) == (3, 3, 0, 3, None) and told == ["documents", "chunks", "cache", "written"]
    assert ingest(d, path, CONFIG, hashed_embedder(8)).skipped == "unchanged"
    more = ingest(docs(spark, ("a.md", "alpha"), ("b.md", "gamma")), path, CONFIG, hashed_embedder(8))
    assert (more.cached, more.embedded, more.skipped) == (1, 1, None)
    meta, rows = read_store(spark, path, CONFIG)
    assert meta.dim == 8 and [r.id for r in rows.orderBy("ord").collect()] == ["a.md#0", "b.md#0"] and "embedding_text" not in rows.columns
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in rows.collect())


def test_nothing_is_written_for_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert ingest(docs(spark, ("a", "x")).where("false"), path, CONFIG, hashed_embedder()).skipped == "no-docs"
    assert ingest(docs(spark, ("a", " \n ")), path, CONFIG, hashed_embedder()).skipped == "no-chunks"
    with pytest.raises(Exception, match="vectors for"):
        ingest(docs(spark, ("a", "x")), path, CONFIG, lambda texts: [])
    with pytest.raises(FileNotFoundError):
        read_store(spark, path)


def test_fingerprint_follows_settings_order_and_content(spark):
    mark = lambda d, o=IngestOptions(), m="m": fingerprint(build_chunks(d, o), o, "p", m).first().fingerprint  # noqa: E731, B008
    a, b = ("a", "one"), ("b", "two")
    marks = [mark(docs(spark, a, b)), mark(docs(spark, b, a)), mark(docs(spark, a, ("b", "2"))), mark(docs(spark, a, b), IngestOptions(500)), mark(docs(spark, a, b), m="n")]
    assert len(set(marks)) == 5 and mark(docs(spark, a, b).repartition(3)) == marks[0]


def brute_fingerprint(rows, options, provider, model):
    """What ``fingerprint`` computes, over all chunks in one place."""
    signed = lambda x: x - 2**64 if x >> 63 else x

    def terms(ts):
        h = 42
        for t in ts:
            h = xxhash.xxh64_intdigest(t["term"].encode(), h)
            h = xxhash.xxh64_intdigest(t["count"].to_bytes(4, "little", signed=True), h)
        return signed(h)

    docs = {}
    for r in rows:
        one = {k: r[k] for k in ("id", "source", "chunk_index", "hash", "kw_heading_count", "kw_content_count")}
        line = "|".join([json.dumps(one, separators=(",", ":"), ensure_ascii=False), str(terms(r["kw_heading_terms"])), str(terms(r["kw_content_terms"]))])
        docs.setdefault(r["doc_ord"], []).append(hashlib.sha1(line.encode()).hexdigest())
    n, total, prime = 0, 0, 2**521 - 1
    for _, digests in sorted(docs.items()):
        lanes = []
        for i in range(3):
            x = 0
            for d in digests:
                x ^= xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(d.encode(), 42))
            lanes.append(str(signed(x)))
        whole = hashlib.sha1(",".join([str(len(digests)), *lanes]).encode()).hexdigest()
        n, total = n + 1, (total * 0x9E3779B97F4A7C15F39CC0605CEDC835 + int(whole, 16)) % prime
    head = f"2|1|{provider}|{model}|{options.chunk_size}|{options.chunk_overlap}|{options.heading_weight:g}\n"
    return hashlib.sha1(f"{head}{n}:{total}".encode()).hexdigest()


def test_fingerprint_against_brute_force(spark):
    rows = [(f"s{i % 3}", "# T\n\n" + f"wörd{i} 中文字 the the " * (i * 7 % 40), i) for i in range(25)]
    chunks = build_chunks(spark.createDataFrame(rows, DOCS).repartition(4), IngestOptions(60, 5))
    got = fingerprint(chunks, IngestOptions(60, 5), "p", "m").first().fingerprint
    assert got == brute_fingerprint(chunks.collect(), IngestOptions(60, 5), "p", "m")


def test_record_order_fits_any_partition_and_refuses_what_does_not(spark):
    top = (1 << 39) - 1
    rows = spark.createDataFrame([(0, 0), (0, (1 << 24) - 1), (1, 0), (32767 << 24, 5), (top, 7)], "d long, i int")
    got = [r[0] for r in rows.select(record_order(F.col("d"), F.col("i"))).collect()]
    assert got == sorted(set(got))
    for bad in ((top + 1, 0), (0, 1 << 24), (-1, 0)):
        with pytest.raises(Exception, match="doc_ord"):
            spark.createDataFrame([bad], "d long, i int").select(record_order(F.col("d"), F.col("i"))).collect()


def test_load_documents(spark, tmp_path):
    for name in ("z.md", "a/a.md", "a/b.MD", "b/a.txt", "skip.json", ".md", "a b+%20.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(f"text of {name}".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xef\xbb\xbfok \xff")
    got = [(r.source, r.content) for r in D.load_documents(spark, f"file://{tmp_path}").orderBy("doc_ord").collect()]
    assert [s for s, _ in got] == ["a/a.md", "a/b.MD", "a b+%20.md", "b/a.txt", "bad.txt", "z.md"] and dict(got)["bad.txt"] == "﻿ok �"
    some = D.load_documents(spark, f"file://{tmp_path}", ["md"], str(tmp_path.parent), [f"{tmp_path.name}/z.md"], F.col("content").contains("a/"))
    assert [r.source for r in some.orderBy("doc_ord").collect()] == [f"{tmp_path.name}/a/a.md", f"{tmp_path.name}/a/b.MD"]
    asked = D.load_documents(spark, f"file://{tmp_path}", ["md"], keep=lambda d: "a/" in d["content"] and d["source"].endswith("MD"))
    assert [r.source for r in asked.collect()] == ["a/b.MD"]


def test_streamed_ingest_keeps_each_sources_last_version(spark, tmp_path):
    at = f"file://{tmp_path}"
    stream = lambda: flows.ingest_stream(spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), f"{at}/out", f"{at}/ck").awaitTermination()
    docs(spark, ("a", "old " * 300), ("b", "keep")).coalesce(1).write.parquet(f"{at}/in")
    stream()
    docs(spark, ("a", "new")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream()
    assert sorted((r.source, r.content) for r in flows.current(spark.read.parquet(f"{at}/out")).collect()) == [("a", "new"), ("b", "keep")]
