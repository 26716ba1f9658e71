"""Every query with SQL against DuckDB, and what holds when the optional parts are gone."""

import math
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from strandix import catalog

ROOT = pathlib.Path(__file__).resolve().parent.parent
DATA = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got or name == "embedding_cache_misses"  # every text of the smallest tables has a vector
    if name in catalog.SQL:
        cursor = duck.execute(catalog.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


def test_embedding_text_hash_takes_texts_as_they_are(spark, tmp_path):
    c = duckdb.connect()
    ends = "('\t'), (chr(8232)), (chr(8239)), (chr(65279)), (chr(11)), (''), (NULL), ('x')"
    c.execute(f"CREATE TABLE e AS SELECT * FROM (VALUES {ends}) t(e)")
    c.execute("CREATE TABLE documents AS SELECT row_number() OVER () AS doc_id, a.e || 'one' || chr(10) || 'two' || b.e AS text, l.e AS lang FROM e a, e b, e l")
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = catalog.QUERIES["embedding_text_hash"](spark, str(tmp_path)).select("doc_id", "hash", "plain", "n").collect()
    assert {tuple(r) for r in got} == {*c.execute(catalog.SQL["embedding_text_hash"]).fetchall()} and len(got) == 512


def test_entry(spark):
    assert entry.entry(spark).count() == 4 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_works_alone(tmp_path, pipeline):
    for x in ("__spark_entry__.py", "strandix", *(["corpus_pipeline.py"] if pipeline else [])):
        if (ROOT / x).exists():
            (shutil.copytree if (ROOT / x).is_dir() else shutil.copy)(ROOT / x, tmp_path / x)
    shutil.rmtree(tmp_path / "strandix/llm", ignore_errors=True)
    run = "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'))"
    out = subprocess.run([sys.executable, "-B", "-c", run], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.split(maxsplit=1) == [str(len(catalog.QUERIES)), "[]\n"]
