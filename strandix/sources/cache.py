"""Parsed stores kept as Parquet, so that newline-delimited JSON is parsed once. An entry holds as long as its source's files do."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandix.config import ModelConfig, StoreMeta
from strandix.sources.store import _hadoop, get_text, put_text, read_ndjson

_ENTRY = re.compile(r"[a-f0-9]{16}\.(?:manifest\.json(?:\.[a-f0-9]+\.tmp)?|records\.[a-f0-9]{32})")


def _state(spark: SparkSession, path: str) -> dict:
    """What tells one version of the source's files from another."""
    fs, at, _ = _hadoop(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(f"no vector store at {path}")
    files = [fs.getFileStatus(at)] if fs.getFileStatus(at).isFile() else [x for x in fs.listStatus(at) if x.isFile()]
    return {"path": fs.makeQualified(at).toString(), "files": len(files), "size": sum(x.getLen() for x in files), "mtime": max((x.getModificationTime() for x in files), default=0)}


def _key(path: str) -> str:
    return hashlib.sha1(path.encode()).hexdigest()[:16]


def read_cached(spark: SparkSession, path: str, folder: str, config: ModelConfig | None = None, on_warning: Callable[[str], None] | None = None) -> tuple[StoreMeta, DataFrame]:
    """The store at `path`, from its entry in `folder` if that is of the files as they are now, else parsed and entered. Broken records are left out of both."""
    state = _state(spark, path)
    manifest = f"{folder.rstrip('/')}/{_key(state['path'])}.manifest.json"
    try:
        known = json.loads(get_text(spark, manifest) or "{}")
    except ValueError:
        known = {}
    if known.get("version") == 1 and known.get("source") == state:
        meta = StoreMeta.from_json(known["_meta"], config)
        fs, at, _ = _hadoop(spark, f"{folder.rstrip('/')}/{known['records']}")
        if fs.exists(at):
            rows = spark.read.parquet(f"{folder.rstrip('/')}/{known['records']}")
            if rows.count() == known["count"]:
                return meta, rows
    meta, rows, _ = read_ndjson(spark, path, config, on_warning)
    records = f"{_key(state['path'])}.records.{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder.rstrip('/')}/{records}")
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{records}")
    put_text(spark, manifest, json.dumps({"version": 1, "source": state, "_meta": meta.to_json(), "records": records, "count": rows.count()}))
    if known.get("records") and _ENTRY.fullmatch(known["records"]):
        fs, at, _ = _hadoop(spark, f"{folder.rstrip('/')}/{known['records']}")
        fs.delete(at, True)
    return meta, rows


def clear_cache(spark: SparkSession, folder: str) -> int:
    """Deletes all entries in the folder, of whatever store, and nothing else; the number of files and tables deleted. A missing folder is no error."""
    fs, at, _ = _hadoop(spark, folder)
    if not fs.exists(at):
        return 0
    gone = [x.getPath() for x in fs.listStatus(at) if _ENTRY.fullmatch(x.getPath().getName())]
    for x in gone:
        fs.delete(x, True)
    return len(gone)
