"""The vector store: Parquet as its own form, newline-delimited JSON for exchange."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandix.config import ModelConfig, StoreMeta
from strandix.functions import kernels as K
from strandix.functions.text import arrow
from strandix.functions.vectors import is_valid

TERMS = "array<struct<term:string,count:int>>"
COLUMNS = ["ord", "id", "source", "chunk_index", "heading", "content", "hash", "kw_heading_terms", "kw_heading_count", "kw_content_terms", "kw_content_count", "embedding"]


def record_lines(store: DataFrame) -> DataFrame:
    """(ord, value): a JSON line for each record. Absent statistics are left out."""
    base = F.to_json(F.struct("id", "source", F.col("chunk_index").alias("chunkIndex"), "heading", "content", "hash", "embedding", F.col("kw_heading_count").alias("keywordHeadingTokenCount"), F.col("kw_content_count").alias("keywordContentTokenCount")))
    pairs = arrow(K.pairs, "string")
    extra = [F.coalesce(F.concat(F.lit(f',"{n}":'), pairs(F.col(c))), F.lit("")) for c, n in (("kw_heading_terms", "keywordHeadingTerms"), ("kw_content_terms", "keywordContentTerms"))]
    return store.select("ord", F.concat(F.substring(base, F.lit(1), F.length(base) - 1), *extra, F.lit("}")).alias("value"))


def write_ndjson(store: DataFrame, meta: StoreMeta, path: str) -> None:
    """A folder of text parts in record order, the first beginning with the header.

    It is written beside `path` and moved there once whole. A folder that was there is moved aside before, back if the move fails, and deleted after.
    """
    spark = store.sparkSession
    head = spark.createDataFrame([(-1, json.dumps({"_meta": meta.to_json()}, ensure_ascii=False))], "ord long, value string")
    lines = head.unionAll(record_lines(store).select(F.col("ord").cast("bigint"), "value"))
    mark = uuid.uuid4().hex
    fs, final, Path = _hadoop(spark, path.rstrip("/"))
    new, old = Path(f"{path.rstrip('/')}.{mark}.tmp"), Path(f"{path.rstrip('/')}.{mark}.old")
    try:
        lines.orderBy("ord").select("value").write.text(str(new.toString()))
        there = fs.exists(final)
        if there and not fs.rename(final, old):
            raise OSError(f"{path} can't be moved aside")
        if not fs.rename(new, final):
            if there:
                fs.rename(old, final)
            raise OSError(f"{path} can't be written")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)


#: Bits of a line's number within its file, in ord.
LINE_BITS = 40


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of the non-blank lines, in the order of files by name and of lines within them: ord is the file's place, then the line's number from 0.

    Lines are numbered within the splits they are read from, and the splits by the number of lines before them: nothing but a row for each split is exchanged.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    splits = rows.groupBy("f", "b").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("f").orderBy("b")) - F.col("n")
    # One row for each split; their numbering is the only thing that meets in one place.
    place = splits.select(F.col("f").alias("f2"), F.col("b").alias("b2"), "first", before.alias("before")).join(splits.select(F.col("f").alias("f2")).distinct().withColumn("file", F.row_number().over(Window.orderBy("f2")) - 1), "f2")
    joined = rows.join(F.broadcast(place), (F.col("f") == F.col("f2")) & (F.col("b") == F.col("b2")))
    return joined.where(F.trim("value") != "").select(F.shiftleft(F.col("file").cast("bigint"), LINE_BITS).bitwiseOR(F.col("before") + F.col("i") - F.col("first")).alias("ord"), "value")


def line_number(ord_: Column) -> Column:
    """The line's number within its file, from 1."""
    return ord_.bitwiseAND(F.lit((1 << LINE_BITS) - 1)) + 1


def _typed(v: Column, path: str, kind: str, names: tuple[str, ...]) -> Column:
    part = F.try_variant_get(v, path, "variant")
    return F.when(F.regexp_extract(F.schema_of_variant(part), r"^[A-Z]+", 0).isin(*names), F.try_variant_get(v, path, kind))


_TEXT = ("STRING",)
_NUMBER = ("BIGINT", "DOUBLE", "DECIMAL", "INT", "SMALLINT", "TINYINT", "FLOAT")


def _terms(v: Column, path: str) -> Column:
    return arrow(K.unpaired, TERMS)(F.try_variant_get(v, path, "string"))


def parse_records(lines: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """lines(ord, value) without the header to (store, rejects(ord, reason, id))."""
    v = F.col("v")
    rows = lines.withColumn("v", F.try_parse_json("value"))
    # Literals that are no records count as unparseable, like broken lines.
    record = F.ltrim("value").startswith("{")
    broken = v.isNull() | (~record & F.coalesce(F.try_variant_get(v, "$", "string").isin("0", "", "false", "0.0"), F.lit(True)))
    numbers = F.regexp_like(F.schema_of_variant(F.try_variant_get(v, "$.embedding", "variant")), F.lit(r"^ARRAY<(BIGINT|DOUBLE|DECIMAL\(.*\)|FLOAT)>$"))
    fields = {
        "id": _typed(v, "$.id", "string", _TEXT),
        "source": _typed(v, "$.source", "string", _TEXT),
        "chunk_index": _typed(v, "$.chunkIndex", "int", _NUMBER),
        "heading": F.coalesce(_typed(v, "$.heading", "string", _TEXT), F.lit("")),
        "content": _typed(v, "$.content", "string", _TEXT),
        "hash": _typed(v, "$.hash", "string", _TEXT),
        "kw_heading_terms": _terms(v, "$.keywordHeadingTerms"),
        "kw_heading_count": _typed(v, "$.keywordHeadingTokenCount", "int", _NUMBER),
        "kw_content_terms": _terms(v, "$.keywordContentTerms"),
        "kw_content_count": _typed(v, "$.keywordContentTokenCount", "int", _NUMBER),
        "embedding": F.when(numbers, F.try_variant_get(v, "$.embedding", "array<double>")),
    }
    rows = rows.select("ord", broken.alias("broken"), F.coalesce(F.try_variant_get(v, "$.id", "string"), F.lit("unknown")).alias("shown"), *[c.alias(n) for n, c in fields.items()])
    complete = F.col("id").isNotNull() & F.col("source").isNotNull() & F.col("chunk_index").isNotNull() & F.col("content").isNotNull()
    reason = F.when(F.coalesce("broken", F.lit(True)), "unparseable").when(~is_valid(F.col("embedding"), dim), "embedding").when(~complete, "incomplete")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").select(*COLUMNS), rows.where("reason IS NOT NULL").select("ord", "reason", F.when(F.col("reason") == "unparseable", F.lit(None).cast("string")).otherwise(F.col("shown")).alias("id"))


def _head(spark: SparkSession, path: str) -> tuple[str, int, int] | None:
    """The first non-blank line, the place of its file and its number there: read from the beginning of the first file that has one, whatever there is after it."""
    fs, at, Path = _hadoop(spark, path)
    files = [at] if fs.getFileStatus(at).isFile() else [x.getPath() for x in fs.listStatus(at) if x.isFile() and x.getLen() and x.getPath().getName()[:1] not in "._"]
    for k, file in enumerate(sorted(files, key=lambda x: x.getName())):
        stream = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(fs.open(file), "UTF-8"))
        try:
            number = 0
            while (line := stream.readLine()) is not None:
                if line.strip(" "):
                    return line, k, number
                number += 1
        finally:
            stream.close()
    return None


def read_meta(spark: SparkSession, path: str, config: ModelConfig | None = None) -> StoreMeta:
    first = _head(spark, path)
    if first is None:
        raise ValueError("the store is empty")
    try:
        value = json.loads(first[0])
    except ValueError:
        raise ValueError("the store's first line is broken") from None
    if not isinstance(value, dict) or not isinstance(value.get("_meta"), dict):
        raise ValueError("the store has no _meta header")
    return StoreMeta.from_json(value["_meta"], config)


def read_ndjson(spark: SparkSession, path: str, config: ModelConfig | None = None, on_warning: Callable[[str], None] | None = None) -> tuple[StoreMeta, DataFrame, DataFrame]:
    """(meta, store, rejects(ord, reason, id, line)). A broken or foreign header fails; broken records go to rejects, of which `on_warning` is told the number by reason."""
    meta = read_meta(spark, path, config)
    _, file, number = _head(spark, path)
    store, rejects = parse_records(read_lines(spark, path).where(F.col("ord") > (file << LINE_BITS | number)), meta.dim)
    rejects = rejects.withColumn("line", line_number(F.col("ord")))
    if on_warning:
        for r in rejects.groupBy("reason").agg(F.count("*").alias("n"), F.min("line").alias("line")).orderBy("reason").collect():
            on_warning(f"{r.n} records left out: {r.reason} (line {r.line} first)")
    return meta, store, rejects


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside and moved over the old one by one rename: at no time is there none."""
    fs, final, Path = _hadoop(spark, path)
    temp = Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop, gateway = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    how = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temp, final, how)


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, at, _ = _hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_store(store: DataFrame, meta: StoreMeta, path: str) -> None:
    """A new version folder of Parquet, then the pointer file is swapped: readers see the old version or the new one."""
    version = f"v-{uuid.uuid4().hex}"
    store.write.parquet(f"{path}/{version}")
    put_text(store.sparkSession, f"{path}/current.json", json.dumps({"version": version, "_meta": meta.to_json()}))


def read_store(spark: SparkSession, path: str, config: ModelConfig | None = None) -> tuple[StoreMeta, DataFrame]:
    text = get_text(spark, f"{path}/current.json")
    if text is None:
        raise FileNotFoundError(f"no vector store at {path}")
    head = json.loads(text)
    return StoreMeta.from_json(head["_meta"], config), spark.read.parquet(f"{path}/{head['version']}")
