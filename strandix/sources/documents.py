"""Text files as documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandix.config import normalize_extensions


def extension(path: Column) -> Column:
    """Lower case, with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def portable(path: Column, root: str) -> Column:
    """Path relative to root with forward slashes; the file's own name where both are the same, steps up where it lies outside."""
    path, root = F.regexp_replace(path, r"\\\\", "/"), root.replace("\\", "/").rstrip("/")
    parts = [p for p in root.split("/") if p]
    out = F.when(path == root, F.element_at(F.split(path, "/"), -1))
    for n in range(len(parts), -1, -1):
        base = "/" + "".join(f"{p}/" for p in parts[:n])
        out = out.when(path.startswith(base), F.concat(F.lit("../" * (len(parts) - n)), F.substring(path, len(base) + 1, 1 << 30)))
    return out.otherwise(path)


def source_order(source: Column) -> Column:
    """Sorts like a walk that orders the entries of each directory by name, without regard to case first."""
    return F.transform(F.split(source, "/"), lambda x: F.collate(x, "UNICODE"))


@F.pandas_udf(StringType())
def _decode(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


#: Bits of a document's place within its partition of the sorted names, in doc_ord.
PLACE_BITS = 24


def excluded(rows: DataFrame, sources: Iterable[str]) -> DataFrame:
    """The rows whose source isn't among these; their separators may be backslashes."""
    gone = [x.replace("\\", "/") for x in sources]
    return rows.where(~F.col("source").isin(gone)) if gone else rows


def load_documents(spark: SparkSession, folder: str, extensions: Iterable[str] | None = None, source_root: str | None = None, exclude: Iterable[str] = (), keep: Column | Callable[[dict], bool] | None = None) -> DataFrame:
    """(source, content, doc_ord) of the text files below a folder. Files are dropped by name before they are read; malformed UTF-8 is replaced.

    ``keep`` is a Column, or a function of {source, content}, which is called in batches of an Arrow-fed function.
    """
    wanted = normalize_extensions(extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/+", "/")
    rows = files.select(portable(path, (source_root or folder).removeprefix("file://")).alias("source"), "content").where(extension(F.col("source")).isin(wanted))
    rows = excluded(rows, exclude).select("source", _decode("content").alias("content"))
    if callable(keep):

        @F.pandas_udf("boolean")
        def kept(sources: pd.Series, contents: pd.Series) -> pd.Series:
            return pd.Series([bool(keep({"source": s, "content": c})) for s, c in zip(sources, contents)], dtype=bool)

        rows = rows.where(kept("source", "content"))
    elif keep is not None:
        rows = rows.where(keep)
    # Names only are sorted, in a distributed sort: partition and place are the order. It isn't dense, and has 39 bits, so that a chunk's index fits below it.
    names = rows.select("source").orderBy(source_order(F.col("source"))).withColumn("m", F.monotonically_increasing_id())
    partition, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    fits = (partition < 1 << 15) & (place < 1 << PLACE_BITS)
    doc_ord = F.when(fits, F.shiftleft(partition, PLACE_BITS).bitwiseOR(place)).otherwise(F.raise_error(F.lit("too many documents in one folder")).cast("bigint"))
    return rows.join(names.select("source", doc_ord.alias("doc_ord")), "source").select("source", "content", "doc_ord")
