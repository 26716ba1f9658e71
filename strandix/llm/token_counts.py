"""Operator 1, token counts: a separator scan over flat, unindexed token files.

``write_token_files`` makes such files (uint16 ids, an end-of-document id after each text) and ``scan_token_files`` counts the tokens of each
document in any such files. A file is cut into blocks of a fixed number of bytes wherever they fall; each block is searched for the
separator with one vectorised comparison, and a prefix scan over the small per-block summaries (separators before the block, tokens since the
last separator) stitches the documents that cross blocks. Blocks are independent tasks, so one huge file scans as widely as many small ones,
and what is shuffled is the separators' positions only.

Cases: an empty or null text is a document of 0 tokens; ids after a file's last separator are a last document with terminated = false; an
empty file has no documents; repeated rows are documents of their own; columns other than doc_id and text are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandix.llm import bpe
from strandix.llm.common import cut, discard, filesystem, scratch, table

BLOCK_BYTES = 4 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer: str = bpe.TOKENIZER) -> DataFrame:
    """One flat file per task under `path`/files, and their manifest (file, n_bytes, doc_ids in order), written as a table.

    A file's name is unique to the attempt that writes it and only the manifest of committed tasks names it, so files of lost or
    repeated attempts are never read.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = bpe.encoder(tokenizer), np.array([bpe.END_OF_DOCUMENT], "<u2").tobytes()
        files, root = filesystem(f"{path}/files")
        files.create_dir(root, recursive=True)
        name, ids, size = f"{uuid.uuid4().hex}.bin", [], 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                ids += batch.column(0).to_pylist()
                for text in batch.column(1):
                    size += out.write(encode(text.as_py()) + end)
        if ids:
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/files/{name}"], "n_bytes": [size], "doc_ids": [ids]}, schema=pa.schema([("file", pa.string()), ("n_bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]))
        else:
            files.delete_file(f"{root}/{name}")

    manifest = f"{path}/manifest"
    docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(write, "file string, n_bytes bigint, doc_ids array<bigint>").write.parquet(manifest)
    return spark.read.parquet(manifest)


def scan_token_files(files: DataFrame, end: int = bpe.END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """files(file, n_bytes) to (file, ordinal, first_token, n_tokens, terminated), one row per document."""
    if block_bytes % 2:
        raise ValueError("a block holds whole uint16 ids")
    blocks = files.select("file", F.col("n_bytes").cast("bigint").alias("n_bytes")).where("n_bytes > 1").withColumn("block", F.explode(F.expr(f"sequence(0L, (n_bytes - 1) div {block_bytes}L)")))
    spread = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, at = filesystem(row["file"])
                start = row["block"] * block_bytes
                with files.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, row["n_bytes"] - start) // 2 * 2, start), "<u2")
                found = np.flatnonzero(ids == end).astype(np.int64) + start // 2
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]]), pa.array([row["n_bytes"] // 2]), pa.array([found], pa.list_(pa.int64()))], ["file", "block", "n_ids", "found"])

    searched = cut(blocks.repartition(spread, "file", "block").mapInArrow(search, "file string, block bigint, n_ids bigint, found array<bigint>"))
    # The prefix scan sees two numbers for each block; the positions meet its result again by block, so a file's separators are never in one place.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = searched.select("file", "block", F.size("found").alias("n_found"), F.expr("try_element_at(found, -1)").alias("last_found")).select(
        "file",
        "block",
        F.coalesce(F.sum("n_found").over(before), F.lit(0)).alias("documents_before"),
        F.coalesce(F.max("last_found").over(before), F.lit(-1)).alias("last_before"),
        (F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()).alias("is_last"),
    )
    stitched = searched.join(scanned, ["file", "block"])
    stitched = stitched.select(
        "file", "documents_before", "last_before", "found", F.expr("CASE WHEN is_last AND coalesce(try_element_at(found, -1), last_before) + 1 < n_ids THEN concat(found, array(n_ids)) ELSE found END").alias("cuts")
    )
    return stitched.select("file", "documents_before", "last_before", "cuts", F.size("found").alias("n_found"), F.posexplode("cuts").alias("i", "at")).select(
        "file",
        (F.col("documents_before") + F.col("i")).alias("ordinal"),
        (F.expr("CASE WHEN i = 0 THEN last_before ELSE cuts[i - 1] END") + 1).alias("first_token"),
        (F.col("at") - F.expr("CASE WHEN i = 0 THEN last_before ELSE cuts[i - 1] END") - 1).alias("n_tokens"),
        (F.col("i") < F.col("n_found")).alias("terminated"),
    )


def token_counts(docs: DataFrame, tokenizer: str = bpe.TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) for every row: the texts are written as flat token files, those are scanned, and ordinals lead back to doc_ids."""
    path = scratch(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, path, tokenizer)
    scanned = scan_token_files(manifest, block_bytes=block_bytes)
    # What was found in them is written by now; the manifest is read on.
    discard(f"{path}/files")
    ids = manifest.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    # Both sides grow with the documents, and the manifest's small files hide it: never by broadcast.
    return scanned.join(ids.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
