"""Operator 7, token-ID output: one zstandard frame per document, a trailing seek table, a checksum per frame.

Each shard is a file in the public seekable zstandard layout: independent frames, then a skippable frame with, for each, its
compressed size, its decompressed size and the low 32 bits of the XXH64 of its content, then a footer. A reader takes the footer, the table and
the frames it wants by byte ranges; nothing else is read or decompressed. Frames hold uint16 token ids.

Tasks write files under names of their own attempt; the manifest, which is a table written by Spark's committer, names the files of committed tasks
only, so lost executors and repeated tasks change nothing.

Cases: a null or empty text has a frame of no ids; repeated rows have a frame each; a null doc_id is kept; an empty table gives no shards;
other columns are ignored. A text longer than a shard's size has a shard to itself, whole.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm import bpe
from strandix.llm.common import filesystem, scratch, table

SHARD_BYTES = 8 << 20
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SCHEMA = "file string, n_docs int, n_tokens bigint, n_bytes bigint, doc_ids array<bigint>"


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """Skippable frame with (compressed size, decompressed size, checksum) of each frame."""
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_table(data: bytes, size: int | None = None) -> np.ndarray:
    """Entries of the seek table, with the frames' offsets as column 0. data: a shard, or its end where the shard's size is given."""
    size = len(data) if size is None else size
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEKABLE or flags != 0x80 or len(data) < 17 + 12 * n:
        raise ValueError("no seek table")
    entries = np.frombuffer(data, "<u4", 3 * n, len(data) - 9 - 12 * n).reshape(n, 3).astype(np.int64)
    if struct.unpack("<II", data[len(data) - 17 - 12 * n : len(data) - 9 - 12 * n]) != (_SKIPPABLE, 12 * n + 9) or entries[:, 0].sum() != size - 17 - 12 * n:
        raise ValueError("the seek table doesn't fit the data")
    return np.column_stack([np.cumsum(entries[:, 0]) - entries[:, 0], entries])


def frame(data: bytes, entry: np.ndarray) -> np.ndarray:
    """The token ids of one frame, checked."""
    _, packed, size, check = map(int, entry)
    content = zstandard.ZstdDecompressor().decompress(data, max_output_size=size) if size else b""
    if len(data) != packed or len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
        raise ValueError("a frame is damaged")
    return np.frombuffer(content, "<u2")


def read_documents(data: bytes, wanted: Iterable[int]) -> list[np.ndarray]:
    """Token ids of the frames wanted, by number; only they are decompressed, and each is checked."""
    entries = read_table(data)
    return [frame(data[int(e[0]) : int(e[0] + e[1])], e) for e in (entries[i] for i in wanted)]


def open_documents(file: str, wanted: Iterable[int]) -> list[np.ndarray]:
    """Like ``read_documents`` from a file, of which the footer, the table and the frames wanted are read and nothing else."""
    files, at = filesystem(file)
    with files.open_input_file(at) as f:
        size = f.size()
        if size < 17:
            raise ValueError("no seek table")
        n, _, _ = struct.unpack("<IBI", f.read_at(9, size - 9))
        tail = 17 + 12 * n
        if tail > size:
            raise ValueError("no seek table")
        entries = read_table(f.read_at(tail, size - tail), size)
        return [frame(f.read_at(int(e[1]), int(e[0])), e) for e in (entries[i] for i in wanted)]


def token_shards(docs: DataFrame, path: str, tokenizer: str = bpe.TOKENIZER, level: int = 3, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards of documents in their order, of about `shard_bytes` of ids before compression, under `path`; the manifest, a row for each: file, doc_ids by frame, and sizes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compress = bpe.encoder(tokenizer), zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        files, root = filesystem(path)
        frames, entries, ids = [], [], []

        def shard() -> pa.RecordBatch:
            size, name = sum(e[1] for e in entries), f"{uuid.uuid4().hex}.zst"
            data = b"".join(frames) + seek_table(entries)
            files.create_dir(root, recursive=True)
            # As the bytes are: by its name the file would be compressed once more.
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            row = {"file": [f"{path}/{name}"], "n_docs": [len(ids)], "n_tokens": [size // 2], "n_bytes": [len(data)], "doc_ids": [list(ids)]}
            for x in (frames, entries, ids):
                x.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]))

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = encode(text.as_py())
                if ids and held + len(content) > shard_bytes:
                    yield shard()
                    held = 0
                held += len(content)
                packed = compress(content)
                frames.append(packed)
                entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
                ids.append(doc_id)
        if ids:
            yield shard()

    docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(pack, SCHEMA).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
