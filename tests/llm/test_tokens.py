import numpy as np
import pytest
from pyspark.sql import functions as F

from strandix.llm import bpe
from strandix.llm.common import filesystem, scratch
from strandix.llm.token_counts import scan_token_files, token_counts
from strandix.llm.token_files import open_documents, read_documents, read_table, token_shards

ROWS = [(1, "a few words", "x"), (2, "", "y"), (3, None, None), (None, "no id", "z"), (1, "a few words", "x"), (4, "long ééé <|endoftext|> " * 4000, "w"), (5, "日本語 😀\n\n tail ", "v")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


@pytest.mark.parametrize("block", [6, 64, 1 << 20])
def test_counts_match_brute_force(spark, block):
    rows = [r for r in ROWS if block > 6 or not r[1] or len(r[1]) < 1000]
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts(docs(spark, rows), block_bytes=block).collect()), key=str)
    ids = bpe.encoder()
    assert got == sorted(((i, len(ids(t)) // 2) for i, t, _ in rows), key=str)


def test_counts_empty_table(spark):
    assert token_counts(docs(spark).where("false")).collect() == []


def test_scan_unterminated_and_empty_documents(spark):
    path = scratch(spark, "flat")
    files, root = filesystem(path)
    files.create_dir(root, recursive=True)
    e = 9
    contents = {"a": [1, 2, e, e, 3], "b": [e], "c": [], "d": [7], "e": [1, 2, 3, 4, 5, 6, 7, e, 8, e]}
    rows = []
    for name, ids in contents.items():
        data = np.array(ids, "<u2").tobytes()
        with files.open_output_stream(f"{root}/{name}") as f:
            f.write(data)
        rows.append((f"{path}/{name}", len(data)))
    got = scan_token_files(spark.createDataFrame(rows, "file string, n_bytes long"), end=e, block_bytes=4).collect()
    want = []
    for name, ids in contents.items():
        first, k = 0, 0
        for i, x in enumerate([*ids, None]):
            if x == e or (x is None and i > first):
                want.append((name, k, first, i - first, x == e))
                first, k = i + 1, k + 1
    assert sorted((r.file[-1], r.ordinal, r.first_token, r.n_tokens, r.terminated) for r in got) == sorted(want)


def test_one_huge_file_is_stitched_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50, 60_000).astype("<u2")
    path = scratch(spark, "flat")
    files, root = filesystem(path)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/one") as f:
        f.write(ids.tobytes())
    got = scan_token_files(spark.createDataFrame([(f"{path}/one", 120_000)], "file string, n_bytes long"), end=7, block_bytes=500).orderBy("ordinal").collect()
    cuts = np.flatnonzero(ids == 7)
    starts = np.concatenate([[0], cuts + 1])
    ends = np.concatenate([cuts, [len(ids)]])
    want = [(i, int(a), int(b - a), i < len(cuts)) for i, (a, b) in enumerate(zip(starts, ends)) if i < len(cuts) or b > a]
    assert [(r.ordinal, r.first_token, r.n_tokens, r.terminated) for r in got] == want


def content(file):
    files, at = filesystem(file)
    with files.open_input_stream(at, compression=None) as f:
        return f.read()


def test_shards_round_trip_and_random_access(spark):
    rows = token_shards(docs(spark), scratch(spark, "shards"), shard_bytes=5000).collect()
    seen, ids = [], bpe.encoder()
    for r in rows:
        data = content(r.file)
        assert len(data) == r.n_bytes and len(read_table(data)) == r.n_docs == len(r.doc_ids)
        for i in reversed(range(r.n_docs)):
            one = read_documents(data, [i])[0]
            assert (open_documents(r.file, [i])[0] == one).all()
            seen.append((r.doc_ids[i], one.tobytes()))
        import zstandard

        whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
        assert len(whole) == 2 * r.n_tokens
    assert sorted(seen, key=str) == sorted(((i, ids(t)) for i, t, _ in ROWS), key=str)
    assert bpe.decoder()(np.frombuffer(ids(ROWS[6][1]), "<u2").tolist()) == ROWS[6][1]


def test_a_reader_reads_what_it_asks_for_only(spark, monkeypatch):
    from strandix.llm import token_files

    rows = [(i, f"document {i} " * 500) for i in range(50)]
    r = token_shards(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), scratch(spark, "shards")).first()
    read = []

    class File:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            read.append(n)
            return self.f.read_at(n, at)

    class Files:
        def __init__(self, files):
            self.files = files

        def open_input_file(self, at):
            return File(self.files.open_input_file(at))

    real = token_files.filesystem
    monkeypatch.setattr(token_files, "filesystem", lambda p: (Files(real(p)[0]), real(p)[1]))
    k = r.doc_ids.index(17)
    assert open_documents(r.file, [k])[0].tobytes() == bpe.encoder()(rows[17][1])
    entry = read_table(content(r.file))[k]
    assert sum(read) == 9 + 17 + 12 * r.n_docs + entry[1] < r.n_bytes / 2


def test_damage_is_found(spark):
    data = bytearray(content(token_shards(docs(spark).coalesce(1), scratch(spark, "shards")).first().file))
    entries = read_table(bytes(data))
    k = int(np.argmax(entries[:, 1]))
    data[int(entries[k, 0] + entries[k, 1]) - 3] ^= 1
    with pytest.raises(Exception):
        read_documents(bytes(data), [k])
    with pytest.raises(ValueError):
        read_table(bytes(data)[:-1])


def test_no_shards_for_nothing(spark):
    assert token_shards(docs(spark).where(F.lit(False)), scratch(spark, "shards")).count() == 0
