"""Operator 4, near-duplicates: SimHash fingerprints, navigable small-world graphs over Hamming distance, verified edges, union.

1. A document is a doc_id with a text. Texts equal to the byte are one node. Each node has a 128-bit SimHash of its word pairs, made of vector
   operations over all texts of a slice.
2. Nodes are dealt to shards by a hash of their number, so a crowd of alike texts is spread over all of them. There are SHARDS shards, more only where a
   shard would hold over SHARD nodes. For each a navigable small-world graph is built by batches: each batch searches the graph so far by beam search for
   its nearest nodes and is linked to them. A search begins at the nodes that share sampled bits with the query.
3. Every node is a query and goes to every shard. Queries are bounded portions that meet the graph of a shard in one task each; graphs are files in the
   shared folder. The beam expands, doubled until no more than half of it lies within the radius. A query with too many partners in
   a shard even for the widest beam is crowded.
4. Pairs within the radius are candidates. They are verified by the exact Jaccard similarity of sets of hashed word triples, first each node with its
   nearest partners; a pair whose ends are in one group by then needs no verification, as it can't change the groups; the others are verified next.
   A pair that no beam held has two crowded ends: crowded nodes of different groups are compared exactly, in blocks, so partners have no cap. A block has
   the sets of its nodes, verifies there and unions as it goes, so what leaves it is a forest of groups and never the pairs of a crowd, which grow with
   the square of its size. Most pairs fail by a bound on the intersection from parity sketches, which loses none that would pass.
5. Verified edges are unioned into connected components; of a group the least doc_id, then the least text hash, is kept.

Recall is audited by exact search of AUDITED queries among all nodes; where it is below LEAST_RECALL all beams are doubled and the search is repeated.

Every query goes to every shard, so beyond SHARDS * SHARD nodes the work grows with the nodes times the shards, nodes ** 2 / SHARD searches.

Cases: null and empty texts are in no group, nor are rows without doc_id; rows of one doc_id with other texts are documents of their own, judged each by
its text; repeated rows are one document; a text of one word has one pair with an empty word; texts of fewer than three words are compared as one
shingle; copies of one text are a group however short; an empty table gives no rows; other columns are ignored (``deduplicate`` keeps them,
whatever their names).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandix.llm.common import U, Words, cut, discard, filesystem, mix, scratch, slices, table, utf8, without
from strandix.llm.components import components

RADIUS = 36
JACCARD = 0.55
SHARDS = 6
SHARD = 1 << 20
#: Most queries that meet a shard's graph in one task.
PORTION = 1 << 17
NEAREST = 3
AUDITED = 256
LEAST_RECALL = 0.9
BEAM, WIDEST = 32, 64

_SPREAD = np.array([int.from_bytes(bytes((i >> b) & 1 for b in range(8)), "little") for i in range(256)], U)


def simhash(words: Words) -> np.ndarray:
    """(texts, 2) uint64: a SimHash of each text's pairs of successive words, by number of occurrences."""
    n = len(words.first) - 1
    before = np.zeros(len(words.hash), U)
    before[1:] = words.hash[:-1]
    before[words.first[:-1][words.counts > 0]] = 0
    out = np.zeros((n, 2), U)
    at, step = 0, 32_768
    own = words.owner()
    total = np.zeros((n, 128), np.int64)
    while at < len(own):
        part = slice(at, min(at + step, len(own)))
        pair = mix(before[part] * U(0xC2B2AE3D27D4EB4F) + words.hash[part])
        bits = np.column_stack([pair, mix(pair ^ U(0x27D4EB2F165667C5))]).view(np.uint8)
        who = own[part]
        # Eight counters share an integer, one byte each, so sums run over at most 255 rows of one text.
        place = np.arange(len(who)) - np.searchsorted(who, who)
        begin = np.flatnonzero(place % 255 == 0)
        sums = np.add.reduceat(_SPREAD[bits], begin, axis=0).view(np.uint8)
        who = who[begin]
        new = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        total[who[new]] += np.add.reduceat(sums.astype(np.int64), new, axis=0)
        at = part.stop
    packed = np.packbits(2 * total > words.counts[:, None], axis=1)
    out[:] = packed.view(U)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.bitwise_count(a ^ b)
    return x[..., 0].astype(np.int64) + x[..., 1]


_FULL = np.uint64(2**63)


class Entries:
    """Places where searches begin: of each of some tables by sampled bits, the first nodes that share them with the query."""

    def __init__(self, fp: np.ndarray, tables: int = 24, each: int = 2) -> None:
        self.each, bits = each, max(1, int(math.log2(max(len(fp) / each, 2))))
        rng, seen = np.random.default_rng(4), np.unpackbits(fp.view(np.uint8), axis=1)
        self.tables = []
        for _ in range(tables):
            chosen = np.sort(rng.permutation(128)[:bits])
            value = self._value(seen, chosen)
            order = np.argsort(value, kind="stable").astype(np.int32)
            self.tables.append((chosen, order, value[order]))

    @staticmethod
    def _value(bits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen)))

    def __call__(self, q: np.ndarray) -> np.ndarray:
        bits, out = np.unpackbits(np.ascontiguousarray(q).view(np.uint8), axis=1), []
        for chosen, order, value in self.tables:
            own = self._value(bits, chosen)
            lo, hi = np.searchsorted(value, own), np.searchsorted(value, own, "right")
            out += [np.where(lo + j < hi, order[np.minimum(lo + j, len(order) - 1)], -1) for j in range(self.each)]
        return np.stack(out, axis=1).astype(np.int64)


class Graph:
    """A navigable small-world graph over fingerprints; build and search work on many nodes at once."""

    def __init__(self, fp: np.ndarray, near: np.ndarray | None = None, links: int = 12, degree: int = 24, beam: int = 24, batch: int = 1024, radius: int = RADIUS) -> None:
        self.fp, self.degree, self.radius = fp, degree, radius
        self.entries = Entries(fp)
        if near is not None:
            self.near = near
            return
        n = len(fp)
        self.near = np.full((n, degree), -1, np.int32)
        done = min(n, 48)
        i, j = np.nonzero(~np.eye(done, dtype=bool))
        self._link(i, j)
        while done < n:
            q = np.arange(done, min(n, done + min(done, batch)))
            start = self.entries(fp[q])
            start[start >= done] = -1
            ids, d = self.search(fp[q], np.concatenate([start, np.tile(np.linspace(0, done - 1, 6).astype(np.int64), (len(q), 1))], axis=1), beam)
            ids, d = ids[:, :links], d[:, :links]
            i, k = np.nonzero(ids >= 0)
            a, b = q[i], ids[i, k]
            # Near nodes of one batch can't find each other in the graph so far.
            dd = distance(fp[q][:, None], fp[q][None])
            x, y = np.nonzero(dd <= radius)
            x, y = x[x != y], y[x != y]
            self._link(np.concatenate([a, b, q[x]]), np.concatenate([b, a, q[y]]))
            done += len(q)

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds b to the links of a; each node keeps its nearest."""
        if not len(a):
            return
        nodes = np.unique(a)
        old = self.near[nodes]
        i, k = np.nonzero(old >= 0)
        src = np.concatenate([nodes[i], a])
        dst = np.concatenate([old[i, k], b])
        d = distance(self.fp[src], self.fp[dst])
        # Equal distances in an order of each node's own, else a cluster's nodes would all link to the same few.
        order = np.lexsort((dst, mix(src.astype(U) << U(32) | dst.astype(U)), d, src))
        src, dst, d = src[order], dst[order], d[order]
        keep = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
        src, dst, d = src[keep], dst[keep], d[keep]
        rank = np.arange(len(src)) - np.searchsorted(src, src)
        keep = rank < self.degree
        self.near[nodes] = -1
        self.near[src[keep], rank[keep]] = dst[keep]

    def search(self, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of each query from its start nodes: ids (-1: none) and distances of the beam, nearest first."""

        def keys(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
            d = distance(self.fp[ids], q[rows][:, None])
            return np.where(ids >= 0, (d.astype(U) << U(33)) | (ids.astype(U) << U(1)), _FULL)

        n = len(q)
        held = np.full((n, beam), _FULL, U)
        first = self._merge(keys(start, np.arange(n)), beam)
        held[:, : first.shape[1]] = first
        active = np.arange(n)
        while len(active):
            h = held[active]
            fresh = ((h & U(1)) == 0) & (h != _FULL)
            any_fresh = fresh.any(axis=1)
            active, h, fresh = active[any_fresh], h[any_fresh], fresh[any_fresh]
            if not len(active):
                break
            row = np.arange(len(active))
            k = fresh.argmax(axis=1)
            node = ((h[row, k] >> U(1)) & U(0xFFFFFFFF)).astype(np.int64)
            h[row, k] |= U(1)
            held[active] = self._merge(np.concatenate([h, keys(self.near[node], active)], axis=1), beam)
        return np.where(held == _FULL, -1, ((held >> U(1)) & U(0xFFFFFFFF)).astype(np.int64)), np.where(held == _FULL, 999, (held >> U(33)).astype(np.int64))

    @staticmethod
    def _merge(keys: np.ndarray, beam: int) -> np.ndarray:
        """The least keys of each row, each node once; of its two keys the expanded one stays."""
        keys = np.sort(keys, axis=1)
        twice = (keys[:, :-1] | U(1)) == (keys[:, 1:] | U(1))
        twice &= keys[:, :-1] != _FULL
        keys[:, :-1][twice] = _FULL
        return np.sort(keys, axis=1)[:, :beam]

    def within(self, q: np.ndarray, beam: int = BEAM, widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of the nodes found within the radius of each query, and the crowded queries.

        A beam expands, doubled, until no more than half of it lies within the radius. A query whose widest beam is still that full is crowded: of its
        nodes only that beam is given.
        """
        n, found, todo, crowded = len(self.fp), [], np.arange(len(q)), []
        while len(todo):
            full = []
            for i in range(0, len(todo), 4096):
                part = todo[i : i + 4096]
                ids, d = self.search(q[part], np.concatenate([self.entries(q[part]), np.tile(np.linspace(0, n - 1, 4).astype(np.int64), (len(part), 1))], axis=1), beam)
                near = (d <= self.radius) & (ids >= 0)
                more = (near.sum(axis=1) > beam // 2) & (beam < n)
                last = beam >= widest
                (crowded if last else full).append(part[more])
                r, k = np.nonzero(near & (last | ~more)[:, None])
                found.append((part[r], ids[r, k], d[r, k]))
            todo = np.concatenate(full) if full else todo[:0]
            beam *= 2
        a, b, d = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return a, b, d, np.concatenate(crowded) if crowded else np.zeros(0, np.int64)


def exact(q: np.ndarray, fp: np.ndarray, radius: int, rows: int = 64, columns: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (query, node) within the radius, block by block."""
    for j in range(0, len(fp), columns):
        c0, c1 = (np.ascontiguousarray(fp[j : j + columns, i])[None] for i in (0, 1))
        for i in range(0, len(q), rows):
            d = np.bitwise_count(q[i : i + rows, :1] ^ c0)
            d += np.bitwise_count(q[i : i + rows, 1:] ^ c1)
            r, k = np.nonzero(d <= radius)
            if len(r):
                yield r + i, k + j


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, f0, f1) of each row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1])
                fp = simhash(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64))], ["doc_id", "h", "f0", "f1"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    return rows.select("doc_id", F.unhex(F.md5("text")).alias("h"), "text").mapInArrow(run, "doc_id bigint, h binary, f0 bigint, f1 bigint")


def _array(pdf: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(np.column_stack([pdf["f0"].to_numpy(), pdf["f1"].to_numpy()])).view(U)


def graphs(nodes: DataFrame, n: int, shard: int = SHARD, radius: int = RADIUS) -> list[tuple[int, str]]:
    """nodes(id, f0, f1) to (shard, file) of each graph. A file is named by the attempt that wrote it and known by the committed rows only."""
    path, count = scratch(nodes.sparkSession, "graphs"), max(SHARDS, -(-n // shard))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # In an order of no meaning, so that the graph grows everywhere at once.
        pdf = pdf.iloc[np.argsort(mix(pdf["id"].to_numpy().view(U)))]
        fp = _array(pdf)
        g = Graph(fp, radius=radius)
        files, root = filesystem(path)
        files.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.graph"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(np.array([len(fp), g.degree], np.int64).tobytes() + pdf["id"].to_numpy().astype(np.int64).tobytes())
            out.write(fp.tobytes())
            out.write(g.near.tobytes())
        return pd.DataFrame({"s": [key[0]], "file": [f"{path}/{name}"]})

    dealt = nodes.select("id", "f0", "f1", F.pmod(F.xxhash64("id"), F.lit(count)).alias("s"))
    built = dealt.repartition(min(8 * count, 20_000), "s").groupBy("s").applyInPandas(build, "s bigint, file string")
    return [(r.s, r.file) for r in cut(built).collect()]


def load(file: str, radius: int) -> tuple[np.ndarray, Graph]:
    """A graph's node ids and the graph."""
    files, at = filesystem(file)
    with files.open_input_file(at) as f:
        raw = f.read()
    n, degree = np.frombuffer(raw, np.int64, 2).tolist()
    ids = np.frombuffer(raw, np.int64, n, 16)
    fp = np.frombuffer(raw, U, 2 * n, 16 + 8 * n).reshape(n, 2)
    return ids, Graph(fp, np.frombuffer(raw, np.int32, n * degree, 16 + 24 * n).reshape(n, degree), degree=degree, radius=radius)


def candidates(nodes: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD, beam: int = BEAM, files: list[tuple[int, str]] | None = None, portion: int = PORTION) -> DataFrame:
    """nodes(id, f0, f1) to pairs (a, b, d), a < b, found within the radius, every node a query to every shard, and (a, a, 0) for each node a crowded in some shard."""
    where = dict(files if files is not None else graphs(nodes, n, shard, radius))
    portions = max(4, -(-n // portion))

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, g = load(where[key[0]], radius)
        own = pdf["id"].to_numpy()
        a, b, d, crowded = g.within(_array(pdf), beam, max(WIDEST, 2 * beam))
        a, b, crowded = own[a], ids[b], own[crowded]
        other = a != b
        a, b, d = a[other], b[other], d[other]
        return pd.DataFrame({"a": np.concatenate([np.minimum(a, b), crowded]), "b": np.concatenate([np.maximum(a, b), crowded]), "d": np.concatenate([d, np.zeros(len(crowded), np.int64)]).astype(np.int32)})

    if not where:
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint, d int")
    sent = nodes.select("id", "f0", "f1", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(portions)).alias("p"), F.explode(F.array(*[F.lit(s).cast("bigint") for s in where])).alias("s"))
    # The work is in the searches, not in the bytes: many partitions, so that few hold two cells.
    return sent.repartition(min(8 * portions * len(where), 20_000), "s", "p").groupBy("s", "p").applyInPandas(pairs, "a bigint, b bigint, d int").distinct()


def crossings(crowded: DataFrame, n: int, radius: int = RADIUS, block: int = 1 << 14) -> DataFrame:
    """crowded(id, f0, f1, label), n rows, to all pairs (a, b) of them within the radius whose labels differ, by exact search of blocks against blocks: the plain form of ``crowd_bridges``, which tests hold it against."""
    blocks = -(-n // block)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, ids, label, k, i = _array(pdf), pdf["id"].to_numpy(), pdf["label"].to_numpy(), pdf["k"].to_numpy(), pdf["i"].iloc[0]
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == pdf["j"].iloc[0])
        out = [np.zeros((0, 2), np.int64)]
        for r, c in exact(fp[left], fp[right], radius):
            r, c = left[r], right[c]
            differ = label[r] != label[c]
            out.append(np.column_stack([ids[r[differ]], ids[c[differ]]]))
        both = np.concatenate(out)
        return pd.DataFrame({"a": both.min(axis=1), "b": both.max(axis=1)})

    numbered = crowded.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    cells = numbered.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least("k", x).alias("i"), F.greatest("k", x).alias("j"))))).select("id", "f0", "f1", "label", "k", "at.i", "at.j")
    return cells.groupBy("i", "j").applyInPandas(pairs, "a bigint, b bigint").distinct()


SKETCH = 1024


def sketches(sets: list[bytes]) -> np.ndarray:
    """Of each set of 32-bit hashes, SKETCH parities of how many fall in each slot: two sets differ in at least as many elements as their parities do."""
    out = np.zeros((len(sets), SKETCH // 64), U)
    for i in range(0, len(sets), 2048):
        part = sets[i : i + 2048]
        slot = np.frombuffer(b"".join(part), np.uint32).astype(np.int64) % SKETCH
        own = np.repeat(np.arange(len(part)), [len(x) // 4 for x in part])
        odd = np.bincount(own * SKETCH + slot, minlength=len(part) * SKETCH).reshape(len(part), SKETCH) & 1
        out[i : i + 2048] = np.packbits(odd.astype(bool), axis=1).view(U)
    return out


def alike(x: np.ndarray, y: np.ndarray, jaccard: float) -> bool:
    """Whether two sets, sorted, have at least this similarity."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= jaccard * (len(both) - shared)


def merge(fp: np.ndarray, sets: list[bytes], label: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, jaccard: float) -> list[tuple[int, int]]:
    """Pairs of labels that join all labels which pairs of a node of `left` and one of `right`, within the radius and of this similarity, connect."""
    names, group = np.unique(label, return_inverse=True)
    root, out, odd, sizes = np.arange(len(names)), [], sketches(sets), np.array([len(x) // 4 for x in sets], np.int64)
    for r, c in exact(fp[left], fp[right], radius):
        r, c = left[r], right[c]
        for i in range(0, len(r), 1 << 16):
            a, b = r[i : i + (1 << 16)], c[i : i + (1 << 16)]
            differ = root[group[a]] != root[group[b]]
            a, b = a[differ], b[differ]
            total = sizes[a] + sizes[b]
            most = np.minimum((total - np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)) // 2, np.minimum(sizes[a], sizes[b]))
            good = most >= jaccard * (total - most)
            for x, y in zip(a[good].tolist(), b[good].tolist()):
                p, q = root[group[x]], root[group[y]]
                if p != q and alike(np.frombuffer(sets[x], np.uint32), np.frombuffer(sets[y], np.uint32), jaccard):
                    root[root == q] = p
                    out.append((int(label[x]), int(label[y])))
    return out


def crowd_bridges(crowded: DataFrame, radius: int = RADIUS, jaccard: float = JACCARD, block: int = 1 << 14, block_bytes: int = 1 << 25) -> DataFrame:
    """crowded(id, f0, f1, label, set) to pairs (a, b) of labels that connect all labels which verified ``crossings`` connect."""
    n, size = crowded.agg(F.count("*"), F.sum(F.length("set"))).first()
    blocks = max(1, -(-n // block), -(-(size or 0) // block_bytes))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf["k"].to_numpy()
        left, right = np.flatnonzero(k == pdf["i"].iloc[0]), np.flatnonzero(k == pdf["j"].iloc[0])
        out = merge(_array(pdf), pdf["set"].tolist(), pdf["label"].to_numpy(), left, right, radius, jaccard)
        return pd.DataFrame({"a": np.array([x for x, _ in out], np.int64), "b": np.array([y for _, y in out], np.int64)})

    numbered = crowded.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    cells = numbered.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(F.least("k", x).alias("i"), F.greatest("k", x).alias("j")))))
    return cells.select("id", "f0", "f1", "label", "set", "k", "at.i", "at.j").groupBy("i", "j").applyInPandas(pairs, "a bigint, b bigint").distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, set): the sorted distinct 32-bit hashes of each text's word triples, as bytes.

    Two sets of m and n triples share about m * n / 2**32 hashes by chance: less than one for texts of 60,000 words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1])
                grams, _, own = words.shingles(3)
                bounds = np.searchsorted(own, np.arange(hi - lo + 1))
                sets = []
                for i in range(hi - lo):
                    s = grams[bounds[i] : bounds[i + 1]]
                    if not len(s):
                        w = words.hash[words.first[i] : words.first[i + 1]]
                        s = mix(np.array([sum(int(x) * 31**j for j, x in enumerate(w)) % 2**64], U))
                    sets.append(np.unique((s >> U(32)).astype(np.uint32)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sets, pa.binary())], ["id", "set"])

    return docs.mapInArrow(run, "id bigint, set binary")


def verify(pairs: DataFrame, sets: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """Those of the pairs (a, b) whose sets have at least this similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), jaccard) for x, y in zip(batch.column(2), batch.column(3))]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, radius: int = RADIUS, jaccard: float = JACCARD, shard: int = SHARD) -> DataFrame:
    """(doc_id, h, kept, kept_h) of each document in a group of several: doc_id and text hash, and those of the one that is kept for its group."""
    printed = cut(fingerprints(docs).dropDuplicates(["doc_id", "h"]))
    texts = printed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.count("*").alias("n"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))
    nodes = texts.select("id", "f0", "f1")
    n = nodes.count()
    files, beam = graphs(nodes, n, shard, radius), BEAM
    while True:
        marks = cut(candidates(nodes, n, radius, shard, beam, files))
        right, there = audit(nodes, marks, radius)
        if right >= LEAST_RECALL * there or beam >= 1024:
            break
        beam *= 2
    for folder in {file.rpartition("/")[0] for _, file in files}:
        discard(folder)
    found = marks.where("a <> b")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND length(text) > 0").withColumn("h", F.unhex(F.md5("text")))

    def sets_of(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        touched = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        if known is not None:
            touched = cut(touched.join(known.select("id"), "id", "left_anti"))
            if touched.isEmpty():
                return known.where("false")
        wanted = touched.join(texts.select("id", "doc_id", "h"), "id")
        # Repetitions of a row are in one partition after the join, so they go without another shuffle.
        return cut(shingle_sets(rows.join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("id", "text")))

    ends = found.select("a", "b", "d").unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    nearest = cut(ends.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= NEAREST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = sets_of(nearest)
    label = cut(components(cut(verify(nearest, sets, jaccard))))
    rest = found.select("a", "b").join(nearest, ["a", "b"], "left_anti")
    crowded = cut(marks.where("a = b").select(F.col("a").alias("id")).join(nodes, "id").join(label, "id", "left").select("id", "f0", "f1", F.coalesce("component", "id").alias("label")))
    if not crowded.isEmpty():
        sets = sets.unionAll(sets_of(crowded.select(F.col("id").alias("a"), F.col("id").alias("b")), sets))
        joined = cut(components(cut(crowd_bridges(cut(crowded.join(sets, "id")), radius, jaccard))))
        renamed = joined.select(F.col("id").alias("component"), F.col("component").alias("c2"))
        label = cut(label.join(renamed, "component", "left").select("id", F.coalesce("c2", "component").alias("component")).unionAll(joined.join(label, "id", "left_anti")))
        # Pairs of two crowded nodes are settled.
        ka, kb = (crowded.select(F.col("id").alias(x), F.lit(True).alias(f"k{x}")) for x in "ab")
        rest = rest.join(ka, "a", "left").join(kb, "b", "left").where("ka IS NULL OR kb IS NULL").select("a", "b")
    la, lb = label.select(F.col("id").alias("a"), F.col("component").alias("ca")), label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    rest = cut(rest.join(la, "a", "left").join(lb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    if rest.isEmpty():
        bridges = rest.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    else:
        # Between groups of the first round, so that what is unioned again is small. An end that isn't in `nearest` may have no set yet.
        good = verify(rest.select("a", "b"), sets.unionAll(sets_of(rest, sets)), jaccard)
        bridges = good.join(rest, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    over = components(bridges).select(F.col("id").alias("c1"), F.col("component").alias("c2"))
    merged = texts.join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).join(over, F.col("c") == F.col("c1"), "left")
    merged = cut(merged.select("h", "doc_id", "n", F.coalesce("c2", "c").alias("c")))
    several = merged.groupBy("c").agg(F.sum("n").alias("size"), F.min(F.struct("doc_id", "h")).alias("least")).where("size > 1")
    named = merged.select("h", "c").join(several, "c").select("h", F.col("least.doc_id").alias("kept"), F.col("least.h").alias("kept_h"))
    return printed.select("doc_id", "h").join(named, "h").select("doc_id", "h", "kept", "kept_h")


def groups(docs: DataFrame, radius: int = RADIUS, jaccard: float = JACCARD, shard: int = SHARD) -> DataFrame:
    """(doc_id, kept): each document that is a copy of another, and the document kept for its group, the least doc_id."""
    return classes(docs, radius, jaccard, shard).where("doc_id <> kept").select("doc_id", "kept").distinct()


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents without the copies, with their own columns. A row goes if its doc_id with its text is a copy; of rows that are equal in both all stay if one does."""
    gone = classes(docs).where("doc_id <> kept OR h <> kept_h").select("doc_id", "h")
    return without(docs, gone)


def audit(nodes: DataFrame, marks: DataFrame, radius: int = RADIUS, queries: int = AUDITED) -> tuple[int, int]:
    """(pairs found, pairs there are) of some queries, by exact search of all nodes; the queries are those of least hash. Pairs of two crowded nodes count as found, since they are compared exactly."""
    some = nodes.orderBy(F.xxhash64("id"), "id").limit(queries).toPandas()
    ids, q = some["id"].to_numpy(), _array(some)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            fp = np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()]).view(U)
            for r, k in exact(q, fp, radius):
                a, b = ids[r], own[k]
                a, b = a[a != b], b[a != b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    there = cut(nodes.select("id", "f0", "f1").mapInArrow(search, "a bigint, b bigint").distinct())
    crowded = marks.where("a = b").select("a")
    lost = there.join(marks.where("a <> b").select("a", "b"), ["a", "b"], "left_anti")
    lost = lost.subtract(lost.join(crowded, "a", "left_semi").join(crowded.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"))
    every = there.count()
    return every - lost.count(), every


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
