"""Operator 8, benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The similarity of a short item to a long document is too small for MinHash; the share of the item that the document holds isn't. Each of an item's MinHash
values is the hash of one of its shingles, any with equal probability, so the share of its MinHash shingles that occur in a document estimates its
containment there. Items are partitioned by size. Those of up to HASHES shingles are probed by all of them, which is exact. Larger ones are probed by the
shingles of HASHES MinHash values; a document is a candidate if it holds as many of them as an item contained to ``containment`` has with
probability 1 - MISS at least, wherever they lie. Candidates are verified: the share of the item's distinct shingles within the document's
must reach ``containment``. So an item is missed with probability MISS at most, whatever its size and the document's.

Items are hashed where they lie and sent out in portions of a bounded number of shingles, each broadcast for one scan of the documents whose (few) rows
are written before the next; nothing that is held grows with the benchmark. Documents aren't shuffled.

Shingles are runs of 5 words. Cases: an item of fewer than 5 words is one shingle of as many words; an empty or null item matches nothing, an
empty or null text holds nothing; repeated rows are reported each; items with equal text are reported each; null ids are reported as such; an empty
table of either kind gives no rows; other columns are ignored. ``decontaminate`` judges rows of one doc_id each by its text, null doc_ids too, and
keeps columns of any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import Words, cut, mix, slices, table, utf8, without

SHINGLE = 5
HASHES = 32
MISS = 1e-6
CONTAINMENT = 0.8
PORTION = 1_000_000
_SEEDS = np.random.default_rng(8).integers(0, 2**64, HASHES, dtype=np.uint64)
SCHEMA = "doc_id bigint, item_id bigint, n_shingles int, n_found int, containment double, first_word int, h binary"


def bar(containment: float, hashes: int = HASHES, miss: float = MISS) -> int:
    """The greatest number that a binomial count of `hashes` draws of this probability stays below with probability `miss` at most; one at least."""
    total, b = 0.0, 0
    while b < hashes:
        total += math.comb(hashes, b) * containment**b * (1 - containment) ** (hashes - b)
        if total > miss:
            break
        b += 1
    return max(1, b)


def prepared(benchmark: DataFrame) -> DataFrame:
    """(item_id, k, n, grams) of each item with a word: the length of its shingles, and the sorted distinct hashes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, out = batch.column(0).to_pylist(), []
            for i in range(batch.num_rows):
                words = Words(data, offsets[i : i + 2])
                if k := min(SHINGLE, len(words.hash)):
                    grams = np.unique(words.shingles(k)[0])
                    out.append((ids[i], k, len(grams), grams.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["item_id", "k", "n", "grams"])

    return benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "item_id bigint, k int, n int, grams binary")


class Items:
    """Items of one shingle length, ready for search: the probe shingles, and for each the items it stands for with the number of their MinHash values."""

    def __init__(self, k: int, rows: list[Row], containment: float) -> None:
        self.k, self.ids, self.sets = k, [r.item_id for r in rows], [np.frombuffer(r.grams, np.uint64) for r in rows]
        probes, items, weights, self.bar = [], [], [], np.zeros(len(rows), np.int64)
        most = bar(containment)
        for i, s in enumerate(self.sets):
            if len(s) <= HASHES:
                mine, times = s, np.ones(len(s), np.int64)
                self.bar[i] = max(1, math.ceil(containment * len(s) - 1e-9))
            else:
                mine, times = np.unique(s[mix(s[None] ^ _SEEDS[:, None]).argmin(axis=1)], return_counts=True)
                self.bar[i] = most
            probes.append(mine)
            weights.append(times)
            items.append(np.full(len(mine), i))
        probe, item, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (probes, items, weights))
        order = np.argsort(probe, kind="stable")
        self.item, self.weight = item[order], weight[order]
        self.probe, first = np.unique(probe[order].astype(np.uint64), return_index=True)
        self.first = np.append(first, len(order)).astype(np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.probe & np.uint64((1 << 20) - 1)] = True

    def candidates(self, grams: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(text, item) for the items of which a text holds enough probes. grams: shingles of all texts on end; own: the text of each."""
        at = np.flatnonzero(self.filter[grams & np.uint64((1 << 20) - 1)])
        if not len(at) or not len(self.probe):
            return np.zeros((0, 2), np.int64)
        which = np.minimum(np.searchsorted(self.probe, grams[at]), len(self.probe) - 1)
        good = self.probe[which] == grams[at]
        # A shingle counts once for a text, however often it occurs there.
        pair = np.unique(own[at[good]] * len(self.probe) + which[good])
        text, which = pair // len(self.probe), pair % len(self.probe)
        times = self.first[which + 1] - self.first[which]
        place = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(times) else np.zeros(0, np.int64)
        both, inverse = np.unique(np.repeat(text, times) * len(self.ids) + self.item[place], return_inverse=True)
        enough = np.bincount(inverse, self.weight[place], len(both)) >= self.bar[both % len(self.ids)] - 0.5
        return np.column_stack([both // len(self.ids), both % len(self.ids)])[enough]


def found_in(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, portion: int = PORTION) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment, first_word, h) of every pair of a row and an item found in it; h: the text's hash."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    items = cut(prepared(benchmark))
    portions = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // portion))
    out = spark.createDataFrame([], SCHEMA)
    for p in range(portions):
        # Hashing deals out alike portions; a single item is never split.
        rows = items.where(F.pmod(F.xxhash64("grams", "item_id"), F.lit(portions)) == p).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast([Items(k, [r for r in rows if r.k == k], containment) for k in sorted({r.k for r in rows})])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                ids = batch.column(0).to_pylist()
                rows: list[tuple] = []
                for lo, hi in slices(offsets):
                    words = Words(data, offsets[lo : hi + 1])
                    for part in shared.value:
                        grams, _, own = words.shingles(part.k)
                        bounds = np.searchsorted(own, np.arange(hi - lo + 1))
                        for d, i in part.candidates(grams, own).tolist():
                            its = grams[bounds[d] : bounds[d + 1]]
                            inside = np.flatnonzero(np.isin(its, part.sets[i]))
                            n = len(np.unique(its[inside]))
                            share = n / len(part.sets[i])
                            if share >= containment:
                                h = hashlib.md5(data[offsets[lo + d] : offsets[lo + d + 1]].tobytes()).digest()
                                rows.append((ids[lo + d], part.ids[i], len(part.sets[i]), n, share, int(inside[0]), h))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["doc_id", "item_id", "n_shingles", "n_found", "containment", "first_word", "h"])

        out = out.unionAll(cut(narrow.mapInArrow(run, SCHEMA)))
        shared.destroy()
    return out


def contained(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, portion: int = PORTION) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment, first_word) of every pair of a row and an item found in it."""
    return found_in(docs, benchmark, containment, portion).drop("h")


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows whose text holds no item, with their own columns."""
    return without(docs, found_in(docs, benchmark, containment).select("doc_id", "h").distinct())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Shingles as arrays of words, exactly.
SQL = """
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0B\\f]+'), lambda x: x <> '') AS w FROM benchmark
), dw AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0B\\f]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda j: array_to_string(w[j : j + least(5, len(w)) - 1], ' '))) AS g FROM iw WHERE len(w) > 0
), n AS (
  SELECT item_id, count(*) AS n FROM i GROUP BY item_id
), d AS (
  SELECT r, doc_id, k.k, generate_subscripts(w, 1) AS j, w FROM dw, (SELECT DISTINCT k FROM i) k
), g AS (
  SELECT r, doc_id, k, j - 1 AS p, array_to_string(w[j : j + k - 1], ' ') AS g FROM d WHERE j + k - 1 <= len(w)
), m AS (
  SELECT g.r, g.doc_id, i.item_id, count(DISTINCT i.g) AS f, min(g.p) AS pos FROM g JOIN i ON g.g = i.g AND g.k = i.k GROUP BY 1, 2, 3
)
SELECT doc_id, item_id, n::INTEGER AS n_shingles, f::INTEGER AS n_found, f::DOUBLE / n AS containment, pos::INTEGER AS first_word FROM m JOIN n USING (item_id) WHERE f::DOUBLE / n >= 0.8
"""
