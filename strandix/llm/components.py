"""Connected components by minimum labels and pointer jumping, in joins; each round's labels are cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandix.llm.common import cut


def _mark(pairs: DataFrame) -> tuple:
    """What tells one set of distinct pairs from another, in one job: their number, and 128 bits of their hashes combined in any order."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), bigint, to (id, component): the least id reachable. Ids without edges don't occur. The rounds grow with the logarithm of the longest path."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    # Large-star and small-star: each keeps connectivity and makes stars, in rounds of two group-bys.
    pairs = cut(both.where("a > b"))
    known = _mark(pairs)
    while known[0]:
        sym = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(low2.select("a", F.col("m").alias("b"))).distinct()
        pairs, before = cut(small), known
        known = _mark(pairs)
        if known == before:
            break
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(pairs.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
