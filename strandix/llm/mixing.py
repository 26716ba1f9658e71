"""Operator 6, mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each document draws an exponential key -ln(u) / weight from a hash of its doc_id, so that a rerun draws the same. A source's token budget is its
share of the target; as many complete epochs of the source as fit come first, then the documents of least key whose running token total
stays within what remains. The running total needs no sort of a whole source: keys fall in buckets in key order, the buckets' token sums are
scanned, and only the bucket in which the budget ends is sorted. What results is one cut per source, against which rows are compared.

Weights of documents: quality 1 counts 1, no label 0.5, quality 0 or toxic 0.1. Target weights of sources can be given; a source that isn't named then has
none and is left out, and one that has no rows takes nothing from the others. By default they are proportional to the square root of a source's
tokens, so small sources are repeated and large ones thinned. The target is as many tokens as the corpus has, times ``target_ratio``. Tokens
are words (runs of characters other than white space).

Cases: a null or empty text has 0 tokens; a null source is a source of its own; rows of one doc_id within a source have one key and are taken
together, ties of keys go by doc_id; a null doc_id draws the key of an empty string; an empty table gives no rows; a source
without tokens has no budget and each row once (its cost is 0), unless targets are given without it. ``mix`` keeps columns of any name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandix.llm.common import cut, plain, table

SEED = "mix-1"
BUCKETS = 1024
#: A target weight of 1 in integer shares.
SHARES = 1_000_000
TEMPERATURE = 0.5
#: Labelled documents, or sources, up to which they are broadcast to the rows.
MOST_BROADCAST = 500_000
Targets = Mapping[str | None, float]


def weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight), one row per labelled document."""
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return one.select("doc_id", F.when((F.col("x") > 0) | (F.col("q") == 0), 0.1).when(F.col("q") == 1, 1.0).otherwise(0.5).alias("weight"))


def key(doc_id: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.round(-F.log(u) / weight, 9)


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def keyed(rows: DataFrame, doc_id: Column, weighted: DataFrame) -> DataFrame:
    """The rows with _key and _bucket; weighted: ``weights``, broadcast if they are few."""
    few = weighted.count() <= MOST_BROADCAST
    known = weighted.select(F.col("doc_id").alias("_known"), F.col("weight").alias("_weight"))
    rows = rows.join(F.broadcast(known) if few else known, doc_id.cast("bigint") == F.col("_known"), "left")
    rows = rows.withColumn("_key", key(doc_id.cast("bigint"), F.coalesce("_weight", F.lit(0.5)))).drop("_known", "_weight")
    return rows.withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_key") / 2)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def plan(docs: DataFrame, weighted: DataFrame, target_ratio: float = 1.0, temperature: float = TEMPERATURE, targets: Targets | None = None) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, source, n_tokens, key, bucket), and per source (of_source, budget, epochs, end_bucket, cut_key, cut_id)."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens(F.col("text").cast("string")).alias("n_tokens"))
    narrow = cut(keyed(narrow, F.col("doc_id"), weighted).select("doc_id", "source", "n_tokens", F.col("_key").alias("key"), F.col("_bucket").alias("bucket")))
    buckets = cut(narrow.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")))
    sources = buckets.groupBy("source").agg(F.sum("n").alias("total"))
    # Exact and alike in any order of summation: shares are integers.
    if targets is None:
        sources = sources.withColumn("share", F.round(F.pow(F.col("total").cast("double"), F.lit(float(temperature))) * 1000).cast("bigint"))
    else:
        if any(not w >= 0 or w == float("inf") for w in targets.values()):
            raise ValueError("target weights are finite numbers from 0 on")
        given = docs.sparkSession.createDataFrame([(k, round(w * SHARES)) for k, w in targets.items()], "named string, share bigint")
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    whole = sources.agg(F.sum("total").alias("all_tokens"), F.sum("share").alias("all_shares"))
    sources = sources.crossJoin(whole).select(
        F.col("source").alias("of_source"), "total", F.coalesce(F.floor(F.col("all_tokens").cast("double") * target_ratio * F.col("share") / F.nullif("all_shares", F.lit(0))), F.lit(0)).cast("bigint").alias("budget")
    )
    sources = sources.withColumn("epochs", F.expr("CASE WHEN total > 0 THEN budget div total ELSE 1 END")).withColumn("rest", F.expr("CASE WHEN total > 0 THEN budget % total ELSE 0 END"))
    running = buckets.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))).withColumn("before", F.col("upto") - F.col("n"))
    # The bucket in which the budget ends; where it reaches the last one's end there is no rest to cut.
    ends = running.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).where("before <= rest AND rest < upto").groupBy("of_source").agg(F.min(F.struct("bucket", "before", "rest")).alias("e")).select("of_source", F.col("e.bucket").alias("end_bucket"), F.col("e.before").alias("before"), F.col("e.rest").alias("end_rest"))
    # The last bucket's rows alone are sorted; all other rows are only compared with the cut.
    inside = narrow.join(ends, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("end_bucket")))
    peers = inside.groupBy("of_source", "key", "doc_id").agg(F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("end_rest").alias("end_rest"))
    peers = peers.withColumn("sum", F.col("before") + F.sum("n").over(Window.partitionBy("of_source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    cuts = peers.where("sum <= end_rest").groupBy("of_source").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    sources = sources.join(ends.select(F.col("of_source").alias("s2"), "end_bucket"), F.col("of_source").eqNullSafe(F.col("s2")), "left").drop("s2")
    sources = sources.join(cuts.select(F.col("of_source").alias("s3"), "last"), F.col("of_source").eqNullSafe(F.col("s3")), "left").drop("s3")
    return narrow, sources.select("of_source", "budget", "epochs", "end_bucket", F.col("last.key").alias("cut_key"), F.col("last.doc_id").alias("cut_id"))


def copies(bucket: Column, key_: Column, doc_id: Column) -> Column:
    """How often a row is taken, given its source's plan."""
    first = F.coalesce(bucket < F.col("end_bucket"), F.lit(False))
    within = (bucket == F.col("end_bucket")) & ((key_ < F.col("cut_key")) | ((key_ == F.col("cut_key")) & (doc_id.isNull() | (doc_id <= F.col("cut_id")))))
    return (F.col("epochs") + F.when(first | F.coalesce(within, F.lit(False)), 1).otherwise(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, target_ratio: float = 1.0, temperature: float = TEMPERATURE, targets: Targets | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, key, copies) of every row; copies 0: left out."""
    narrow, sources = plan(docs, cut(weights(labels)), target_ratio, temperature, targets)
    joined = narrow.join(sources, F.col("source").eqNullSafe(F.col("of_source")), "left")
    return joined.select("doc_id", "source", "n_tokens", "key", F.coalesce(copies(F.col("bucket"), F.col("key"), F.col("doc_id")), F.lit(0)).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, target_ratio: float = 1.0, temperature: float = TEMPERATURE, targets: Targets | None = None) -> DataFrame:
    """The documents in the mixture, with their own columns: a row per copy. A row is compared with its source's cut where it lies; texts are shuffled only if the labels are too many to be broadcast."""
    weighted = cut(weights(labels))
    sources = cut(plan(docs, weighted, target_ratio, temperature, targets)[1])
    rows, names = plain(docs)
    doc_id, source = (F.col(names[docs.columns.index(x)]) for x in ("doc_id", "source"))
    few = sources.count() <= MOST_BROADCAST
    joined = keyed(rows, doc_id, weighted).join(F.broadcast(sources) if few else sources, source.cast("string").eqNullSafe(F.col("of_source")))
    taken = joined.withColumn("_copies", copies(F.col("_bucket"), F.col("_key"), doc_id.cast("bigint"))).where("_copies > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sql(target_ratio: float = 1.0, targets: Targets | None = None) -> str:
    """The same rows as ``sample``'s in DuckDB."""
    named = None if targets is None else ", ".join(f"({'NULL' if k is None else repr(k)}, {round(w * SHARES)})" for k, w in targets.items())
    share = "round(sqrt(sum(n_tokens)::DOUBLE) * 1000)::BIGINT" if named is None else f"(SELECT share FROM (VALUES {named}) t(named, share) WHERE named IS NOT DISTINCT FROM d.source)"
    return f"""
WITH w AS (
  SELECT doc_id, CASE WHEN max(coalesce(toxic, 0)) > 0 OR min(quality) = 0 THEN 0.1 WHEN min(quality) = 1 THEN 1.0 ELSE 0.5 END AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '\\S+'))::BIGINT AS n_tokens,
    round(-ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / coalesce(w.weight, 0.5)::DOUBLE, 9) AS key
  FROM documents d LEFT JOIN w USING (doc_id)
), s AS (
  SELECT source, sum(n_tokens)::BIGINT AS total, {share} AS share FROM d GROUP BY source
), k AS (
  SELECT * FROM s WHERE share IS NOT NULL
), b AS (
  SELECT source, total, coalesce(floor((SELECT sum(total) FROM k)::DOUBLE * {target_ratio!r}::DOUBLE * share / nullif((SELECT sum(share) FROM k), 0)), 0)::BIGINT AS budget FROM k
), r AS (
  SELECT d.*, b.total, b.budget, sum(d.n_tokens) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, n_tokens, key,
  (CASE WHEN total IS NULL THEN 0 WHEN total > 0 THEN budget // total + (CASE WHEN upto <= budget % total THEN 1 ELSE 0 END) ELSE 1 END)::INTEGER AS copies
FROM r
"""


SQL = sql()
