"""Tables as they are read, and where intermediate ones go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LEAST_BYTES = 1 << 20


def spread(table: DataFrame) -> DataFrame:
    """The table in as many partitions as there are cores, where its files give fewer (a single row group, say) and it has over a megabyte; else as it is.

    A large table has more partitions than that and isn't shuffled. Filters and column selection pass through to the scan.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    plan = table._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < LEAST_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return table
    return table.repartition(cores)


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Where that is unset, on a local master only, in one made for this session and deleted with the process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_strandix_shared", None)
        if not base:
            if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = spark._strandix_shared = tempfile.mkdtemp(prefix="strandix-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
