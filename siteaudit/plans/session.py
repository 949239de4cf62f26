"""Session-level helpers: lineage cuts, input spreading, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may hold; beyond it the join shuffles instead.
BROADCAST_ROWS = 200_000
# Stored bytes of a part of a rebalanced table, and rows of a partition of a large shuffle.
SPREAD_BYTES = 8 * 1024 * 1024
PART_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Ends the lineage like a checkpoint does, survives lost executors, computes the rows once,
    and gives the optimizer real sizes for the joins that follow.
    """
    at = new_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def stored_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` reads; a source that does not know its size counts as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table read from few files into parts of bounded size, one a core at least.

    Judged by file count and size. The number of parts grows with the table, so a task that sorts
    or combines its part needs no more memory on a larger one.
    """
    files = len(df.inputFiles())
    parts = max(df.sparkSession.sparkContext.defaultParallelism, stored_bytes(df) // SPREAD_BYTES)
    if not files or files >= parts:
        return df
    return df.repartition(parts)


def partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of ``rows``: the session's number, and more where they would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def table_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of the rows of ``df``, by the stored size of the tables it reads."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_bytes(df) // SPREAD_BYTES)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a bounded count proves the side small."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df
