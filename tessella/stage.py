"""Written stages, and running totals that no single task has to see whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side that is broadcast, in bytes of its plan's estimate.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); with a local master a folder of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/tessella-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, kind: str = "stage") -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: several consumers share one computation."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(left: DataFrame, right: DataFrame, on, how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """A join that broadcasts the right side only if its size estimate is within the limit."""
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= limit else right, on, how)


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the keys up to each row.

    Rows are dealt in ranges of (keys, order); a range's sums per key, a table
    of at most ranges x keys rows, give what stands before it, and only the
    rows of one range are summed one after another. A key that holds most rows
    is spread over many ranges.
    """
    ranged = materialize(df.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p", *keys).agg(F.sum("_v").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    same = F.col("r._p") == F.col("b._p")
    for k in keys:
        same = same & F.col("r." + k).eqNullSafe(F.col("b." + k))
    local = Window.partitionBy("r._p", *["r." + k for k in keys]).orderBy(*["r." + o for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.alias("r").join(before.alias("b"), same)
    return joined.select(*["r." + c for c in df.columns], (F.col("b._before") + F.sum("r._v").over(local)).cast("long").alias(out))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """Adds the row's number (from 1) among the rows of the keys."""
    return running_total(df, keys, order, F.lit(1), out)
