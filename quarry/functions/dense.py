"""Dense ids without one global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import stored


def dense_ids(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """The distinct values of ``column`` with 0, 1, ... in their order.

    Values are range-partitioned and numbered in each partition; partition offsets come from a table of one row a
    partition. No task holds more than its partition.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    parts = stored(values.repartitionByRange(column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id()), "dense")
    numbered = parts.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(column)))
    sizes = parts.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return numbered.join(F.broadcast(before), "part").select(column, (F.col("before") + F.col("n") - 1).cast("long").alias(name))
