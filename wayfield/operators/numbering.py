"""Consecutive row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfield.sources.scratch import Scratch, task_slots


def numbered(df: DataFrame, order: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """Add ``name`` = 0, 1, ... in the order of the columns ``order``, which must be unique.

    Rows are range-partitioned and numbered inside each partition; only the partition sizes are
    summed up over the whole.
    """
    ranged = scratch.save(
        df.repartitionByRange(task_slots(df.sparkSession), *order).sortWithinPartitions(*order)
          .withColumn("_part", F.spark_partition_id())
          .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    # One row per partition, so this window and the broadcast stay as small as the partition count.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return (ranged.join(F.broadcast(before), "_part")
                  .withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"))
