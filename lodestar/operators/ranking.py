"""Row numbers within groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.runtime import Scratch, small


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with ``name``: place in its group by ``order``, from 1; ``order`` must tell a group's rows apart.

    Rows are range-sorted by (group, order), so a large group spreads over partitions; a row's number is its place in
    its partition plus the group's rows in earlier ones, of which there is one count for each group and partition.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    spread = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = scratch.write(spread.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "rows")
    parts = scratch.write(placed.groupBy(group, "_pid").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first")), "parts")
    before = F.coalesce(F.sum("_rows").over(W.partitionBy(group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col(group).alias("_group"), "_pid", (before - F.col("_first") + 1).alias("_offset"))
    joined = placed.join(small(offsets.withColumnRenamed("_pid", "_part"), parts.count(), 64), (F.col("_pid") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_at") + F.col("_offset")).drop("_pid", "_part", "_group", "_at", "_offset")
