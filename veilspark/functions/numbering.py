"""Sequence numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.session import cut


def number_within(df: DataFrame, groups: list[str], order: list, out: str = "n") -> DataFrame:
    """Adds 1, 2, ... within each group by ``order``, without gathering a group in one task.

    Rows are partitioned by range of group and order, numbered within each partition and shifted by the counts of the partitions before
    it; a group that holds a third of all rows is spread over many partitions. The order must be total for the result to be defined."""
    ranged = cut(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order)))
    counts = ranged.groupBy(*groups, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*groups, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    joined = local.alias("l").join(shift.alias("s"), [F.col(f"l.{g}").eqNullSafe(F.col(f"s.{g}")) for g in [*groups, "_part"]])
    return joined.select("l.*", (F.col("_local") + F.col("_shift")).cast("int").alias(out)).drop("_part", "_local")
