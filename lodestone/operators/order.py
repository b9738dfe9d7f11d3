"""Numbering rows in an order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import kept


def numbered(df: DataFrame, by: list[Column], name: str, slots: int | None = None) -> DataFrame:
    """All rows with their number, from 0, in the order of `by`.

    Rows are range-partitioned and written with their slot; numbers are those within the slot
    plus the sizes of the slots before, a table as short as the slots are few.
    """
    slots = slots or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = kept(df.repartitionByRange(slots, *by).withColumn("_slot", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_slot").agg(F.count("*").alias("_size"))
    sizes = sizes.select("_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_slot").orderBy(*by)) - 1
    return dealt.join(F.broadcast(sizes), "_slot").withColumn(name, (within + F.col("_before")).cast("long")).drop("_slot", "_before")
