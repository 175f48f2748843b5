"""Gapless numbers over tables of any size, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadgraph.storage import keep

#: Rows of a numbering block are at most 2 ** BLOCK_BITS, all of one file.
BLOCK_BITS = 16


def number_within(table: DataFrame, group: str, name: str) -> DataFrame:
    """Gapless numbers from 0 within each value of ``group``, in file and row order, over a table that ``keep`` returned.

    Rows are numbered inside blocks of one file, so a group that holds any share of all rows is never sorted in one task; a running
    sum over the blocks' counts gives each block its start.
    """
    at = table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")).withColumn("_block", F.shiftright("_row", BLOCK_BITS))
    block = [group, "_file", "_block"]
    before = Window.partitionBy(group).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy(*block).agg(F.count("*").alias("_count")).withColumn("_start", F.coalesce(F.sum("_count").over(before), F.lit(0))).drop("_count")
    numbered = at.withColumn("_in_block", F.row_number().over(Window.partitionBy(*block).orderBy("_row")) - 1)
    return numbered.join(starts, block).withColumn(name, (F.col("_start") + F.col("_in_block")).cast("long")).drop("_file", "_row", "_block", "_in_block", "_start")


def number_sorted(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Gapless numbers from 0 in a global order: a range-partitioned sort is written, and its files are numbered in their order.

    Files of one write are named in the order of their partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = keep(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_all", F.lit(0)), "sorted")
    return number_within(table, "_all", name).drop("_all")
