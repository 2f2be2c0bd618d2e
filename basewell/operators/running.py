"""Prefix sums and ranks over tables of any size: sorted ranges, their totals, and places inside each range. No task holds more than a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """df in sorted ranges, written once: _part is a row's range. The number of ranges is that of shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store.written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def sums(df: DataFrame, order: list[str], *values: str) -> DataFrame:
    """df with <value>_before: the sum of a value over all rows that come before in `order`, which tells rows apart.

    Only the ranges' totals, a row each, are summed in one place; they are broadcast, as there are no more than shuffle partitions."""
    placed = _ranged(df, *order)
    totals = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    every, inside = Window.orderBy("_part"), Window.partitionBy("_part").orderBy(*order)
    offsets = totals.select(F.col("_part").alias("_of"), *[(F.sum(f"_{v}").over(every) - F.col(f"_{v}")).alias(f"_{v}") for v in values])
    joined = placed.withColumns({f"{v}_before": F.sum(v).over(inside) - F.col(v) for v in values}).join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return joined.select(*df.columns, *[(F.col(f"_{v}") + F.col(f"{v}_before")).cast("long").alias(f"{v}_before") for v in values])


def ranked(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """df with a row's place among those of equal `by`, from 0 in `order`. A group of any share of all rows is spread over ranges.

    A range shares at most its first and its last group with others; their sizes, at most two rows a range, are summed and broadcast."""
    placed = _ranged(df, by, *order)
    runs = placed.groupBy("_part", by).agg(F.count("*").alias("_n"))
    ends = placed.groupBy("_part").agg(F.min(by).alias("_a"), F.max(by).alias("_z")).select(F.col("_part").alias("_of"), "_a", "_z")
    # only a range's first and last group can go on in another one
    edges = runs.join(F.broadcast(ends), F.col("_part") == F.col("_of")).filter((F.col(by) == F.col("_a")) | (F.col(by) == F.col("_z")))
    before = edges.select(F.col("_part").alias("_in"), F.col(by).alias("_group"), (F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).alias("_before")).filter("_before > 0")
    inside = F.row_number().over(Window.partitionBy("_part", by).orderBy(*order))
    joined = placed.withColumn("_place", inside).join(F.broadcast(before), (F.col("_part") == F.col("_in")) & (F.col(by) == F.col("_group")), "left")
    return joined.select(*df.columns, (F.col("_place") - 1 + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
