"""A table's rows in one global order, numbered without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.storage import materialize

_WITHIN = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "row_idx") -> DataFrame:
    """rows with their place from 0 in a total order, as a long.

    A range-partitioned sort is written once, each row with its partition and its place
    there; the partitions' sizes, one row for each, give every partition its first number.
    """
    at = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_at", _WITHIN)
    sizes = at.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # as many rows as the sort has partitions
    first = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_first"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    met = at.withColumn("_p", part).join(F.broadcast(first), "_p")
    return met.withColumn(name, F.col("_first") + within).drop("_p", "_at", "_first")


def batches(rows: DataFrame, size: int, *order: Column | str, name: str = "batch") -> DataFrame:
    """rows with the number of their batch: `size` rows next to each other in the order."""
    return numbered(rows, *order, name=name).withColumn(name, F.floor(F.col(name) / size).cast("long"))
