"""Row numbers over a whole table without bringing its rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PLACE_BITS = 33  # of ``monotonically_increasing_id``: the place within a partition, the partition above it


def numbered(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``df`` with the rows' numbers in the order of ``keys`` (from 1) as ``out``.

    Rows are range-partitioned, sorted and stored with an id that holds their range and their place in it (from 0),
    so they are dealt and sorted once; the ranges' counts, added up, say where each begins.  Rows with equal
    keys are numbered in no particular order."""
    held = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    rows = held.withColumn("__p", F.shiftright("__id", _PLACE_BITS))
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row per range
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1
    return rows.join(F.broadcast(starts), "__p").withColumn(out, F.col("__start") + place).drop("__id", "__p", "__start")
