"""Distributed running sums and numbering: no group is ever ordered in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallkeeper.llm.common import stored


def running(df: DataFrame, by: Sequence[str], position: str, order: Sequence[Column], weight: str) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over the rows of the same ``by`` group that come earlier.

    ``position`` is a double in [0, 1] that never decreases along the order. A group of n rows is cut
    at fixed positions into about sqrt(n) cells of about sqrt(n) rows; cells are summed map-side, summed
    up along the group, and rows are ordered only inside their cell. ``df`` should be a stored frame;
    it is read three times. Groups are joined null-safe.
    """
    by = list(by)
    sizes = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(
        F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_cells"))
    cell = F.least(F.floor(F.col(position) * F.col("_cells")), F.col("_cells") - 1).cast("bigint")
    cut = df.join(sizes, _same(by)).select(*df.columns, cell.alias("_cell"))
    upto = (W.unboundedPreceding, -1)
    along = W.partitionBy(*[f"_of_{c}" for c in by]).orderBy("_of__cell").rowsBetween(*upto)
    by_cell = [*by, "_cell"]
    cells = (cut.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by_cell]).agg(F.sum(weight).alias("_sum"))
             .withColumn("_start", F.coalesce(F.sum("_sum").over(along), F.lit(0))).drop("_sum"))
    inside = W.partitionBy(*by_cell).orderBy(*order).rowsBetween(*upto)
    before = F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return cut.join(cells, _same(by_cell)).withColumn("before", before).select(*df.columns, "before")


def _same(names: Sequence[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names]


def numbered_sources(df: DataFrame, name: str, order: Column) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... along a total order over the whole frame.

    Rows are dealt into ranges and stored, so the ranges stay what they are; the counts of the ranges
    (one row per partition) give each range its first number.
    """
    parts = stored(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    first = (parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_first", F.coalesce(F.sum("_n").over(
                 W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return parts.join(first, "_part").withColumn(name, F.col("_first") + inside).drop("_part", "_first")
