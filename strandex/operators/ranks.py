"""Row numbers and running sums over a whole table, in two levels, so that no task gets all rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.runtime import fresh, stage


def numbered(rows: DataFrame, order: list[Column], rank: str = "rank", running: Mapping[str, str] | None = None) -> DataFrame:
    """Adds the row number in ``order`` and, for each entry of ``running``, the running sum of a column.

    Rows are range-partitioned by the order and staged with their partition's number; each partition
    is numbered by itself, and what stands before it is added from a table of one row a partition.
    Rows equal in ``order`` get different numbers, so end it with a key.
    """
    part, before = fresh(rows, "__part"), fresh(rows, "__before")
    running = dict(running or {})
    dealt = stage(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranks")
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    for name, column in running.items():
        local = local.withColumn(name, F.sum(column).over(inside))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(running.values())])
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = sizes.select(part, F.struct(F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), *[F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)).alias(f"s{i}") for i in range(len(running))]).alias(before))
    joined = local.join(F.broadcast(sizes), part)
    joined = joined.withColumn(rank, F.col(rank) + F.col(f"{before}.n"))
    for i, name in enumerate(running):
        joined = joined.withColumn(name, F.col(name) + F.col(f"{before}.s{i}"))
    return joined.drop(part, before)
