"""Bounded samples in hash order, taken without moving the values that are not in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, by: Column, value: Column, n: int) -> DataFrame:
    """At most ``n`` values, as (value): those with the smallest distinct hashes ``by``, one for each hash.

    Only the hashes are sorted; values are filtered where they are. Repeated rows count once.
    """
    keyed = rows.select(by.alias("by"), value.alias("value"))
    last = keyed.select("by").distinct().orderBy("by").limit(n).agg(F.max("by")).first()[0]
    chosen = keyed.where(F.col("by") <= F.lit(last)) if last is not None else keyed.limit(0)
    return chosen.groupBy("by").agg(F.min("value").alias("value")).select("value").coalesce(1)
