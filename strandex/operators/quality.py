"""Data checks: rules as predicates, orphans, duplicates; all findings in one table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(code, key) for every row and rule that does not hold, in one pass over the rows.

    A rule that is null (unknown) is not broken.
    """
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(code)) for code, rule in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("code")).select("code", "key")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, code: str) -> DataFrame:
    """Rows whose key is not among the parents'."""
    known = parents.select(F.col(parent_key).alias("__p")).distinct()
    return rows.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("__p"), "left_anti").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))


def duplicates(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1").select(F.lit(code).alias("code"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key"))


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def probabilities_valid(p: Column, tolerance: float = 1e-6) -> Column:
    """Whether a map of probabilities has finite values in [0, 1] that sum to one."""
    values = F.map_values(p)
    inside = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    return inside & (F.abs(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) - 1) <= tolerance)
