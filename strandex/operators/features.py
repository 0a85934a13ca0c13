"""Missing-aware feature similarity between items."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions import expr as X

MODIFIER_GAIN = 2.5


def ranges(rows: DataFrame, fields: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row: the 2nd and 98th percentile of each field, or its extremes where these meet.

    A field with fewer than two values gets nulls. Percentiles are exact and interpolated.
    """
    cols = []
    for f in fields:
        p = F.percentile(f, F.array(F.lit(low), F.lit(high)))
        wide, enough = p[1] > p[0], F.count(f) >= 2
        cols += [F.when(enough, F.when(wide, p[0]).otherwise(F.min(f))).alias(f"{f}_lo"), F.when(enough, F.when(wide, p[1]).otherwise(F.max(f))).alias(f"{f}_hi")]
    return rows.agg(*cols)


def scaled(rows: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """Fields as positions within their ranges."""
    j = rows.crossJoin(F.broadcast(ranges(rows, fields)))
    return j.select(*keep, *[X.normalise(F.col(f), F.col(f"{f}_lo"), F.col(f"{f}_hi")).alias(f) for f in fields])


def feature_search(rows: DataFrame, seeds: DataFrame, weights: Mapping[str, float], key: str = "track_id", min_overlap: int = 2) -> DataFrame:
    """Weighted mean of 1 - |z - centre| over the fields both sides have; at least two must meet."""
    fields = list(weights)
    z = scaled(rows, fields, [key])
    chosen = F.broadcast(seeds.select(key).distinct())
    centre = z.join(chosen, key, "left_semi").agg(*[F.avg(f).alias(f"{f}_c") for f in fields])
    terms = [(1 - F.abs(F.col(f) - F.col(f"{f}_c")), w) for f, w in weights.items()]
    rest = z.join(chosen, key, "left_anti").crossJoin(F.broadcast(centre))
    out = rest.select(key, X.weighted_mean_available(terms).alias("score"), X.present([t for t, _ in terms]).alias("overlap"))
    return out.where(F.col("overlap") >= min_overlap)


def mixer_search(rows: DataFrame, seeds: DataFrame, groups: Mapping[str, Mapping[str, float]], mixer: Mapping[str, float], modifiers: Mapping[str, float], key: str = "track_id") -> DataFrame:
    """Groups of fields by mixer weight, and fields wanted higher or lower than the seeds.

    A modified field leaves its group. Mixer weights are clamped to 0..5, modifiers to -1..1; a mixer
    given at all leaves out the groups it does not name.
    """
    unknown = (set(mixer) - set(groups)) or (set(modifiers) - {f for g in groups.values() for f in g})
    if unknown:
        raise ValueError(f"unknown {sorted(unknown)}")
    mixer = {g: min(5.0, max(0.0, w)) for g, w in mixer.items()}
    modifiers = {f: min(1.0, max(-1.0, d)) for f, d in modifiers.items() if d}
    weights = {f: w * mixer.get(g, 0.0) for g, fields in groups.items() for f, w in fields.items() if f not in modifiers}
    weights = {f: w for f, w in weights.items() if w > 0}
    fields = [*weights, *modifiers]
    z = scaled(rows, fields, [key])
    chosen = F.broadcast(seeds.select(key).distinct())
    centre = z.join(chosen, key, "left_semi").agg(*[F.avg(f).alias(f"{f}_c") for f in fields])
    terms = [(1 - F.abs(F.col(f) - F.col(f"{f}_c")), w) for f, w in weights.items()]
    for f, d in modifiers.items():
        sign = 1.0 if d > 0 else -1.0
        terms.append((X.clamp01(0.5 + sign * (F.col(f) - F.col(f"{f}_c")) / 2), abs(d) * MODIFIER_GAIN))
    rest = z.join(chosen, key, "left_anti").crossJoin(F.broadcast(centre))
    return rest.select(key, X.weighted_mean_available(terms).alias("score")).where(F.col("score").isNotNull())


def seed_averages(rows: DataFrame, seeds: DataFrame, pair_score: Column, key: str = "track_id") -> DataFrame:
    """Mean over seeds of a score of (candidate, seed_*) columns; seeds are a handful and broadcast."""
    s = seeds.select(*[F.col(c).alias(f"seed_{c}") for c in seeds.columns])
    pairs = rows.join(F.broadcast(s.select(f"seed_{key}")), F.col(key) == F.col(f"seed_{key}"), "left_anti").crossJoin(F.broadcast(s))
    return pairs.withColumn("__s", pair_score).groupBy(key).agg(F.avg("__s").alias("score"))


def modes(rows: DataFrame, column: str) -> DataFrame:
    """All most frequent values, ties kept."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).count()
    top = counts.agg(F.max("count").alias("top"))
    return counts.crossJoin(F.broadcast(top)).where("count = top").select(column)
