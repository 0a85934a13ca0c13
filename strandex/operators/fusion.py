"""Rank fusion, agreement between rankings, and normalisations over ranked lists."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.operators.ranks import numbered
from strandex.runtime import fresh

RRF_K = 60


def weight_of(weights: Mapping[str, float], source: Column) -> Column:
    return F.coalesce(*[F.when(source == s, F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))


def rrf(ranked: DataFrame, keys: list[str], k: int = RRF_K, weights: Mapping[str, float] | None = None, renormalise: bool = False) -> DataFrame:
    """Reciprocal rank fusion. A source that lacks a candidate adds nothing; ``renormalise`` divides by the weights present."""
    w = weight_of(weights, F.col("source")) if weights else F.lit(1.0)
    rows = ranked.withColumn("__w", w).withColumn("__c", F.col("__w") / (k + F.col("rank")))
    out = rows.groupBy(*keys).agg(F.sum("__c").alias("score"), F.sum("__w").alias("weight"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("source_count"))
    return out.withColumn("score", F.when(F.col("weight") > 0, F.col("score") / F.col("weight")).otherwise(0.0)) if renormalise else out


def ranked_by(rows: DataFrame, by: list[str], *order, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def max_normalised(score: Column, by: list[str]) -> Column:
    top = F.max(score).over(Window.partitionBy(*by))
    return F.when(top > 0, score / top).otherwise(0.0)


def minmax_normalised(x: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, 1.0).otherwise((x - low) / (high - low))


def rank_percentile(by: list[str], *order) -> Column:
    """1 for the first, 0 for the last, 1 for a list of one."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    return F.when(n == 1, 1.0).otherwise(1 - (F.row_number().over(w.orderBy(*order)) - 1) / (n - 1))


def average_rank(by: list[str], order) -> Column:
    """Ties share the mean of their ranks."""
    w = Window.partitionBy(*by)
    peers = F.count(F.lit(1)).over(w.orderBy(order).rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w.orderBy(order)) + (peers - 1) / 2


def with_average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the mean rank of their value in a column, over the whole table; counted by value first."""
    value, upto, n = fresh(rows, "__value"), fresh(rows, "__upto"), fresh(rows, "__n")
    levels = rows.groupBy(F.col(column).alias(value)).agg(F.count(F.lit(1)).alias(n))
    ranks = numbered(levels, [F.col(value)], fresh(rows, "__level"), {upto: n}).select(value, (F.col(upto) - (F.col(n) - 1) / 2).alias(name))
    return rows.join(ranks, F.col(column).eqNullSafe(F.col(value))).drop(value)


def seed_consensus(ranked: DataFrame, top_k: int, seed: str = "seed", item: str = "vec_id") -> DataFrame:
    """(seed, sources_seen, items): the first ``top_k`` of each seed by unweighted rank fusion, in order."""
    fused = rrf(ranked, [seed, item])
    first = ranked_by(fused, [seed], F.desc(F.round("score", 12)), "best_rank", item).where(F.col("rank") <= top_k)
    lists = first.groupBy(seed).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias("items"))
    return lists.join(ranked.groupBy(seed).agg(F.array_sort(F.collect_set("source")).alias("sources_seen")), seed)


def recommended_weights(per_source: DataFrame) -> DataFrame:
    """(source, weight) from (source, coverage, consensus, stability): their product, as a share of all sources'.

    A source alone counts as in consensus with itself; where all products are 0, consensus is left out.
    Sources are a handful.
    """
    facts = per_source.agg(F.count(F.lit(1)).alias("__n"), F.sum(F.greatest(F.lit(0.0), F.col("coverage") * F.col("consensus") * F.col("stability"))).alias("__sum"))
    rows = per_source.crossJoin(F.broadcast(facts))
    alone = (F.col("__n") == 1) & (F.col("coverage") > 0)
    full = F.greatest(F.lit(0.0), F.col("coverage") * F.when(alone, 1.0).otherwise(F.col("consensus")) * F.col("stability"))
    plain = F.greatest(F.lit(0.0), F.col("coverage") * F.col("stability"))
    rows = rows.select("source", F.when((F.col("__sum") > 0) | alone, full).otherwise(plain).alias("__raw"))
    total = rows.agg(F.sum("__raw").alias("__total"))
    return rows.crossJoin(F.broadcast(total)).select("source", F.when(F.col("__total") > 0, F.col("__raw") / F.col("__total")).otherwise(0.0).alias("weight"))


def agreement(ranked: DataFrame, k: int = 10, seed: str = "seed", item: str = "vec_id") -> DataFrame:
    """Per pair of sources: overlap and Jaccard of the first k, and rank correlation, averaged over seeds."""
    top = ranked.where(F.col("rank") <= k)
    sets = top.groupBy(seed, "source").agg(F.collect_set(item).alias("ids"))  # k ids at most
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col(f"a.{seed}") == F.col(f"b.{seed}")) & (F.col("a.source") < F.col("b.source")))
    both = F.size(F.array_intersect("a.ids", "b.ids"))
    per_seed = pairs.select(F.col("a.source").alias("left"), F.col("b.source").alias("right"), both.alias("overlap"), (both / F.size(F.array_union("a.ids", "b.ids"))).alias("jaccard"))
    sizes = per_seed.groupBy("left", "right").agg(F.avg("overlap").alias("overlap"), F.avg("jaccard").alias("jaccard"))
    l, r = ranked.alias("l"), ranked.alias("r")
    shared = l.join(r, (F.col(f"l.{seed}") == F.col(f"r.{seed}")) & (F.col(f"l.{item}") == F.col(f"r.{item}")) & (F.col("l.source") < F.col("r.source")))
    corr = shared.groupBy(F.col(f"l.{seed}").alias(seed), F.col("l.source").alias("left"), F.col("r.source").alias("right"))
    corr = corr.agg(pearson(F.col("l.rank"), F.col("r.rank")).alias("c")).groupBy("left", "right").agg(F.avg("c").alias("correlation"))
    return sizes.join(corr, ["left", "right"], "left")


def pearson(x: Column, y: Column) -> Column:
    """Correlation of a group; null for fewer than two rows or no spread."""
    n = F.count(F.lit(1))
    sx, sy, sxy = F.sum(x.cast("double")), F.sum(y.cast("double")), F.sum((x * y).cast("double"))
    vx, vy = n * F.sum((x * x).cast("double")) - sx * sx, n * F.sum((y * y).cast("double")) - sy * sy
    return F.when((n >= 2) & (vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def reciprocal_support(ranked: DataFrame, k: int = 10, seed: str = "seed", item: str = "vec_id") -> DataFrame:
    """Per source: how highly the other sources rank its first k, as a mean of reciprocal ranks."""
    sources = ranked.select(F.col("source").alias("other")).distinct()
    top = ranked.where(F.col("rank") <= k).select(seed, "source", item)
    need = top.crossJoin(F.broadcast(sources)).where("source <> other")
    have = ranked.where(F.col("rank") <= k).select(seed, F.col("source").alias("other"), item, F.col("rank").alias("r"))
    per = need.join(have, [seed, "other", item], "left").groupBy(seed, "source", item).agg(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("s"))
    return per.groupBy("source").agg(F.avg("s").alias("support"))


def simplex(names: list[str], step: float) -> list[dict[str, float]]:
    """All weightings in multiples of ``step`` that sum to one."""
    n = round(1 / step)
    return [dict(zip(names, (c / n for c in combo), strict=True)) for combo in product(range(n + 1), repeat=len(names)) if sum(combo) == n]


def subsets(names: list[str]) -> list[tuple[str, ...]]:
    """All non-empty subsets, in the order of the names."""
    return [tuple(n for i, n in enumerate(names) if mask >> i & 1) for mask in range(1, 1 << len(names))]
