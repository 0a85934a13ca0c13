"""Exact vector search: dot products, centroids, filters, ranked results, and neighbours of many queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions.expr import hash_unit


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    return F.transform(v, lambda x: x / norm(v))


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


MAX_BANK = 256
ITEM_BLOCK, QUERY_BLOCK = 4096, 1024


def _blocks(rows: DataFrame, key: str, size: int, prefix: str) -> DataFrame:
    """Rows of up to ``size`` vectors each, scaled to length 1: ids and one matrix as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                some = batch.iloc[at : at + size]
                matrix = np.stack(some["v"].to_numpy()).astype(np.float64)
                size_of = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                matrix /= np.where(size_of > 0, size_of, 1.0)
                yield pd.DataFrame({f"{prefix}_ids": [some[key].to_numpy(np.int64).tobytes()], f"{prefix}_matrix": [matrix.tobytes()]})

    return rows.select(key, "v").mapInPandas(pack, f"{prefix}_ids binary, {prefix}_matrix binary")


def nearest(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(query, key, score, rank): the ``k`` items with the largest cosine to each query, itself left out.

    Every query meets every item, block by block: one matrix product for each pair of blocks, of which
    only the best ``k`` a query leave the task. So a table of n items and q queries moves n * q / 1024
    vectors and k * q * n / 4096 results, and no task holds more than two blocks.
    """

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, matrix, wanted, asked in zip(batch["i_ids"], batch["i_matrix"], batch["q_ids"], batch["q_matrix"], strict=True):
                ids, wanted = np.frombuffer(ids, np.int64), np.frombuffer(wanted, np.int64)
                scores = np.frombuffer(asked).reshape(len(wanted), -1) @ np.frombuffer(matrix).reshape(len(ids), -1).T
                scores[wanted[:, None] == ids] = -np.inf
                rounded = np.round(scores, 9)
                least = np.partition(rounded, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(wanted), -2.0)
                row, col = np.nonzero((rounded >= least[:, None]) & np.isfinite(scores))
                order = np.lexsort((ids[col], -rounded[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, np.arange(len(wanted)))
                best = np.arange(len(row)) - first[row] < k
                yield pd.DataFrame({"query": wanted[row[best]], key: ids[col[best]], "score": scores[row[best], col[best]]})

    pairs = _blocks(items, key, ITEM_BLOCK, "i").crossJoin(_blocks(queries, key, QUERY_BLOCK, "q"))
    scored = pairs.mapInPandas(multiply, f"query long, `{key}` long, score double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class SearchFilters:
    """Options of a ranked search, checked before a plan is built."""

    limit: int | None = 50
    min_similarity: float | None = None
    epsilon: float | None = None
    noise: float = 0.0

    def __post_init__(self):
        if self.limit is not None and not 1 <= self.limit <= 500:
            raise ValueError("limit must be from 1 to 500")
        if self.epsilon is not None and self.epsilon < 0:
            raise ValueError("epsilon must not be negative")
        if not 0 <= self.noise <= 1:
            raise ValueError("noise must be from 0 to 1")


def centroid(vectors: DataFrame, by: list[str] = (), v: str = "v") -> DataFrame:
    """Mean vector, scaled to length 1, of each group (or of all rows)."""
    cells = vectors.select(*by, F.posexplode(v).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    packed = cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("mean"))
    return packed.select(*by, normalise(F.col("mean")).alias("centroid"))


def valid_vectors(vectors: DataFrame, dim: int, v: str = "v", rtol: float = 1e-4, atol: float = 1e-5) -> Column:
    """Whether a vector has the right size, finite values and length 1."""
    c = F.col(v)
    return F.coalesce((F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.abs(norm(c) - 1) <= atol + rtol), F.lit(False))


def rank_scores(scored: DataFrame, filters: SearchFilters, key: str = "vec_id", score: str = "score", salt: str = "catalog") -> DataFrame:
    """Threshold, band below the best, jittered order, rank. The reported score stays as it is.

    Without a limit all rows are returned, neither ordered nor ranked, so that no task gets all of them.
    """
    out = scored
    if filters.min_similarity is not None:
        out = out.where(F.col(score) >= filters.min_similarity)
    if filters.epsilon is not None:
        best = out.agg(F.max(score).alias("best"))
        out = out.crossJoin(F.broadcast(best)).where(F.col(score) >= F.col("best") - filters.epsilon).drop("best")
    if filters.limit is None:
        return out
    order = F.col(score)
    if filters.noise:
        order = order + (hash_unit(F.lit(salt), F.col(key)) - 0.5) * filters.noise
    top = out.withColumn("order_score", F.round(order, 9)).orderBy(F.desc("order_score"), key).limit(filters.limit)
    w = Window.orderBy(F.desc("order_score"), key)  # over the limited rows only
    return top.withColumn("rank", F.row_number().over(w)).drop("order_score")


def search_vector(items: DataFrame, query: Column, filters: SearchFilters, exclude: DataFrame | None = None, candidates: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """Items nearest to a query vector by cosine of unit vectors."""
    rows = items
    if candidates is not None:
        rows = rows.join(candidates.select(key).distinct(), key, "left_semi")
    if exclude is not None:
        rows = rows.join(exclude.select(key).distinct(), key, "left_anti")
    return rank_scores(rows.select(key, dot(F.col("v"), query).alias("score")), filters, key)


def seed_search(items: DataFrame, seeds: DataFrame, filters: SearchFilters, candidates: DataFrame | None = None, key: str = "vec_id") -> DataFrame:
    """Items nearest to the centroid of seeds; one to five distinct seeds, never returned."""
    if not 1 <= seeds.select(key).distinct().limit(6).count() <= 5:
        raise ValueError("one to five distinct seeds are needed")
    chosen = items.join(F.broadcast(seeds.select(key).distinct()), key, "left_semi")
    middle = centroid(chosen)
    rows = items.join(F.broadcast(seeds.select(key).distinct()), key, "left_anti")
    if candidates is not None:
        rows = rows.join(candidates.select(key).distinct(), key, "left_semi")
    scored = rows.crossJoin(F.broadcast(middle)).select(key, dot(F.col("v"), F.col("centroid")).alias("score"))
    return rank_scores(scored, filters, key)


def contrast_scores(items: DataFrame, positive: DataFrame, negative: DataFrame, weight: float = 0.5, key: str = "vec_id") -> DataFrame:
    """Cosine to the positive centroid less a weighted mean of the two largest cosines to negatives."""
    if weight < 0:
        raise ValueError("weight must not be negative")
    if negative.limit(MAX_BANK + 1).count() > MAX_BANK:
        raise ValueError(f"a negative bank holds {MAX_BANK} vectors at most")
    bank = negative.agg(F.collect_list("v").alias("bank"))
    rows = items.crossJoin(F.broadcast(centroid(positive))).crossJoin(F.broadcast(bank))
    sims = F.slice(F.sort_array(F.transform("bank", lambda n: dot(F.col("v"), n)), asc=False), 1, 2)
    worst = F.aggregate(sims, F.lit(0.0), lambda s, x: s + x) / F.size(sims)
    out = rows.select(key, dot(F.col("v"), F.col("centroid")).alias("positive"), worst.alias("negative"))
    return out.withColumn("score", F.col("positive") - weight * F.coalesce("negative", F.lit(0.0)))


def centred(items: DataFrame, key: str = "vec_id") -> DataFrame:
    """Vectors less the mean of all, scaled to length 1."""
    cells = items.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    mean = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("mean"))
    return items.crossJoin(F.broadcast(mean)).select(key, normalise(F.zip_with("v", "mean", lambda a, b: a - b)).alias("v"))
