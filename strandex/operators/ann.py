"""Approximate nearest neighbours: a saved signature index, fail-closed search, recall against exact."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandex.operators.dedup import signatures
from strandex.operators.vectors import dot, nearest


@dataclass(frozen=True)
class IndexSpec:
    dim: int
    bands: int = 32
    bits: int = 4


def snapshot(items: DataFrame, key: str = "vec_id", v: str = "v") -> str:
    """A digest of all ids and vectors that does not depend on their order."""
    row = F.xxhash64(F.col(key), F.col(v))
    n, total, mixed = items.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return f"{n}:{total}:{mixed}"


def build(items: DataFrame, spec: IndexSpec, path: str, key: str = "vec_id") -> None:
    """Write the signature table, bucketed by band in files, and a manifest next to it."""
    signatures(items, key, "v", spec.dim, spec.bands, spec.bits).write.mode("overwrite").partitionBy("band").parquet(f"{path}/signatures")
    manifest = json.dumps(asdict(spec) | {"snapshot": snapshot(items, key)})
    items.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(items: DataFrame, path: str, key: str = "vec_id") -> tuple[DataFrame, IndexSpec]:
    """The index, refused if the items differ from those it was built from."""
    spark = items.sparkSession
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.pop("snapshot") != snapshot(items, key):
        raise ValueError("the index is stale: items have changed")
    return spark.read.parquet(f"{path}/signatures"), IndexSpec(**manifest)


def search(items: DataFrame, index: DataFrame, spec: IndexSpec, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(query, key, score, rank): neighbours that share a band's code, ranked by exact cosine."""
    q = queries.select(F.col(key).alias("query"), F.col("v").alias("qv"))
    codes = signatures(q, "query", "qv", spec.dim, spec.bands, spec.bits)
    met = codes.join(index, ["band", "code"]).where(F.col("query") != F.col(key)).select("query", key).distinct()
    scored = met.join(items.select(key, "v"), key).join(q, "query").select("query", key, dot(F.col("v"), F.col("qv")).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The same by comparing every query with every item, in blocks."""
    return nearest(items, queries, k, key)


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query, recall): the share of the exact neighbours that were found."""
    hit = found.select("query", key, F.lit(1).alias("hit"))
    return truth.join(hit, ["query", key], "left").groupBy("query").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
