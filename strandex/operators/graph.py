"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.runtime import drop_staged, stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach: (node, component).

    Alternates large-star and small-star steps, which finish in a logarithmic number of rounds even
    on long chains. Each round is staged in the shared folder, so the lineage stays short. Self
    loops and edges with a null end are ignored; repeated edges count once.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    cur = stage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is tied to the smallest neighbour of u
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        nxt = stage(small.where("u <> v").distinct(), "cc")
        mark = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_staged(cur)
        cur = nxt
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = members.select(F.col("component").alias("node"), "component").distinct()
    return members.unionAll(roots)
