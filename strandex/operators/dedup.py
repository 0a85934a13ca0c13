"""Near-duplicate items: candidate pairs by bands and by hyperplane signatures, scores, groups, keepers."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions.expr import weighted_mean_available
from strandex.operators.graph import connected_components
from strandex.operators.vectors import dot
from strandex.runtime import stage


@dataclass(frozen=True)
class Preset:
    min_score: float
    min_similarity: float
    seconds: float
    ratio: float
    keeper_score: float
    strict_ratio: float


# fixed values: thresholds of the presets
PRESETS = {
    "safe": Preset(0.965, 0.985, 2, 0.01, 0.98, 0.01),
    "balanced": Preset(0.95, 0.97, 5, 0.025, 0.97, 0.025),
    "aggressive": Preset(0.925, 0.94, 15, 0.08, 0.965, 0.08),
}


def band_pairs(rows: DataFrame, key: str, value: str, width: float, group: list[str] = ()) -> DataFrame:
    """Pairs (a < b) whose values differ by at most ``width``: an equi-join on neighbouring bins of that width."""
    cols = [key, value, *group]
    binned = rows.where(F.col(value).isNotNull()).select(*cols, F.floor(F.col(value) / width).alias("bin"))
    a = binned.select(F.col(key).alias("a"), F.col(value).alias("va"), *group, "bin")
    b = binned.select(F.col(key).alias("b"), F.col(value).alias("vb"), *group, F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    return a.join(b, [*group, "bin"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= width)).select("a", "b", *group, "va", "vb")


CHUNK = 1024  # ids a row
LIGHT = 64  # pairs a row, up to which they are made where the row lies


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def _same(same: list[str], other: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{other}.{c}")) for c in same])


def item_classes(rows: DataFrame, key: str, same: list[str]) -> DataFrame:
    """(*same, first, last): items that agree in all columns ``same``, and their smallest and largest key."""
    return rows.where(F.col(key).isNotNull()).groupBy(*same).agg(F.min(key).alias("first"), F.max(key).alias("last"))


def class_chunks(rows: DataFrame, key: str, same: list[str], most: int = CHUNK) -> DataFrame:
    """(*same, chunk, ids): items that agree in all columns ``same``; a class of more than ``most`` is dealt into several rows."""
    rows = rows.where(F.col(key).isNotNull()).select(key, *same)
    large = rows.groupBy(*same).agg(F.ceil(F.count(F.lit(1)) / most).alias("pieces")).where("pieces > 1").select(F.struct(*same).alias("own"), "pieces")
    dealt = rows.join(large, _same(same, "own"), "left")
    chunk = F.coalesce(F.pmod(F.xxhash64(key), F.col("pieces")), F.lit(0))
    return dealt.groupBy(*same, chunk.alias("chunk")).agg(F.collect_list(key).alias("ids"))


def class_pairs(classes: DataFrame, on: list[str], unique: list[str], value: str | None = None, width: float = 0.0) -> DataFrame:
    """Pairs (x, y) of rows that agree in ``on``, each once and each row with itself; with ``value``, those that differ by ``width`` at most.

    ``unique`` tells rows apart.
    """
    row, keys = F.struct(*classes.columns), list(on)
    a, b = classes.select(*on, row.alias("x")), classes.select(*on, row.alias("y"))
    if value is not None:
        at = lambda side: F.floor(F.col(f"{side}.{value}") / width)
        a, b = a.where(F.col(f"x.{value}").isNotNull()).withColumn("bin", at("x")), b.where(F.col(f"y.{value}").isNotNull())
        b, keys = b.withColumn("bin", F.explode(F.array(at("y") - 1, at("y"), at("y") + 1))), [*on, "bin"]
    order = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in unique])
    j = a.repartition(_tasks(a), *keys).join(b.hint("merge"), keys).where(order("x") <= order("y"))
    return (j if value is None else j.where(F.abs(F.col(f"x.{value}") - F.col(f"y.{value}")) <= width)).select("x", "y")


def item_pairs(pairs: DataFrame, *keep: Column) -> DataFrame:
    """(a, b, *keep): the pairs a < b of items of two chunks, from pairs (x, y) of :func:`class_chunks`.

    What depends on the classes is worked out once a pair of chunks, not once a pair of items. Rows that
    make many pairs are spread over the tasks first. A chunk is told by all its columns but ``ids``: the
    two sides may be made apart, and a shuffle brings the ids in any order.
    """
    within = reduce(lambda x, y: x & y, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in pairs.schema["x"].dataType.names if c != "ids"])
    small = pairs.select(F.col("x.ids").alias("left"), F.col("y.ids").alias("right"), within.alias("within"), *keep)
    names = small.columns[3:]
    many = F.size("left") * F.size("right")

    def expand(rows: DataFrame) -> DataFrame:
        out = rows.select(F.explode("left").alias("i"), "right", "within", *names).select("i", F.explode("right").alias("j"), "within", *names)
        return out.where((F.col("i") < F.col("j")) | (~F.col("within") & (F.col("i") > F.col("j")))).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), *names)

    return expand(small.where(many <= LIGHT)).unionAll(expand(small.where(many > LIGHT).repartition(_tasks(pairs), "left", "right")))


def linked_classes(pairs: DataFrame) -> DataFrame:
    """Those pairs (x, y) of :func:`item_classes` that hold two different items."""
    return pairs.where(F.least("x.first", "y.first") < F.greatest("x.last", "y.last"))


def class_groups(rows: DataFrame, key: str, same: list[str], links: DataFrame) -> DataFrame:
    """(key, group_id) of the items in some group, named by the group's smallest item.

    ``links`` has pairs (x, y) of classes whose items are all linked, a class of several items with itself
    among them. Components are closed over classes; an item that is in several ties them together.
    """
    linked = links.select(F.explode(F.array("x", "y")).alias("own")).distinct()
    members = stage(rows.join(linked, _same(same, "own")).select(key, F.col("own.first").alias("first")).distinct(), "members")
    shared = members.groupBy(key).agg(F.collect_set("first").alias("all")).where(F.size("all") > 1)
    ties = shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    closed = connected_components(links.select(F.col("x.first").alias("a"), F.col("y.first").alias("b")).unionAll(ties), "a", "b")
    named = members.join(closed, F.col("first") == F.col("node"), "left")
    return named.groupBy(key).agg(F.min(F.coalesce("component", "first")).alias("group_id"))


def hyperplane(dim: int, plane: int) -> list[float]:
    """A fixed direction per number, from a sine rule, so that every run draws the same planes."""
    return [math.sin(12.9898 * (plane + 1) + 78.233 * (i + 1) * (plane + 1)) for i in range(dim)]


def signatures(rows: DataFrame, key: str, v: str, dim: int, bands: int = 8, bits: int = 12) -> DataFrame:
    """(key, band, code): which side of the planes a vector lies on, ``bits`` planes a band."""
    codes = []
    for band in range(bands):
        sides = [F.when(dot(F.col(v), F.array(*[F.lit(x) for x in hyperplane(dim, band * bits + j)])) >= 0, F.lit(1 << j)).otherwise(0) for j in range(bits)]
        total = sides[0]
        for s in sides[1:]:
            total = total + s
        codes.append(F.struct(F.lit(band).alias("band"), total.alias("code")))
    return rows.select(key, F.explode(F.array(*codes)).alias("s")).select(key, "s.band", "s.code")


def signature_pairs(sig: DataFrame, key: str) -> DataFrame:
    """Pairs (a < b) that share a band's code."""
    a = sig.select(F.col(key).alias("a"), "band", "code")
    b = sig.select(F.col(key).alias("b"), "band", "code")
    return a.join(b, ["band", "code"]).where("a < b").select("a", "b").distinct()


def gap_similarity(a: Column, b: Column, caps: float) -> Column:
    return 1 - F.least(F.abs(a - b), F.lit(caps)) / caps


def pair_score(terms: list[tuple[Column, float]]) -> Column:
    return weighted_mean_available(terms)


def confidence(score: Column, min_score: float) -> Column:
    return F.when(score >= max(0.98, min_score), "high").when(score >= max(0.94, min_score), "medium").otherwise("low")


def groups(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, group_id) of the items in some group, named by the group's smallest item."""
    return connected_components(edges, "a", "b").select(F.col("node").alias(key), F.col("component").alias("group_id"))


def keepers(members: DataFrame, key: str, *order) -> DataFrame:
    """(group_id, keeper, members): the first item of each group by the given order."""
    return members.groupBy("group_id").agg(F.min_by(key, F.struct(*order)).alias("keeper"), F.count(F.lit(1)).alias("members"))


def report_statistics(candidates: DataFrame, groups: DataFrame, key: str = "id") -> DataFrame:
    """One row: candidates, distinct items, safe ones and others, and groups by confidence.

    ``candidates`` has (key, safe), ``groups`` one row a group with its confidence.
    """
    safe = F.coalesce(F.col("safe"), F.lit(False))
    c = candidates.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_distinct(key).alias("duplicate_count"), F.count(F.when(safe, 1)).alias("safe_count"), F.count(F.when(~safe, 1)).alias("review_count"))
    g = groups.agg(*[F.count(F.when(F.col("confidence") == n, 1)).alias(f"{n}_groups") for n in ("high", "medium", "review")])
    return c.crossJoin(F.broadcast(g))


def safe_candidates(members: DataFrame, chosen: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Members other than the keeper, safe only where a direct edge leads to the keeper."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("direct", F.lit(True))
    j = members.join(chosen.select("group_id", "keeper"), "group_id").where(F.col(key) != F.col("keeper"))
    j = j.join(both, (F.col(key) == F.col("a")) & (F.col("keeper") == F.col("b")), "left")
    return j.select("group_id", key, "keeper", F.coalesce("direct", F.lit(False)).alias("safe"))


def scored_candidates(members: DataFrame, chosen: DataFrame, key: str, direct) -> DataFrame:
    """:func:`safe_candidates` without an edge table: ``direct(x, y)`` tells whether two rows of ``members`` have an edge.

    One row an item; where rows repeat a key, any of them will do.
    """
    row = F.struct(*[c for c in members.columns if c != "group_id"])
    own = members.select("group_id", row.alias("x")).join(chosen.select("group_id", "keeper"), "group_id").where(F.col(f"x.{key}") != F.col("keeper"))
    kept = members.select(F.col(key).alias("keeper"), row.alias("y")).join(chosen.select("keeper"), "keeper", "left_semi")
    safe = F.max(F.coalesce(direct("x", "y"), F.lit(False)))
    return own.join(kept, "keeper").groupBy("group_id", F.col(f"x.{key}").alias(key), "keeper").agg(safe.alias("safe"))
