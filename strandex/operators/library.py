"""Catalogue facets: current rows, text search, semi joins on likes and scores, order and pages."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandex.functions.expr import contains_any, phrase_in, tokens

TEXT = ("title", "artist", "album")


def current(tracks: DataFrame, include_missing: bool = False) -> DataFrame:
    return tracks if include_missing else tracks.where(F.col("missing_since").isNull())


def like_search(tracks: DataFrame, query: str, columns=(*TEXT, "year")) -> DataFrame:
    return tracks.where(contains_any([F.col(c) for c in columns], query)) if query.strip() else tracks


def token_search(tracks: DataFrame, query: str, columns=TEXT) -> DataFrame:
    """Every term must occur in some column, as a run of neighbouring words."""
    out = tracks
    for term in query.split():
        words = re.findall(r"[^\W_]+", term.lower())
        if words:
            hit = F.lit(False)
            for c in columns:
                hit = hit | phrase_in(tokens(F.col(c)), words)
            out = out.where(hit)
    return out


def syncopated(tracks: DataFrame, genres: DataFrame, key: str = "track_id") -> DataFrame:
    """Tracks with a genre that is flagged as syncopated; (key, syncopated 0 or 1) a genre."""
    return tracks.join(genres.where("syncopated = 1").select(key).distinct(), key, "left_semi")


def with_liked(tracks: DataFrame, likes: DataFrame) -> DataFrame:
    liked = likes.select("track_id").distinct().withColumn("liked", F.lit(True))
    return tracks.join(liked, "track_id", "left").withColumn("liked", F.coalesce("liked", F.lit(False)))


def liked_only(tracks: DataFrame, likes: DataFrame) -> DataFrame:
    return tracks.join(likes.select("track_id").distinct(), "track_id", "left_semi")


def min_scores(tracks: DataFrame, scores: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Tracks whose score reaches the limit for every key; the first key's score is kept."""
    out = tracks
    for i, (key, low) in enumerate(sorted(limits.items())):
        own = scores.where((F.col("classifier_key") == key) & (F.col("score") >= low))
        out = out.join(own.select("track_id", F.col("score").alias("primary_score")), "track_id") if i == 0 else out.join(own.select("track_id"), "track_id", "left_semi")
    return out


def library_order(has_score: bool = False) -> list:
    keys = [F.desc("liked")]
    if has_score:
        keys.append(F.desc("primary_score"))
    return [*keys, *[F.lower(F.coalesce(c, F.lit(""))).asc() for c in ("artist", "title")], F.col("track_id").asc()]


def page(rows: DataFrame, order: list, limit: int = 100, offset: int = 0) -> DataFrame:
    if offset < 0:
        raise ValueError("offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(max(1, min(500, limit)))


def keyset_page(rows: DataFrame, after: int, limit: int, key: str = "track_id") -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def select_in_order(rows: DataFrame, ids: list[int], key: str = "track_id") -> DataFrame:
    """Rows for the given ids in their order, repeats kept; an unknown id is an error."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"position int, {key} long")
    out = F.broadcast(wanted).join(rows, key, "left")
    probe = rows.select(F.col(key).alias("__known")).distinct()
    unknown = wanted.join(probe, F.col(key) == F.col("__known"), "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(f"unknown {key} {unknown[0][key]}")
    return out.orderBy("position")


def coverage(tracks: DataFrame, **tables: DataFrame) -> DataFrame:
    """A flag per table: whether it has a row for the track."""
    out = tracks
    for name, table in tables.items():
        out = out.join(table.select("track_id").distinct().withColumn(name, F.lit(True)), "track_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def missing_outputs(tracks: DataFrame, **tables: DataFrame) -> DataFrame:
    """Current tracks that lack a row in some table, with the names of those tables."""
    flags = coverage(current(tracks), **tables)
    lacking = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in tables]))
    return flags.withColumn("missing", lacking).where(F.size("missing") > 0).select("track_id", "missing")


def latest_per_key(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Old and new rows merged by key, with what happened to each: added, updated, unchanged or kept."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    values = [c for c in old.columns if c not in keys]
    in_a, in_b = F.col("a.__old").isNotNull(), F.col("b.__new").isNotNull()
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = old.withColumn("__old", F.lit(1)).alias("a").join(new.withColumn("__new", F.lit(1)).alias("b"), cond, "full_outer")
    action = F.when(~in_a, "added").when(~in_b, "kept").when(same, "unchanged").otherwise("updated")
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[F.when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in values], action.alias("action"))
