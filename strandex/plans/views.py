"""The engine's tables as views over the test tables, in DataFrame form and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    return F.round(x, 6)


def tracks(spark, sf):
    p = read(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("track_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        F.col("p_retailprice").alias("duration"),
        (1950 + F.col("p_size")).alias("year"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit("gone")).alias("missing_since"),
    )


TRACKS = "tracks AS (SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist, p_type AS album, p_retailprice AS duration, 1950 + p_size AS year, CASE WHEN p_partkey % 11 = 0 THEN 'gone' END AS missing_since FROM part)"


def likes(spark, sf):
    return read(spark, sf, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("track_id"), (F.col("p_partkey") % 13).alias("liked_at"))


LIKES = "likes AS (SELECT p_partkey AS track_id, p_partkey % 13 AS liked_at FROM part WHERE p_partkey % 7 = 0)"


def classifier_scores(spark, sf):
    """Two classifier keys over parts; some parts have no score for one of them."""
    p = read(spark, sf, "part")
    groove = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("track_id"), F.lit("groove").alias("classifier_key"), (F.col("p_size") / 50).alias("score"))
    voice = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("track_id"), F.lit("voice").alias("classifier_key"), ((F.col("p_partkey") % 101) / 100).alias("score"))
    return groove.unionAll(voice)


CLASSIFIER = "cls AS (SELECT p_partkey AS track_id, 'groove' AS classifier_key, p_size / 50 AS score FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'voice', (p_partkey % 101) / 100 FROM part WHERE p_partkey % 3 <> 0)"


def embeddings(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


EMB = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def features(spark, sf):
    """Scalar features per part, from its order lines; some are missing by rule."""
    l = read(spark, sf, "lineitem").groupBy("l_partkey").agg(*[r6(F.avg(F.col(c))).alias(a) for c, a in (("l_quantity", "quantity"), ("l_discount", "discount"), ("l_tax", "tax"), ("l_extendedprice", "price"))])
    p = read(spark, sf, "part")
    j = p.join(l, p.p_partkey == l.l_partkey, "left")
    k = F.col("p_partkey")
    return j.select(
        k.alias("track_id"),
        F.when(k % 5 != 0, 70.0 + F.col("p_size") * 2).alias("bpm"),
        F.when(k % 6 != 0, F.concat((k % 12 + 1).cast("string"), F.when(k % 2 == 0, "A").otherwise("B"))).alias("key"),
        F.when(k % 9 != 0, F.col("discount") * 10).alias("key_confidence"),
        F.when(k % 8 != 0, F.col("discount") * 10).alias("bpm_confidence"),
        (F.col("quantity") / 50).alias("energy"),
        F.when(k % 7 != 0, F.col("discount") * 10).alias("dance"),
        (F.col("tax") * 12).alias("valence"),
        F.col("price").alias("loudness"),
        F.when(k % 4 != 0, F.col("quantity")).alias("density"),
    )


FEATURES = """li AS (SELECT l_partkey, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax, round(avg(l_extendedprice), 6) AS price FROM lineitem GROUP BY l_partkey),
feat AS (SELECT p_partkey AS track_id, CASE WHEN p_partkey % 5 <> 0 THEN 70.0::DOUBLE + p_size * 2 END AS bpm,
  CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey % 12 + 1)::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END END AS key,
  CASE WHEN p_partkey % 9 <> 0 THEN discount * 10 END AS key_confidence, CASE WHEN p_partkey % 8 <> 0 THEN discount * 10 END AS bpm_confidence,
  quantity / 50 AS energy, CASE WHEN p_partkey % 7 <> 0 THEN discount * 10 END AS dance, tax * 12 AS valence, price AS loudness,
  CASE WHEN p_partkey % 4 <> 0 THEN quantity END AS density FROM part LEFT JOIN li ON p_partkey = l_partkey)"""


def sessions(spark, sf):
    """Ranked results per customer, with a rating from 0 to 3."""
    o = read(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    pr = F.col("o_orderpriority")
    rating = F.when(pr == "1-URGENT", 3).when(pr == "2-HIGH", 2).when(pr == "3-MEDIUM", 1).otherwise(0)
    return o.withColumn("rank", F.row_number().over(w)).select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("item_id"), "rank", rating.alias("rel"), F.col("o_orderstatus").alias("mode"), F.col("o_totalprice").alias("total"))


SESSIONS = """sess AS (SELECT o_custkey AS session_id, o_orderkey AS item_id, rank, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS rel, o_orderstatus AS mode, o_totalprice AS total
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders))"""


def predictions(spark, sf):
    """Predicted probability and true label per labelled document."""
    d, l = read(spark, sf, "documents").select("doc_id", "n_chars", "source"), read(spark, sf, "labels")
    return d.join(l, "doc_id").select("doc_id", "source", F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("p"), F.col("quality").alias("y"), "toxic")


PRED = "pred AS (SELECT doc_id, source, least(1.0::DOUBLE, n_chars / 20000) AS p, quality AS y, toxic FROM documents JOIN labels USING (doc_id))"


def sources(spark, sf):
    """Three rankings of the nearest 20 vectors for every seed (ids divisible by 50), by whole and half vectors.

    They are made block by block and staged once, so what reads them several times does not make them again.
    """
    from strandex.operators import vectors
    from strandex.runtime import stage

    e = embeddings(spark, sf)
    halves = {"full": F.col("v"), "left": F.slice("v", 1, 32), "right": F.slice("v", 33, 32)}
    parts = []
    for name, v in halves.items():
        own = e.select("vec_id", v.alias("v"))
        near = vectors.nearest(own, own.where("vec_id % 50 = 0"), 20)
        parts.append(near.select(F.col("query").alias("seed"), F.lit(name).alias("source"), "vec_id", "rank", "score"))
    return stage(parts[0].unionAll(parts[1]).unionAll(parts[2]), "sources")


SOURCES = """emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
half AS (SELECT vec_id, 'full' AS source, v FROM emb UNION ALL SELECT vec_id, 'left', v[1:32] FROM emb UNION ALL SELECT vec_id, 'right', v[33:64] FROM emb),
nv AS (SELECT vec_id, source, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM half),
src AS (SELECT seed, source, vec_id, rank, score FROM (SELECT s.vec_id AS seed, n.source, n.vec_id, list_dot_product(n.v, s.v) AS score,
  row_number() OVER (PARTITION BY s.vec_id, n.source ORDER BY round(list_dot_product(n.v, s.v), 9) DESC, n.vec_id) AS rank
  FROM nv n JOIN nv s ON n.source = s.source AND s.vec_id % 50 = 0 AND n.vec_id <> s.vec_id) WHERE rank <= 20)"""
