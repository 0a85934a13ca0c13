"""Remaining rules: explanation tags, structure fit, label rankings, windows over a duration, profile re-ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandex.functions import expr as X
from strandex.operators import fusion
from strandex.plans.base import registrar
from strandex.plans.views import FEATURES, SESSIONS, SOURCES, features, r6, read, sessions, sources

QUERIES, ORACLES, query = registrar()

# fixed values: which way each tag points on which axis
TAG_AXES = {
    "good_groove": ("groove", "high"), "good_density": ("density", "high"), "bad_density": ("density", "low"), "good_texture": ("texture", "high"),
    "wrong_texture": ("texture", "low"), "good_mood": ("mood", "high"), "good_tonal": ("tonal", "high"), "bad_tonal": ("tonal", "low"),
    "too_vocal": ("vocalness", "low"), "wrong_energy": ("energy_flow", "low"), "interesting_adjacent": ("novelty", "high"), "too_obvious": ("novelty", "low"),
}


def tag_agreement(tagged, value, tag):
    """Whether a value confirms a tag: high from 0.55, low to 0.45; what lies between says nothing."""
    side = F.coalesce(*[F.when(tag == t, F.lit(s)) for t, (_, s) in TAG_AXES.items()])
    seen = F.when(value >= 0.55, "high").when(value <= 0.45, "low")
    return tagged.select(F.when(side.isNotNull() & seen.isNotNull(), (side == seen).cast("double")).alias("ok"), side.isNotNull().alias("known"))


@query("m13_tag_agreement", "WITH t AS (SELECT CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'low' WHEN 'purchase' THEN 'high' END AS side, CASE WHEN value / 50 >= 0.55 THEN 'high' WHEN value / 50 <= 0.45 THEN 'low' END AS seen FROM events) SELECT round(avg(CASE WHEN side IS NOT NULL AND seen IS NOT NULL THEN CAST(side = seen AS DOUBLE) END), 6) AS agreement, round(count(CASE WHEN side IS NOT NULL AND seen IS NOT NULL THEN 1 END) / count(CASE WHEN side IS NOT NULL THEN 1 END), 6) AS coverage FROM t")
def explanation_tags(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in {"click": "good_groove", "view": "bad_tonal", "purchase": "good_mood"}.items() for x in kv])
    e = read(spark, sf, "events")
    t = tag_agreement(e, F.col("value") / 50, F.try_element_at(names, F.col("event_type")))
    return t.agg(r6(F.avg("ok")).alias("agreement"), r6(F.count("ok") / F.count(F.when(F.col("known"), 1))).alias("coverage"))


@query("a36_label_ranking", "WITH m AS (SELECT user_id, event_type, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(mean, 6) AS mean, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(mean, 9) DESC, event_type) AS rank FROM m) WHERE rank <= 3")
def label_ranking(spark, sf):
    m = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"))
    top = fusion.ranked_by(m, ["user_id"], F.desc(F.round("mean", 9)), "event_type").where("rank <= 3")
    return top.select("user_id", "event_type", r6(F.col("mean")).alias("mean"), "rank")


def window_starts(duration, width: float):
    """Starts of windows centred at a fifth, half and four fifths; those within a second of one before go."""
    last = F.greatest(duration - width, F.lit(0.0))
    raw = F.array(*[F.least(last, F.greatest(F.lit(0.0), duration * c - width / 2)) for c in (0.2, 0.5, 0.8)])
    return F.aggregate(raw, F.array().cast("array<double>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(x - y) < 1), acc).otherwise(F.concat(acc, F.array(x))))


@query("x38_window_starts", "WITH d AS (SELECT p_partkey, p_size::DOUBLE * 2 AS d FROM part), r AS (SELECT p_partkey, d, greatest(d - 30, 0) AS l FROM d), s AS (SELECT p_partkey, least(l, greatest(0, d * 0.2 - 15)) AS a, least(l, greatest(0, d * 0.5 - 15)) AS b, least(l, greatest(0, d * 0.8 - 15)) AS c FROM r) SELECT p_partkey, 1 + CAST(abs(b - a) >= 1 AS INTEGER) + CAST(abs(c - a) >= 1 AND (abs(b - a) < 1 OR abs(c - b) >= 1) AS INTEGER) AS n, round(c, 6) AS last_centre FROM s")
def duration_windows(spark, sf):
    d = F.col("p_size").cast("double") * 2
    last = F.least(F.greatest(d - 30.0, F.lit(0.0)), F.greatest(F.lit(0.0), d * 0.8 - 15.0))
    return read(spark, sf, "part").select("p_partkey", F.size(window_starts(d, 30.0)).alias("n"), r6(last).alias("last_centre"))


@query("x26_leaf_labels", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS leaf, list_contains(['1', '2', '3'], right(url, 1)) AS flagged FROM pages")
def leaf_labels(spark, sf):
    leaf = F.element_at(F.split("url", "/"), -1)
    return read(spark, sf, "pages").select("page_id", leaf.alias("leaf"), F.exists(F.array(*[F.lit(x) for x in "123"]), lambda x: x == F.substring("url", -1, 1)).alias("flagged"))


@query("w4_inferred_ranks", f"WITH {SESSIONS}, e AS (SELECT session_id, item_id, total, CASE WHEN rank <= 3 THEN rank END AS explicit FROM sess) SELECT session_id, item_id, coalesce(explicit, max(explicit) OVER (PARTITION BY session_id) + row_number() OVER (PARTITION BY session_id, explicit IS NULL ORDER BY total DESC, item_id)) AS rank FROM e")
def inferred_ranks(spark, sf):
    e = sessions(spark, sf).withColumn("explicit", F.when(F.col("rank") <= 3, F.col("rank")))
    after = F.max("explicit").over(Window.partitionBy("session_id")) + F.row_number().over(Window.partitionBy("session_id", F.col("explicit").isNull()).orderBy(F.desc("total"), "item_id"))
    return e.select("session_id", "item_id", F.coalesce("explicit", after).cast("long").alias("rank"))


@query("w16_top_diagnostics", f"WITH {SOURCES}, f AS (SELECT seed, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(rank) AS b, count(*) AS n FROM src GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(s, 9) DESC, b, vec_id) AS rank FROM f) SELECT n AS source_count, count(*) AS items, round(avg(rank), 6) AS mean_rank FROM r WHERE rank <= 10 GROUP BY 1")
def top_diagnostics(spark, sf):
    f = fusion.rrf(sources(spark, sf), ["seed", "vec_id"])
    r = fusion.ranked_by(f, ["seed"], F.desc(F.round("score", 9)), "best_rank", "vec_id").where("rank <= 10")
    return r.groupBy("source_count").agg(F.count(F.lit(1)).alias("items"), r6(F.avg("rank")).alias("mean_rank"))


@query("x34_contributions", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS rank, round(1.0::DOUBLE / (60 + CAST(json_extract(props, '$.k') AS BIGINT)), 6) AS contribution FROM events")
def contributions(spark, sf):
    m = F.from_json("props", "map<string,double>")
    k = F.try_element_at(m, F.lit("k")).cast("long")
    return read(spark, sf, "events").select("event_id", k.alias("rank"), r6(1 / (60 + k)).alias("contribution"))


@query("d18_profile_rerank", f"WITH {SESSIONS}, s AS (SELECT session_id, item_id, rel, rank, 0.6::DOUBLE / (60 + rank) + 0.4::DOUBLE / (60 + row_number() OVER (PARTITION BY session_id ORDER BY item_id)) AS score FROM sess), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, rank, item_id) AS new FROM s) SELECT session_id, item_id, round(score, 6) AS score, new AS rank FROM r")
def profile_rerank(spark, sf):
    s = sessions(spark, sf)
    by_id = F.row_number().over(Window.partitionBy("session_id").orderBy("item_id"))
    long = s.select("session_id", "item_id", F.lit("price").alias("source"), "rank").unionAll(s.select("session_id", "item_id", F.lit("id").alias("source"), by_id.alias("rank")))
    f = fusion.rrf(long, ["session_id", "item_id"], weights={"price": 0.6, "id": 0.4}).drop("best_rank").join(s.select("session_id", "item_id", F.col("rank").alias("old")), ["session_id", "item_id"])
    return fusion.ranked_by(f, ["session_id"], F.desc(F.round("score", 9)), "old", "item_id").select("session_id", "item_id", r6(F.col("score")).alias("score"), "rank")
