"""Scalar rules, feature similarity, transition risk, duplicates and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandex.functions import expr as X
from strandex.operators import dedup
from strandex.operators import features as feat
from strandex.operators.vectors import dot
from strandex.plans.base import registrar
from strandex.plans.views import FEATURES, embeddings, features, r6, read
from strandex.runtime import stage

QUERIES, ORACLES, query = registrar()

FIELDS = {"energy": 3.0, "dance": 3.0, "valence": 1.4, "loudness": 0.8, "density": 0.8}
DIST = "least(abs(a - b), abs(a / 2 - b), abs(a * 2 - b), abs(a - b / 2), abs(a - b * 2))"


@query("x1_x3_numeric_rules", "SELECT event_id, round(least(1, greatest(0, value / 50)), 6) AS clamped, round(least(1, greatest(0, (value - 10) / 40)), 6) AS scaled, round(1 - abs(value - user_id) / greatest(abs(value), abs(user_id), 1), 6) AS similar FROM events")
def numeric_rules(spark, sf):
    e = read(spark, sf, "events")
    v = F.col("value")
    return e.select("event_id", r6(X.clamp01(v / 50)).alias("clamped"), r6(X.normalise(v, F.lit(10.0), F.lit(50.0))).alias("scaled"), r6(X.numeric_similarity(v, F.col("user_id").cast("double"))).alias("similar"))


@query("x2_x36_x39_vector_fields", "SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS third, CASE WHEN len(embedding) > 99 THEN 1.0 END::DOUBLE AS beyond, round(CASE WHEN embedding[1] + 0.1 BETWEEN -0.000001 AND 1.000001 THEN least(1, greatest(0, CAST(embedding[1] AS DOUBLE) + 0.1)) END, 6) AS inside, round(20 + least(1, greatest(0, CAST(embedding[2] AS DOUBLE))) * 280, 4) AS wide FROM embeddings")
def vector_fields(spark, sf):
    v = F.col("v")
    return embeddings(spark, sf).select("vec_id", r6(X.component(v, 2)).alias("third"), X.component(v, 99).alias("beyond"), r6(X.unit_interval(X.component(v, 0) + 0.1)).alias("inside"), F.round(X.denormalise(X.component(v, 1), F.lit(20.0), F.lit(300.0)), 4).alias("wide"))


@query("x12_x14_camelot", f"""WITH {FEATURES}, k AS (SELECT track_id, key, CAST(regexp_extract(key, '^(\\d+)', 1) AS INTEGER) AS n, right(key, 1) AS l FROM feat)
SELECT track_id, key AS canonical, CASE WHEN key IS NULL THEN 0.55 WHEN key = '8A' THEN 1.0 WHEN l = 'A' AND (n - 8 + 24) % 12 IN (1, 11) THEN 0.95 WHEN n = 8 THEN 0.9 ELSE 0.2 END::DOUBLE AS score FROM k""")
def camelot(spark, sf):
    key = X.camelot(F.lower("key"))
    return features(spark, sf).select("track_id", key.alias("canonical"), X.camelot_score(key, F.lit("8A")).alias("score"))


@query("x13_key_names", "SELECT * FROM (VALUES ('Am', '8A'), ('a minor', '8A'), ('F# min', '11A'), ('Gb major', '2B'), ('C', '8B'), ('B♭m', '3A'), ('H', NULL)) t(name, wheel)")
def key_names(spark, sf):
    names = spark.createDataFrame([(n,) for n in ("Am", "a minor", "F# min", "Gb major", "C", "B♭m", "H")], "name string")
    return names.select("name", X.key_to_camelot(F.col("name")).alias("wheel"))


@query("x15_attenuation", f"WITH {FEATURES} SELECT track_id, round(0.55 + (0.95 - 0.55) * CASE WHEN key_confidence IS NULL THEN 1 ELSE greatest(least(1, key_confidence / 0.45), 1e-12) END, 6) AS score FROM feat")
def attenuation(spark, sf):
    return features(spark, sf).select("track_id", r6(X.attenuate(F.lit(0.95), F.col("key_confidence"))).alias("score"))


@query("x17_x19_buckets", f"WITH {FEATURES} SELECT track_id, CASE WHEN energy >= 0.7 THEN 'high' WHEN energy >= 0.3 THEN 'medium' WHEN energy IS NOT NULL THEN 'low' END AS bucket, CASE WHEN bpm IS NULL THEN 'bpm_unknown' ELSE 'bpm_' || (floor(bpm / 10) * 10)::INTEGER || '_' || ((floor(bpm / 10) * 10)::INTEGER + 9) END AS tempo, CASE WHEN energy IS NULL THEN 'energy_unknown' WHEN energy < 0.33 THEN 'energy_low' WHEN energy < 0.66 THEN 'energy_medium' ELSE 'energy_high' END AS level FROM feat")
def buckets(spark, sf):
    return features(spark, sf).select("track_id", X.score_bucket(F.col("energy")).alias("bucket"), X.bpm_bucket(F.col("bpm")).alias("tempo"), X.energy_bucket(F.col("energy")).alias("level"))


@query("x18_argmax_label", "SELECT event_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label FROM (SELECT event_id, event_id % 7 AS a, user_id % 7 AS b, CAST(floor(value) AS BIGINT) % 7 AS c FROM events)")
def argmax(spark, sf):
    return read(spark, sf, "events").select("event_id", X.argmax_label({"a": F.col("event_id") % 7, "b": F.col("user_id") % 7, "c": F.floor("value") % 7}).alias("label"))


@query("x20_tie_token", "SELECT event_id, substr(sha256('123:' || user_id || ':' || event_id), 1, 16) AS token FROM events")
def tie(spark, sf):
    return read(spark, sf, "events").select("event_id", X.tie_token(123, F.col("user_id"), F.col("event_id")).alias("token"))


@query("x22_x28_text_rules", r"SELECT page_id, nullif(trim(regexp_replace(lower(url), '\s+', ' ', 'g')), '') AS clean, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS file, CASE WHEN try_cast(substr(page_id::VARCHAR, 1, 4) AS INTEGER) BETWEEN 1 AND 9999 THEN try_cast(substr(page_id::VARCHAR, 1, 4) AS INTEGER) END AS year, CASE WHEN page_id > 0 THEN page_id::DOUBLE END AS positive FROM pages")
def text_rules(spark, sf):
    p = read(spark, sf, "pages")
    s = F.col("page_id").cast("string")
    return p.select("page_id", X.clean_text(F.col("url")).alias("clean"), X.safe_filename(F.col("url")).alias("file"), X.year_of(s).alias("year"), X.positive_number(s).alias("positive"))


@query("x30_x32_time_and_json", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def time_json(spark, sf):
    return read(spark, sf, "events").select("event_id", X.iso_utc(F.col("ts")).alias("at"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("a24_json_key_counts", "SELECT k AS name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def json_keys(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return read(spark, sf, "events").select(F.explode(F.map_keys(m)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


RANGE = ", ".join(f"CASE WHEN count({f}) >= 2 THEN CASE WHEN quantile_cont({f}, 0.98) > quantile_cont({f}, 0.02) THEN quantile_cont({f}, 0.02) ELSE min({f}) END END AS {f}_lo, CASE WHEN count({f}) >= 2 THEN CASE WHEN quantile_cont({f}, 0.98) > quantile_cont({f}, 0.02) THEN quantile_cont({f}, 0.98) ELSE max({f}) END END AS {f}_hi" for f in FIELDS)
SCALED = f"{FEATURES}, rg AS (SELECT {RANGE} FROM feat), z AS (SELECT track_id, " + ", ".join(f"CASE WHEN {f} IS NULL THEN NULL WHEN {f}_hi = {f}_lo THEN 0.5 ELSE least(1, greatest(0, ({f} - {f}_lo) / ({f}_hi - {f}_lo))) END AS {f}" for f in FIELDS) + " FROM feat, rg)"
CENTRE = "c AS (SELECT " + ", ".join(f"avg({f}) AS {f}_c" for f in FIELDS) + " FROM z WHERE track_id IN (1, 2, 3))"
NUM = " + ".join(f"coalesce((1 - abs({f} - {f}_c)) * {w}, 0)" for f, w in FIELDS.items())
DEN = " + ".join(f"CASE WHEN {f} IS NOT NULL AND {f}_c IS NOT NULL THEN {w} ELSE 0 END" for f, w in FIELDS.items())
MEET = " + ".join(f"CASE WHEN {f} IS NOT NULL AND {f}_c IS NOT NULL THEN 1 ELSE 0 END" for f in FIELDS)


def _seeds(spark):
    return spark.createDataFrame([(1,), (2,), (3,)], "track_id long")


@query("a8_robust_ranges", f"WITH {FEATURES}, rg AS (SELECT {RANGE} FROM feat) SELECT " + ", ".join(f"round({f}_{e}, 6) AS {f}_{e}" for f in FIELDS for e in ("lo", "hi")) + " FROM rg")
def robust_ranges(spark, sf):
    r = feat.ranges(features(spark, sf), list(FIELDS))
    return r.select(*[r6(F.col(c)).alias(c) for c in r.columns])


@query("d4_feature_search", f"WITH {SCALED}, {CENTRE}, s AS (SELECT track_id, ({NUM}) / nullif({DEN}, 0) AS score, {MEET} AS overlap FROM z, c WHERE track_id NOT IN (1, 2, 3)) SELECT track_id, round(score, 6) AS score, overlap FROM s WHERE overlap >= 2")
def feature_search(spark, sf):
    out = feat.feature_search(features(spark, sf), _seeds(spark), FIELDS)
    return out.select("track_id", r6(F.col("score")).alias("score"), "overlap")


@query("d6_mixer_search", f"WITH {SCALED}, {CENTRE}, s AS (SELECT track_id, (coalesce((1 - abs(energy - energy_c)) * 1.2, 0) + coalesce((1 - abs(dance - dance_c)) * 0.45, 0) + coalesce(least(1, greatest(0, 0.5 - (valence - valence_c) / 2)) * 1.25, 0)) / nullif(CASE WHEN energy IS NOT NULL THEN 1.2 ELSE 0 END + CASE WHEN dance IS NOT NULL AND dance_c IS NOT NULL THEN 0.45 ELSE 0 END + CASE WHEN valence IS NOT NULL THEN 1.25 ELSE 0 END, 0) AS score FROM z, c WHERE track_id NOT IN (1, 2, 3)) SELECT track_id, round(score, 6) AS score FROM s WHERE score IS NOT NULL")
def mixer_search(spark, sf):
    groups = {"dynamics": {"energy": 1.2, "valence": 1.0}, "rhythm": {"dance": 0.9}}
    out = feat.mixer_search(features(spark, sf), _seeds(spark), groups, {"dynamics": 1.0, "rhythm": 0.5}, {"valence": -0.5})
    return out.select("track_id", r6(F.col("score")).alias("score"))


@query("j12_seed_tempo", f"WITH {FEATURES}, s AS (SELECT track_id AS sid, bpm AS b FROM feat WHERE track_id IN (1, 2, 3)), p AS (SELECT track_id, bpm AS a, b FROM feat, s WHERE track_id NOT IN (1, 2, 3)) SELECT track_id, round(avg(CASE WHEN a IS NOT NULL THEN least(1, greatest(0, 1 - {DIST} / 16)) END), 6) AS score FROM p GROUP BY 1")
def seed_tempo(spark, sf):
    f = features(spark, sf).select("track_id", "bpm")
    out = feat.seed_averages(f, f.where("track_id in (1, 2, 3)"), X.tempo_score(F.col("bpm"), F.col("seed_bpm")))
    return out.select("track_id", r6(F.col("score")).alias("score"))


@query("a11_tied_modes", f"WITH {FEATURES}, c AS (SELECT key, count(*) AS n FROM feat WHERE key IS NOT NULL GROUP BY 1) SELECT key FROM c WHERE n = (SELECT max(n) FROM c)")
def tied_modes(spark, sf):
    return feat.modes(features(spark, sf), "key")


@query("j13_band_join", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) <= 5000")
def band_join(spark, sf):
    return dedup.band_pairs(read(spark, sf, "orders"), "o_orderkey", "o_totalprice", 5000.0, ["o_custkey"]).select("a", "b")


@query("j14_n3_lsh_pairs")
def lsh_pairs(spark, sf):
    e = embeddings(spark, sf)
    pairs = dedup.signature_pairs(dedup.signatures(e, "vec_id", "v", 64), "vec_id")
    a = e.select(F.col("vec_id").alias("a"), F.col("v").alias("va"))
    b = e.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", r6(dot(F.col("va"), F.col("vb"))).alias("similarity"))


DUPS = """nm AS (SELECT p_partkey AS id, lower(p_name) AS name, p_brand, p_size, p_retailprice AS price FROM part),
e AS (SELECT a.id AS a, b.id AS b, (CASE WHEN a.p_brand = b.p_brand THEN 1 ELSE 0 END * 0.43 + (1 - least(abs(a.p_size - b.p_size), 8) / 8) * 0.14 + (1 - least(abs(a.price - b.price), 24) / 24) * 0.05) / 0.62 AS score FROM nm a JOIN nm b ON a.name = b.name AND a.id < b.id AND abs(a.price - b.price) <= 15),
ed AS (SELECT * FROM e WHERE score >= 0.925)"""


SAME = ["name", "p_brand", "p_size", "price"]


def _items(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), "p_brand", "p_size", F.col("p_retailprice").alias("price"))


def _pair_score(x, y):
    of = lambda c: (F.col(f"{x}.{c}"), F.col(f"{y}.{c}"))
    brand, other = of("p_brand")
    return dedup.pair_score([(F.when(brand == other, 1.0).otherwise(0.0), 0.43), (dedup.gap_similarity(*of("p_size"), 8.0), 0.14), (dedup.gap_similarity(*of("price"), 24.0), 0.05)])


def _links(p):
    """(x, y, score): linked pairs of classes of equal items. Without the brand's share no score reaches 0.925, so brands are equal."""
    pairs = dedup.class_pairs(dedup.item_classes(p, "id", SAME), ["name", "p_brand"], SAME, "price", 15.0)
    return stage(dedup.linked_classes(pairs).withColumn("score", _pair_score("x", "y")).where("score >= 0.925"), "links")


def _direct(x, y):
    near = F.abs(F.col(f"{x}.price") - F.col(f"{y}.price")) <= 15.0
    return (F.col(f"{x}.name") == F.col(f"{y}.name")) & near & (_pair_score(x, y) >= 0.925)


def _candidates(p, groups):
    members = groups.join(p, "id")
    chosen = dedup.keepers(members, "id", -F.col("p_size"), -F.col("price"), F.col("id"))
    return dedup.scored_candidates(members, chosen, "id", _direct)


@query("n4_n10_pair_scores", f"WITH {DUPS} SELECT a, b, round(score, 6) AS score, CASE WHEN score >= 0.98 THEN 'high' WHEN score >= 0.94 THEN 'medium' ELSE 'low' END AS confidence FROM e")
def pair_scores(spark, sf):
    chunks = dedup.class_chunks(_items(spark, sf), "id", SAME)
    pairs = dedup.class_pairs(chunks, ["name"], [*SAME, "chunk"], "price", 15.0).withColumn("score", _pair_score("x", "y"))
    return dedup.item_pairs(pairs, r6(F.col("score")).alias("score"), dedup.confidence(F.col("score"), dedup.PRESETS["aggressive"].min_score).alias("confidence"))


COMPONENTS = f"""WITH RECURSIVE {DUPS}, both_ways AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT w.b, r.root FROM reach r JOIN both_ways w ON r.node = w.a),
grp AS (SELECT node AS id, min(root) AS group_id FROM reach GROUP BY 1)"""


@query("u5_n8_groups", f"{COMPONENTS} SELECT id, group_id FROM grp")
def duplicate_groups(spark, sf):
    p = _items(spark, sf)
    return dedup.class_groups(p, "id", SAME, _links(p))


@query("n9_n11_keepers", f"{COMPONENTS}, k AS (SELECT group_id, arg_min(id, (-p_size, -price, id)) AS keeper FROM grp JOIN nm USING (id) GROUP BY 1) SELECT g.group_id, g.id, k.keeper, EXISTS (SELECT 1 FROM ed WHERE (ed.a = g.id AND ed.b = k.keeper) OR (ed.b = g.id AND ed.a = k.keeper)) AS safe FROM grp g JOIN k USING (group_id) WHERE g.id <> k.keeper")
def keeper_safety(spark, sf):
    p = _items(spark, sf)
    return _candidates(p, stage(dedup.class_groups(p, "id", SAME, _links(p)), "groups"))


@query("a37_duplicate_statistics", f"{COMPONENTS}, k AS (SELECT group_id, arg_min(id, (-p_size, -price, id)) AS keeper FROM grp JOIN nm USING (id) GROUP BY 1), c AS (SELECT g.id, EXISTS (SELECT 1 FROM ed WHERE (ed.a = g.id AND ed.b = k.keeper) OR (ed.b = g.id AND ed.a = k.keeper)) AS safe FROM grp g JOIN k USING (group_id) WHERE g.id <> k.keeper), b AS (SELECT group_id, CASE WHEN min(score) >= 0.98 THEN 'high' WHEN min(score) >= 0.94 THEN 'medium' ELSE 'review' END AS confidence FROM ed JOIN grp ON ed.a = grp.id GROUP BY 1) SELECT (SELECT count(*) FROM c) AS candidate_count, (SELECT count(DISTINCT id) FROM c) AS duplicate_count, (SELECT count(*) FROM c WHERE safe) AS safe_count, (SELECT count(*) FROM c WHERE NOT safe) AS review_count, (SELECT count(*) FROM b WHERE confidence = 'high') AS high_groups, (SELECT count(*) FROM b WHERE confidence = 'medium') AS medium_groups, (SELECT count(*) FROM b WHERE confidence = 'review') AS review_groups")
def duplicate_statistics(spark, sf):
    p = _items(spark, sf)
    links = _links(p)
    members = stage(dedup.class_groups(p, "id", SAME, links), "groups")
    least = links.select(F.col("x.first").alias("id"), "score").join(members, "id").groupBy("group_id").agg(F.min("score").alias("least"))
    groups = least.select(F.when(F.col("least") >= 0.98, "high").when(F.col("least") >= 0.94, "medium").otherwise("review").alias("confidence"))
    return dedup.report_statistics(_candidates(p, members), groups)


@query("d23_w9_stratified_seeds", f"""WITH {FEATURES}, b AS (SELECT track_id, CASE WHEN bpm IS NULL THEN 'bpm_unknown' ELSE 'bpm_' || (floor(bpm / 10) * 10)::INTEGER END || CASE WHEN energy < 0.33 THEN 'l' WHEN energy < 0.66 THEN 'm' ELSE 'h' END AS bucket FROM feat WHERE energy IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY substr(sha256('123:' || track_id), 1, 16), track_id) AS rn FROM b) SELECT track_id, bucket, rn FROM r ORDER BY rn, bucket, track_id LIMIT 50""")
def stratified(spark, sf):
    f = features(spark, sf).where("energy is not null")
    tempo = F.when(F.col("bpm").isNull(), "bpm_unknown").otherwise(F.concat(F.lit("bpm_"), (F.floor(F.col("bpm") / 10) * 10).cast("int").cast("string")))
    level = F.when(F.col("energy") < 0.33, "l").when(F.col("energy") < 0.66, "m").otherwise("h")
    w = Window.partitionBy("bucket").orderBy(X.tie_token(123, F.col("track_id")), "track_id")
    r = f.select("track_id", F.concat(tempo, level).alias("bucket")).withColumn("rn", F.row_number().over(w))
    return r.orderBy("rn", "bucket", "track_id").limit(50)


@query("w10_distinct_artists", "WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) SELECT p_partkey, row_number() OVER (ORDER BY rn > 1, p_partkey) AS position FROM r ORDER BY position LIMIT 40")
def distinct_artists(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    r = read(spark, sf, "part").select("p_partkey", F.row_number().over(w).alias("rn"))
    top = r.orderBy(F.col("rn") > 1, "p_partkey").limit(40)
    return top.select("p_partkey", F.row_number().over(Window.orderBy(F.col("rn") > 1, "p_partkey")).alias("position"))


@query("w5_blind_ranks", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY substr(sha256('123:' || user_id || ':' || event_id), 1, 16), event_id) AS blind_rank FROM events")
def blind_ranks(spark, sf):
    w = Window.partitionBy("user_id").orderBy(X.tie_token(123, F.col("user_id"), F.col("event_id")), "event_id")
    return read(spark, sf, "events").select("event_id", F.row_number().over(w).alias("blind_rank"))
