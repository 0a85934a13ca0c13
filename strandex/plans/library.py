"""Catalogue queries: filters, joins, counts, order, pages, sets, incremental selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandex.functions import expr as X
from strandex.operators import dedup
from strandex.operators import library as L
from strandex.operators.ranks import numbered
from strandex.plans.base import registrar
from strandex.plans.views import CLASSIFIER, FEATURES, LIKES, TRACKS, classifier_scores, features, likes, r6, read, tracks

QUERIES, ORACLES, query = registrar()


@query("f1_base_projection", f"WITH {TRACKS}, {LIKES} SELECT track_id, title, artist, album, year, track_id IN (SELECT track_id FROM likes) AS liked FROM tracks")
def base_projection(spark, sf):
    return L.with_liked(tracks(spark, sf), likes(spark, sf)).select("track_id", "title", "artist", "album", "year", "liked")


@query("f2_current_only", f"WITH {TRACKS} SELECT track_id FROM tracks WHERE missing_since IS NULL")
def current_only(spark, sf):
    return L.current(tracks(spark, sf)).select("track_id")


@query("f3_like_search", f"WITH {TRACKS} SELECT track_id, title FROM tracks WHERE title ILIKE '%ed w%' OR artist ILIKE '%ed w%' OR album ILIKE '%ed w%' OR year::VARCHAR ILIKE '%ed w%'")
def like_search(spark, sf):
    return L.like_search(tracks(spark, sf), "ED w").select("track_id", "title")


@query("f4_token_search", r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) SELECT doc_id FROM t WHERE list_contains(w, 'the') AND list_contains(w, 'of')")
def token_search(spark, sf):
    return L.token_search(read(spark, sf, "documents"), "THE of", ["text"]).select("doc_id")


@query("f4_phrase_search", r"SELECT doc_id FROM documents WHERE regexp_matches(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ', ' and attion ')")
def phrase_search(spark, sf):
    return L.token_search(read(spark, sf, "documents"), "and-attion", ["text"]).select("doc_id")


@query("f6_search_rows", f"WITH {TRACKS}, {LIKES} SELECT track_id, concat_ws(' ', title, artist, album, year::VARCHAR) AS body FROM tracks LEFT JOIN likes USING (track_id)")
def search_rows(spark, sf):
    return tracks(spark, sf).join(likes(spark, sf), "track_id", "left").select("track_id", F.concat_ws(" ", "title", "artist", "album", F.col("year").cast("string")).alias("body"))


@query("f7_liked_filter", f"WITH {TRACKS}, {LIKES} SELECT track_id FROM tracks WHERE EXISTS (SELECT 1 FROM likes WHERE likes.track_id = tracks.track_id)")
def liked_filter(spark, sf):
    return L.liked_only(tracks(spark, sf), likes(spark, sf)).select("track_id")


@query("f9_f10_classifier_thresholds", f"WITH {TRACKS}, {CLASSIFIER} SELECT t.track_id, round(c.score, 6) AS primary_score FROM tracks t JOIN cls c ON c.track_id = t.track_id AND c.classifier_key = 'groove' AND c.score >= 0.5 WHERE EXISTS (SELECT 1 FROM cls d WHERE d.track_id = t.track_id AND d.classifier_key = 'voice' AND d.score >= 0.25)")
def classifier_thresholds(spark, sf):
    return L.min_scores(tracks(spark, sf), classifier_scores(spark, sf), {"groove": 0.5, "voice": 0.25}).select("track_id", r6(F.col("primary_score")).alias("primary_score"))


@query("f15_strict_selection", f"WITH {TRACKS}, w AS (SELECT unnest([5, 3, 5, 11]) AS track_id, unnest([0, 1, 2, 3]) AS position) SELECT position, track_id, title FROM w JOIN tracks USING (track_id)")
def strict_selection(spark, sf):
    return L.select_in_order(tracks(spark, sf), [5, 3, 5, 11]).select("position", "track_id", "title")


@query("f18_path_scope", "SELECT page_id, url FROM pages WHERE starts_with(lower(url), 'http') AND contains(lower(url), '/') AND contains(lower(url), '1')")
def path_scope(spark, sf):
    u = F.lower("url")
    return read(spark, sf, "pages").where(u.startswith("http") & u.contains("/") & u.contains("1")).select("page_id", "url")


@query("f19_page_filters", f"WITH {TRACKS}, {LIKES}, {FEATURES} SELECT track_id, bpm FROM feat JOIN tracks USING (track_id) WHERE bpm BETWEEN 90 AND 140 AND contains(lower(title), 'red') AND track_id NOT IN (SELECT track_id FROM likes)")
def page_filters(spark, sf):
    rows = tracks(spark, sf).join(features(spark, sf), "track_id").where(F.col("bpm").between(90, 140) & F.lower("title").contains("red"))
    return rows.join(likes(spark, sf), "track_id", "left_anti").select("track_id", "bpm")


@query("f23_random_eligible", f"WITH {TRACKS}, {LIKES} SELECT track_id FROM tracks WHERE track_id NOT IN (SELECT track_id FROM likes) ORDER BY substr(sha256('7:' || track_id), 1, 16), track_id LIMIT 1")
def random_eligible(spark, sf):
    return tracks(spark, sf).join(likes(spark, sf), "track_id", "left_anti").orderBy(X.tie_token(7, F.col("track_id")), "track_id").limit(1).select("track_id")


@query("f25_coverage_flags", f"WITH {TRACKS}, {LIKES}, {CLASSIFIER} SELECT track_id, track_id IN (SELECT track_id FROM likes) AS liked, track_id IN (SELECT track_id FROM cls) AS scored FROM tracks")
def coverage_flags(spark, sf):
    return L.coverage(tracks(spark, sf), liked=likes(spark, sf), scored=classifier_scores(spark, sf)).select("track_id", "liked", "scored")


@query("j1_j2_left_joins", f"WITH {TRACKS}, {LIKES}, {FEATURES} SELECT t.track_id, t.title, l.liked_at, f.bpm FROM tracks t LEFT JOIN likes l USING (track_id) LEFT JOIN feat f USING (track_id)")
def left_joins(spark, sf):
    return tracks(spark, sf).join(likes(spark, sf), "track_id", "left").join(features(spark, sf), "track_id", "left").select("track_id", "title", "liked_at", "bpm")


@query("j3_readiness_join", f"WITH {TRACKS}, {LIKES}, {CLASSIFIER} SELECT track_id FROM tracks JOIN likes USING (track_id) JOIN (SELECT DISTINCT track_id FROM cls) USING (track_id)")
def readiness_join(spark, sf):
    out = tracks(spark, sf)
    for table in (likes(spark, sf), classifier_scores(spark, sf).select("track_id").distinct()):
        out = out.join(table, "track_id")
    return out.select("track_id")


@query("j6_unscored_tracks", f"WITH {TRACKS}, {CLASSIFIER} SELECT t.track_id FROM tracks t LEFT JOIN cls c ON c.track_id = t.track_id AND c.classifier_key = 'voice' WHERE c.track_id IS NULL AND missing_since IS NULL")
def unscored(spark, sf):
    done = classifier_scores(spark, sf).where("classifier_key = 'voice'")
    return L.current(tracks(spark, sf)).join(done, "track_id", "left_anti").select("track_id")


@query("j8_composite_identity", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) AND l_linenumber = 1")
def composite_identity(spark, sf):
    l, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    on = (l.l_orderkey == o.o_orderkey) & (l.l_shipdate.cast("date") > o.o_orderdate.cast("date")) & (l.l_linenumber == 1)
    return l.join(o, on).select("l_orderkey", "l_linenumber", "o_custkey")


@query("j10_preferred_label", "WITH e AS (SELECT user_id % 20 AS seed, event_id % 50 AS cand, event_type AS source, max(value) AS rating FROM events GROUP BY ALL) SELECT seed, cand, arg_min(source, CASE WHEN source = 'view' THEN '0' ELSE '1' || source END) AS source, arg_min(rating, CASE WHEN source = 'view' THEN '0' ELSE '1' || source END) AS rating FROM e GROUP BY seed, cand")
def preferred_label(spark, sf):
    e = read(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("seed"), (F.col("event_id") % 50).alias("cand"), F.col("event_type").alias("source")).agg(F.max("value").alias("rating"))
    order = F.when(F.col("source") == "view", "0").otherwise(F.concat(F.lit("1"), "source"))
    best = e.groupBy("seed", "cand").agg(F.min_by(F.struct("source", "rating"), order).alias("b"))
    return best.select("seed", "cand", "b.source", "b.rating")


@query("j19_tolerance_join", "SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type = b.event_type AND abs(a.value - b.value) <= 0.05")
def tolerance_join(spark, sf):
    e = read(spark, sf, "events")
    a, b = e.alias("a"), e.alias("b")
    on = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_type") == F.col("b.event_type")) & (F.col("a.event_id") < F.col("b.event_id")) & (F.abs(F.col("a.value") - F.col("b.value")) <= 0.05)
    return a.join(b, on).select(F.col("a.event_id"), F.col("b.event_id").alias("other"))


@query("j20_current_sessions", "WITH bad AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60) SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM bad) AND event_type <> 'error'")
def current_sessions(spark, sf):
    e = read(spark, sf, "events")
    stale = e.where("event_type = 'error' AND value > 60").select("user_id").distinct()
    return e.where("event_type <> 'error'").join(stale, "user_id", "left_anti").select("event_id", "user_id")


@query("j21_match_scoring", "WITH s AS (SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, 4 + CASE WHEN a.p_brand = b.p_brand THEN 4 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0 END + CASE WHEN a.p_size = b.p_size THEN 1 ELSE 0 END AS points FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_partkey < b.p_partkey) SELECT *, CASE WHEN points >= 8 THEN 'high' ELSE 'medium' END AS confidence FROM s WHERE points >= 6")
def match_scoring(spark, sf):
    # 6 points take the brand, or the type and the size
    fields = ["name", "p_brand", "p_type", "p_size"]
    chunks = dedup.class_chunks(read(spark, sf, "part").withColumn("name", F.lower("p_name")), "p_partkey", fields)
    alike = lambda c: F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(False))
    pairs = lambda on: dedup.class_pairs(chunks, on, [*fields, "chunk"])
    j = pairs(["name", "p_brand"]).unionAll(pairs(["name", "p_type", "p_size"]).where(~alike("p_brand")))
    s = j.withColumn("points", 4 + sum(F.when(alike(c), n).otherwise(0) for c, n in (("p_brand", 4), ("p_type", 1), ("p_size", 1))))
    out = dedup.item_pairs(s, F.col("points"), F.when(F.col("points") >= 8, "high").otherwise("medium").alias("confidence"))
    return out.withColumnsRenamed({"a": "left_id", "b": "right_id"})


@query("a1_a6_table_counts", "SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def table_counts(spark, sf):
    out = None
    for name in ("part", "orders", "lineitem", "events", "documents"):
        one = read(spark, sf, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("a2_zero_filled_counts", f"WITH {CLASSIFIER}, k AS (SELECT unnest(['groove', 'voice', 'mood']) AS classifier_key) SELECT k.classifier_key, count(c.track_id) AS n FROM k LEFT JOIN cls c USING (classifier_key) GROUP BY 1")
def zero_filled(spark, sf):
    keys = spark.createDataFrame([("groove",), ("voice",), ("mood",)], "classifier_key string")
    counts = classifier_scores(spark, sf).groupBy("classifier_key").count()
    return keys.join(counts, "classifier_key", "left").select("classifier_key", F.coalesce("count", F.lit(0)).alias("n"))


@query("a3_w2_filtered_total", f"WITH {TRACKS} SELECT track_id, count(*) OVER () AS total FROM tracks WHERE missing_since IS NULL AND title ILIKE '%red%' ORDER BY track_id LIMIT 10")
def filtered_total(spark, sf):
    rows = L.like_search(L.current(tracks(spark, sf)), "red", ["title"])
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("track_id").limit(10).crossJoin(F.broadcast(total)).select("track_id", "total")


@query("a4_counts_with_empty", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def counts_with_empty(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("a5_duplicate_names", "SELECT lower(trim(p_name)) AS name, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf):
    g = read(spark, sf, "part").groupBy(F.lower(F.trim("p_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",").alias("ids"))
    return g.where("n > 1")


@query("t3_t4_library_page", f"WITH {TRACKS}, {LIKES} SELECT track_id, artist, title, track_id IN (SELECT track_id FROM likes) AS liked FROM tracks WHERE missing_since IS NULL ORDER BY liked DESC, lower(artist), lower(title), track_id LIMIT 50 OFFSET 20")
def library_page(spark, sf):
    rows = L.with_liked(L.current(tracks(spark, sf)), likes(spark, sf))
    return L.page(rows, L.library_order(), 50, 20).select("track_id", "artist", "title", "liked")


@query("f8_syncopated", f"WITH {TRACKS} SELECT track_id, title FROM tracks WHERE track_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def syncopated_tracks(spark, sf):
    genres = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("track_id"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).cast("int").alias("syncopated"))
    return L.syncopated(tracks(spark, sf), genres).select("track_id", "title")


@query("t5_keyset_page", f"WITH {TRACKS} SELECT track_id, title FROM tracks WHERE track_id > 100 ORDER BY track_id LIMIT 25")
def keyset(spark, sf):
    return L.keyset_page(tracks(spark, sf), 100, 25).select("track_id", "title")


@query("t6_liked_order", f"WITH {LIKES} SELECT track_id, row_number() OVER (ORDER BY liked_at DESC, track_id) AS rank FROM likes")
def liked_order(spark, sf):
    return numbered(likes(spark, sf), [F.desc("liked_at"), F.col("track_id")]).select("track_id", "rank")


@query("t8_seeded_order", f"WITH {TRACKS} SELECT track_id, row_number() OVER (ORDER BY substr(sha256('42:' || track_id), 1, 16), track_id) AS rank FROM tracks")
def seeded_order(spark, sf):
    tokens = tracks(spark, sf).select("track_id", X.tie_token(42, F.col("track_id")).alias("token"))
    return numbered(tokens, [F.col("token"), F.col("track_id")]).select("track_id", "rank")


@query("t12_keeper_choice", "SELECT lower(p_name) AS name, arg_min(p_partkey, (-p_size, -p_retailprice, p_partkey)) AS keeper FROM part GROUP BY 1")
def keeper_choice(spark, sf):
    order = F.struct(-F.col("p_size"), -F.col("p_retailprice"), F.col("p_partkey"))
    return read(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min_by("p_partkey", order).alias("keeper"))


@query("w1_latest_per_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest(spark, sf):
    return L.latest_per_key(read(spark, sf, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("u1_union_distinct", "SELECT source AS label FROM documents UNION SELECT event_type FROM events")
def union_distinct(spark, sf):
    return read(spark, sf, "documents").select(F.col("source").alias("label")).union(read(spark, sf, "events").select("event_type")).distinct()


@query("u2_difference", f"WITH {TRACKS}, {CLASSIFIER} SELECT track_id FROM tracks EXCEPT SELECT track_id FROM cls")
def difference(spark, sf):
    return tracks(spark, sf).select("track_id").subtract(classifier_scores(spark, sf).select("track_id"))


@query("u3_intersection", f"WITH {LIKES}, {CLASSIFIER} SELECT track_id FROM likes INTERSECT SELECT track_id FROM cls")
def intersection(spark, sf):
    return likes(spark, sf).select("track_id").intersect(classifier_scores(spark, sf).select("track_id"))


@query("u4_ordered_distinct", "WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM f GROUP BY 1")
def ordered_distinct(spark, sf):
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.col("t.role")), ",").alias("roles"))


@query("r1_missing_outputs", f"WITH {TRACKS}, {LIKES}, {CLASSIFIER}, m AS (SELECT track_id, CASE WHEN track_id NOT IN (SELECT track_id FROM likes) THEN 'likes,' ELSE '' END || CASE WHEN track_id NOT IN (SELECT track_id FROM cls) THEN 'scores,' ELSE '' END AS missing FROM tracks WHERE missing_since IS NULL) SELECT track_id, rtrim(missing, ',') AS missing FROM m WHERE missing <> ''")
def missing_outputs(spark, sf):
    out = L.missing_outputs(tracks(spark, sf), likes=likes(spark, sf), scores=classifier_scores(spark, sf))
    return out.select("track_id", F.array_join("missing", ",").alias("missing"))


@query("r3_mark_unseen", f"WITH {TRACKS} SELECT track_id, coalesce(missing_since, CASE WHEN track_id % 3 = 0 THEN 'now' END) AS missing_since FROM tracks")
def mark_unseen(spark, sf):
    t = tracks(spark, sf)
    seen = t.where("track_id % 3 <> 0").select("track_id", F.lit(True).alias("seen"))
    return t.join(seen, "track_id", "left").select("track_id", F.coalesce("missing_since", F.when(F.col("seen").isNull(), "now")).alias("missing_since"))


@query("r9_relocation_plan", "SELECT page_id, url, regexp_replace(url, '^https?://', 'archive://') AS moved, count(*) OVER (PARTITION BY regexp_replace(url, '^https?://', 'archive://')) > 1 AS conflict FROM pages")
def relocation(spark, sf):
    moved = F.regexp_replace("url", "^https?://", "archive://")
    rows = read(spark, sf, "pages").select("page_id", "url", moved.alias("moved"))
    return rows.withColumn("conflict", F.count(F.lit(1)).over(Window.partitionBy("moved")) > 1)


@query("k4_k5_upsert", "WITH o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'kept' WHEN o.v = n.v THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.k = n.k")
def upsert(spark, sf):
    c = read(spark, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("v"))
    return L.upsert(old, new, ["k"], ["v"])


@query("k11_flat_report", "SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY 1")
def flat_report(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.max("value"))


@query("z5_export_rows", f"WITH {TRACKS}, {FEATURES} SELECT t.track_id, coalesce(f.bpm::VARCHAR, '') AS bpm, coalesce(f.key, 'n/a') AS key FROM tracks t LEFT JOIN feat f USING (track_id)")
def export_rows(spark, sf):
    return tracks(spark, sf).join(features(spark, sf), "track_id", "left").select("track_id", F.coalesce(F.col("bpm").cast("string"), F.lit("")).alias("bpm"), F.coalesce("key", F.lit("n/a")).alias("key"))


@query("z6_detail_hydration", f"WITH {CLASSIFIER} SELECT track_id, string_agg(classifier_key || '=' || round(score, 2)::VARCHAR, ';' ORDER BY classifier_key) AS details FROM cls GROUP BY 1")
def hydration(spark, sf):
    c = classifier_scores(spark, sf).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("classifier_key", "score"))).alias("d"))
    return c.select("track_id", F.array_join(F.transform("d", lambda x: F.concat(x["classifier_key"], F.lit("="), F.round(x["score"], 2).cast("string"))), ";").alias("details"))
