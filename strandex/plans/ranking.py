"""Vector search, rank fusion and metric queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandex.operators import fusion, metrics, vectors
from strandex.operators.vectors import SearchFilters
from strandex.plans.base import registrar
from strandex.plans.views import EMB, PRED, SESSIONS, SOURCES, embeddings, predictions, r6, read, sessions, sources

QUERIES, ORACLES, query = registrar()

CENTROID = """cells AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb WHERE vec_id IN (0, 1)),
mean AS (SELECT list(x ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS x FROM cells GROUP BY pos)),
cen AS (SELECT list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM mean)"""


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "vec_id long")


@query("d1_seed_vector_search", f"WITH {EMB}, {CENTROID}, s AS (SELECT vec_id, list_dot_product(v, c) AS score FROM emb, cen WHERE vec_id NOT IN (0, 1)) SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s ORDER BY rank LIMIT 50")
def seed_vector_search(spark, sf):
    out = vectors.seed_search(embeddings(spark, sf), _seeds(spark, 0, 1), SearchFilters(limit=50))
    return out.select("vec_id", r6(F.col("score")).alias("score"), "rank")


@query("d2_query_vector", f"WITH {EMB}, q AS (SELECT v AS qv FROM emb WHERE vec_id = 3), s AS (SELECT vec_id, list_dot_product(v, qv) AS score FROM emb, q WHERE list_dot_product(v, qv) >= 0.1) SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s ORDER BY rank LIMIT 500")
def query_vector(spark, sf):
    e = embeddings(spark, sf)
    q = e.where("vec_id = 3").first()["v"]
    return vectors.search_vector(e, vectors.literal(q), SearchFilters(limit=500, min_similarity=0.1)).select("vec_id", r6(F.col("score")).alias("score"), "rank")


@query("f12_epsilon_band", f"WITH {EMB}, {CENTROID}, s AS (SELECT vec_id, list_dot_product(v, c) AS score FROM emb, cen WHERE vec_id NOT IN (0, 1)) SELECT vec_id, round(score, 6) AS score FROM s WHERE score >= (SELECT max(score) FROM s) - 0.05")
def epsilon_band(spark, sf):
    out = vectors.seed_search(embeddings(spark, sf), _seeds(spark, 0, 1), SearchFilters(limit=None, epsilon=0.05))
    return out.select("vec_id", r6(F.col("score")).alias("score"))


@query("f13_noise_order", f"""WITH {EMB}, {CENTROID}, s AS (SELECT vec_id, list_dot_product(v, c) AS score, sha256('catalog:' || vec_id) AS h FROM emb, cen WHERE vec_id NOT IN (0, 1)),
j AS (SELECT vec_id, score, round(score + (CAST(CAST('0x' || substr(h, 1, 16) AS UHUGEINT) AS DOUBLE) / 18446744073709551615.0::DOUBLE - 0.5) * 0.2, 9) AS o FROM s)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY o DESC, vec_id) AS rank FROM j ORDER BY rank LIMIT 100""")
def noise_order(spark, sf):
    out = vectors.seed_search(embeddings(spark, sf), _seeds(spark, 0, 1), SearchFilters(limit=100, noise=0.2))
    return out.select("vec_id", r6(F.col("score")).alias("score"), "rank")


@query("f17_vector_validity", f"WITH {EMB} SELECT count(*) AS n, count(*) FILTER (WHERE len(v) = 64 AND abs(sqrt(list_dot_product(v, v)) - 1) <= 0.00011) AS valid FROM emb")
def vector_validity(spark, sf):
    return embeddings(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(vectors.valid_vectors(None, 64), 1)).alias("valid"))


@query("d3_contrast_search", f"""WITH {EMB}, {CENTROID}, neg AS (SELECT vec_id AS nid, v AS nv FROM emb WHERE vec_id IN (5, 6, 7)),
n AS (SELECT vec_id, avg(d) AS negative FROM (SELECT e.vec_id, list_dot_product(e.v, neg.nv) AS d, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_dot_product(e.v, neg.nv) DESC) AS rn FROM emb e, neg) WHERE rn <= 2 GROUP BY vec_id),
s AS (SELECT e.vec_id, list_dot_product(e.v, c) AS positive, negative FROM emb e JOIN n USING (vec_id), cen)
SELECT vec_id, round(positive, 6) AS positive, round(negative, 6) AS negative, round(positive - 0.5 * negative, 6) AS score FROM s""")
def contrast(spark, sf):
    e = embeddings(spark, sf)
    out = vectors.contrast_scores(e, e.where("vec_id in (0, 1)"), e.where("vec_id in (5, 6, 7)"))
    return out.select("vec_id", *[r6(F.col(c)).alias(c) for c in ("positive", "negative", "score")])


@query("a7_a35_centroids", f"WITH {EMB}, cells AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb), m AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(x / n, 6) AS x FROM m JOIN n USING (label)")
def centroids(spark, sf):
    c = vectors.centroid(embeddings(spark, sf), ["label"])
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", r6(F.col("x")).alias("x"))


@query("a44_library_centring", f"""WITH {EMB}, cells AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb), m AS (SELECT pos, avg(x) AS mx FROM cells GROUP BY pos),
d AS (SELECT vec_id, pos, x - mx AS x FROM cells JOIN m USING (pos)), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM d GROUP BY 1) SELECT vec_id, round(max(x / n) FILTER (WHERE pos = 1), 6) AS first, round(max(x / n), 6) AS largest FROM d JOIN n USING (vec_id) GROUP BY 1""")
def centring(spark, sf):
    c = vectors.centred(embeddings(spark, sf))
    return c.select("vec_id", r6(F.col("v")[0]).alias("first"), r6(F.array_max("v")).alias("largest"))


@query("d24_reference_compare", f"WITH {SOURCES} SELECT source, vec_id, rank, round(score, 6) AS score FROM src WHERE seed = 0")
def reference_compare(spark, sf):
    return sources(spark, sf).where("seed = 0").select("source", "vec_id", "rank", r6(F.col("score")).alias("score"))


@query("a12_rrf", f"WITH {SOURCES}, f AS (SELECT seed, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank FROM src GROUP BY 1, 2) SELECT seed, vec_id, round(score, 6) AS score, best_rank, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, best_rank, vec_id) AS rank FROM f")
def rrf(spark, sf):
    f = fusion.rrf(sources(spark, sf), ["seed", "vec_id"])
    return fusion.ranked_by(f, ["seed"], F.desc(F.round("score", 9)), "best_rank", "vec_id").select("seed", "vec_id", r6(F.col("score")).alias("score"), "best_rank", "rank")


W = "CASE source WHEN 'full' THEN 0.5::DOUBLE WHEN 'left' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END"
WEIGHTS = {"full": 0.5, "left": 0.3, "right": 0.2}


@query("a13_a14_weighted_rrf", f"WITH {SOURCES} SELECT seed, vec_id, round(sum({W} / (60 + rank)), 6) AS score, round(sum({W} / (60 + rank)) / sum({W}), 6) AS renormalised FROM src GROUP BY 1, 2")
def weighted_rrf(spark, sf):
    s = sources(spark, sf)
    a = fusion.rrf(s, ["seed", "vec_id"], weights=WEIGHTS).select("seed", "vec_id", r6(F.col("score")).alias("score"))
    b = fusion.rrf(s, ["seed", "vec_id"], weights=WEIGHTS, renormalise=True).select("seed", "vec_id", r6(F.col("score")).alias("renormalised"))
    return a.join(b, ["seed", "vec_id"])


@query("a15_a16_normalised", f"WITH {SESSIONS} SELECT session_id, item_id, round(total / max(total) OVER w, 6) AS by_max, round(CASE WHEN max(total) OVER w = min(total) OVER w THEN 1 ELSE (total - min(total) OVER w) / (max(total) OVER w - min(total) OVER w) END, 6) AS by_range FROM sess WINDOW w AS (PARTITION BY session_id)")
def normalised(spark, sf):
    s = sessions(spark, sf)
    return s.select("session_id", "item_id", r6(fusion.max_normalised(F.col("total"), ["session_id"])).alias("by_max"), r6(fusion.minmax_normalised(F.col("total"), ["session_id"])).alias("by_range"))


@query("a28_source_coverage", f"WITH {SOURCES} SELECT source, count(DISTINCT seed) AS seeds, count(*) AS candidates, round(avg(score), 6) AS mean_score FROM src GROUP BY 1")
def source_coverage(spark, sf):
    return sources(spark, sf).groupBy("source").agg(F.count_distinct("seed").alias("seeds"), F.count(F.lit(1)).alias("candidates"), r6(F.avg("score")).alias("mean_score"))


@query("a33_seed_consensus", f"WITH {SOURCES}, f AS (SELECT seed, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(rank) AS best FROM src GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(s, 12) DESC, best, vec_id) AS rank FROM f), n AS (SELECT seed, count(DISTINCT source) AS sources FROM src GROUP BY 1) SELECT seed, sources, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS items FROM r JOIN n USING (seed) WHERE rank <= 5 GROUP BY 1, 2")
def seed_consensus(spark, sf):
    c = fusion.seed_consensus(sources(spark, sf), 5)
    return c.select("seed", F.size("sources_seen").cast("long").alias("sources"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("a32_recommended_weights", f"WITH {SOURCES}, m AS (SELECT source, count(DISTINCT seed) / (SELECT count(DISTINCT seed) FROM src)::DOUBLE AS coverage, avg(CAST(rank <= 10 AS DOUBLE)) AS consensus, 1 - stddev_pop(score) AS stability FROM src GROUP BY 1), w AS (SELECT source, greatest(0, coverage * consensus * stability) AS raw FROM m) SELECT source, round(raw / sum(raw) OVER (), 6) AS weight FROM w")
def recommended_weights(spark, sf):
    s = sources(spark, sf)
    m = s.groupBy("source").agg(F.count_distinct("seed").alias("n"), F.avg((F.col("rank") <= 10).cast("double")).alias("consensus"), (1 - F.stddev_pop("score")).alias("stability"))
    facts = m.crossJoin(F.broadcast(s.agg(F.count_distinct("seed").alias("all")))).select("source", (F.col("n") / F.col("all")).alias("coverage"), "consensus", "stability")
    return fusion.recommended_weights(facts).select("source", r6(F.col("weight")).alias("weight"))


@query("a29_reciprocal_support", f"""WITH {SOURCES}, o AS (SELECT DISTINCT source AS other FROM src), n AS (SELECT seed, source, vec_id, other FROM src, o WHERE rank <= 10 AND source <> other),
p AS (SELECT n.seed, n.source, n.vec_id, avg(coalesce(1.0::DOUBLE / h.rank, 0)) AS s FROM n LEFT JOIN src h ON h.seed = n.seed AND h.source = n.other AND h.vec_id = n.vec_id AND h.rank <= 10 GROUP BY 1, 2, 3) SELECT source, round(avg(s), 6) AS support FROM p GROUP BY 1""")
def support(spark, sf):
    return fusion.reciprocal_support(sources(spark, sf)).select("source", r6(F.col("support")).alias("support"))


@query("a30_a31_agreement", f"""WITH {SOURCES}, p AS (SELECT a.source AS l, b.source AS r, a.seed, list(a.vec_id) FILTER (WHERE a.rank <= 10) AS x, list(b.vec_id) FILTER (WHERE b.rank <= 10) AS y FROM (SELECT * FROM src WHERE rank <= 10) a JOIN (SELECT * FROM src WHERE rank <= 10) b ON a.seed = b.seed AND a.source < b.source GROUP BY 1, 2, 3),
o AS (SELECT l, r, avg(len(list_intersect(x, y))) AS overlap, avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))) AS jaccard FROM p GROUP BY 1, 2),
c AS (SELECT l, r, avg(c) AS correlation FROM (SELECT a.source AS l, b.source AS r, a.seed, CASE WHEN count(*) >= 2 AND stddev_pop(a.rank) > 0 AND stddev_pop(b.rank) > 0 THEN corr(a.rank, b.rank) END AS c FROM src a JOIN src b ON a.seed = b.seed AND a.vec_id = b.vec_id AND a.source < b.source GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT o.l AS "left", o.r AS "right", round(overlap, 6) AS overlap, round(jaccard, 6) AS jaccard, round(correlation, 6) AS correlation FROM o LEFT JOIN c ON o.l = c.l AND o.r = c.r""")
def agreement(spark, sf):
    return fusion.agreement(sources(spark, sf)).select("left", "right", *[r6(F.col(c)).alias(c) for c in ("overlap", "jaccard", "correlation")])


@query("w8_rank_percentile", f"WITH {SESSIONS} SELECT session_id, item_id, round(CASE WHEN count(*) OVER w = 1 THEN 1 ELSE 1 - (rank - 1) / (count(*) OVER w - 1) END, 6) AS pct FROM sess WINDOW w AS (PARTITION BY session_id)")
def rank_pct(spark, sf):
    return sessions(spark, sf).select("session_id", "item_id", r6(fusion.rank_percentile(["session_id"], F.col("rank"))).alias("pct"))


@query("w11_average_ranks", "SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS avg_rank FROM events")
def avg_ranks(spark, sf):
    return read(spark, sf, "events").select("event_id", fusion.average_rank(["event_type"], F.col("value")).cast("double").alias("avg_rank"))


@query("w7_limit_per_seed", f"WITH {SOURCES} SELECT seed, source, vec_id FROM src WHERE rank <= 5")
def limit_per_seed(spark, sf):
    w = Window.partitionBy("seed", "source").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return sources(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 5").select("seed", "source", "vec_id")


@query("w13_cascade", f"""WITH {SOURCES}, j AS (SELECT a.seed, a.vec_id, a.rank AS ra, b.rank AS rb FROM src a LEFT JOIN src b ON a.seed = b.seed AND a.vec_id = b.vec_id AND b.source = 'left' WHERE a.source = 'full')
SELECT seed, vec_id, row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN ra <= 10 THEN 0 ELSE 1 END, CASE WHEN ra <= 10 THEN coalesce(rb, 1000) ELSE ra END, ra) AS rank FROM j""")
def cascade(spark, sf):
    s = sources(spark, sf)
    a = s.where("source = 'full'").select("seed", "vec_id", F.col("rank").alias("ra"))
    b = s.where("source = 'left'").select("seed", "vec_id", F.col("rank").alias("rb"))
    head = F.col("ra") <= 10
    w = Window.partitionBy("seed").orderBy(F.when(head, 0).otherwise(1), F.when(head, F.coalesce("rb", F.lit(1000))).otherwise(F.col("ra")), "ra")
    return a.join(b, ["seed", "vec_id"], "left").select("seed", "vec_id", F.row_number().over(w).alias("rank"))


@query("w14_zscore_sum", f"WITH {PRED}, z AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(y) AS my, stddev_pop(y) AS sy FROM pred) SELECT doc_id, round((p - mp) / CASE WHEN sp = 0 THEN 1 ELSE sp END + (y - my) / CASE WHEN sy = 0 THEN 1 ELSE sy END, 6) AS z FROM pred, z")
def zscore(spark, sf):
    p = predictions(spark, sf)
    unit = lambda c: F.when(c == 0, 1.0).otherwise(c)
    m = p.agg(F.avg("p").alias("mp"), F.stddev_pop("p").alias("sp"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"))
    j = p.crossJoin(F.broadcast(m))
    return j.select("doc_id", r6((F.col("p") - F.col("mp")) / unit(F.col("sp")) + (F.col("y") - F.col("my")) / unit(F.col("sy"))).alias("z"))


@query("w15_rrf_grid", f"WITH {SOURCES}, g AS (SELECT unnest([10, 60, 200]) AS k), h AS (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS w), j AS (SELECT a.seed, a.vec_id, a.rank AS ra, b.rank AS rb FROM src a JOIN src b ON a.seed = b.seed AND a.vec_id = b.vec_id AND a.source = 'full' AND b.source = 'left') SELECT k, w, seed, vec_id, round(w / (k + ra) + (1 - w) / (k + rb), 6) AS score FROM j, g, h")
def rrf_grid(spark, sf):
    s = sources(spark, sf)
    a = s.where("source = 'full'").select("seed", "vec_id", F.col("rank").alias("ra"))
    b = s.where("source = 'left'").select("seed", "vec_id", F.col("rank").alias("rb"))
    grid = spark.createDataFrame([(k, w) for k in (10, 60, 200) for w in (0.25, 0.5, 0.75)], "k int, w double")
    j = a.join(b, ["seed", "vec_id"]).crossJoin(F.broadcast(grid))
    return j.select("k", "w", "seed", "vec_id", r6(F.col("w") / (F.col("k") + F.col("ra")) + (1 - F.col("w")) / (F.col("k") + F.col("rb"))).alias("score"))


PER_LIST = """x AS (SELECT *, CAST(rel >= 2 AS INTEGER) AS hit, row_number() OVER (PARTITION BY session_id ORDER BY rel DESC, rank) AS ideal, sum(CAST(rel >= 2 AS INTEGER)) OVER (PARTITION BY session_id ORDER BY rank) AS seen, sum(CAST(rel >= 2 AS INTEGER)) OVER (PARTITION BY session_id) AS r, count(*) OVER (PARTITION BY session_id) AS size FROM sess),
m AS (SELECT session_id, any_value(mode) AS any_mode, coalesce(sum(hit) FILTER (WHERE rank <= 10) / count(*) FILTER (WHERE rank <= 10), 0) AS "precision", CASE WHEN max(r) > 0 THEN sum(hit) FILTER (WHERE rank <= 10) / max(r) ELSE 0 END AS recall,
 sum((pow(2, rel) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10) AS dcg, sum((pow(2, rel) - 1) / log2(ideal + 1)) FILTER (WHERE ideal <= 10) AS idcg,
 CASE WHEN max(r) > 0 THEN coalesce(sum(hit * seen / rank) FILTER (WHERE rank <= 10), 0) / least(max(r), 10) ELSE 0 END AS ap,
 CASE WHEN min(rank) FILTER (WHERE hit = 1) <= 10 THEN 1 / min(rank) FILTER (WHERE hit = 1) ELSE 0 END AS rr, max(hit) FILTER (WHERE rank <= 10) AS hit,
 avg(CAST(rel <= 0 AS DOUBLE)) FILTER (WHERE rank <= 10) AS bad_rate, avg(CAST(rel = 3 AS DOUBLE)) FILTER (WHERE rank <= 10) AS strong_rate, avg(CAST(rel = 1 AS DOUBLE)) FILTER (WHERE rank <= 10) AS maybe_rate,
 CAST(coalesce((min(rank) FILTER (WHERE hit = 1) - 1) // 10, ceil(max(size) / 10)) AS BIGINT) AS clicks, CASE WHEN max(r) > 0 THEN sum(hit) FILTER (WHERE rank <= r) / max(r) ELSE 0 END AS r_precision FROM x GROUP BY session_id)"""
NAMES = ("precision", "recall", "dcg", "ndcg", "ap", "rr", "bad_rate", "strong_rate", "maybe_rate", "r_precision")


@query("m1_m12_list_metrics", f"""WITH {SESSIONS}, {PER_LIST} SELECT session_id, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(dcg, 6) AS dcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(ap, 6) AS ap, round(rr, 6) AS rr, hit, round(bad_rate, 6) AS bad_rate, round(strong_rate, 6) AS strong_rate, round(maybe_rate, 6) AS maybe_rate, clicks, round(r_precision, 6) AS r_precision FROM m""")
def list_metrics(spark, sf):
    out = metrics.list_metrics(sessions(spark, sf), ["session_id"])
    return out.select("session_id", "hit", "clicks", *[r6(F.col(c)).alias(c) for c in NAMES])


@query("m14_mode_report", f"""WITH sess AS (SELECT o_custkey AS session_id, o_orderstatus AS mode, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
m AS (SELECT mode, session_id, sum(CAST(rel >= 2 AS INTEGER)) FILTER (WHERE rank <= 10) / count(*) FILTER (WHERE rank <= 10) AS p, CASE WHEN min(rank) FILTER (WHERE rel >= 2) <= 10 THEN 1 / min(rank) FILTER (WHERE rel >= 2) ELSE 0 END AS rr, max(CAST(rel >= 2 AS INTEGER)) FILTER (WHERE rank <= 10) AS hit FROM sess GROUP BY 1, 2)
SELECT mode, count(*) AS lists, round(avg(p), 6) AS "precision", round(avg(rr), 6) AS mrr, round(avg(hit), 6) AS hit_rate FROM m GROUP BY 1""")
def mode_report(spark, sf):
    o = read(spark, sf, "orders")
    pr = F.col("o_orderpriority")
    s = o.select(F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("mode"), F.when(pr == "1-URGENT", 3).when(pr == "2-HIGH", 2).when(pr == "3-MEDIUM", 1).otherwise(0).alias("rel"), F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    per = metrics.list_metrics(s, ["mode", "session_id"])
    return metrics.mean_metrics(per, ["mode"], ["precision", "rr", "hit"]).select("mode", "lists", r6(F.col("precision")).alias("precision"), r6(F.col("rr")).alias("mrr"), r6(F.col("hit")).alias("hit_rate"))


@query("a17_quantiles", f"WITH {PRED}, q AS (SELECT unnest([0.0::DOUBLE, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS quantile, unnest(quantile_cont(p, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])) AS value FROM pred) SELECT quantile, round(value, 6) AS value FROM q")
def quantiles(spark, sf):
    return metrics.quantiles(predictions(spark, sf), "p").select("quantile", r6(F.col("value")).alias("value"))


BINS = f"{PRED}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM pred GROUP BY 1)"


@query("a18_reliability", f"WITH {BINS} SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(abs(mean_p - rate), 6) AS gap FROM range(10) r LEFT JOIN b ON b.bin = r.range")
def reliability(spark, sf):
    return metrics.reliability(predictions(spark, sf)).select("bin", "n", *[r6(F.col(c)).alias(c) for c in ("mean_p", "rate", "gap")])


@query("a19_a21_calibration", f"WITH {BINS}, e AS (SELECT sum(n * abs(mean_p - rate)) / sum(n) AS ece FROM b) SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(greatest(1e-15, least(1 - 1e-15, p))) + (1 - y) * ln(1 - greatest(1e-15, least(1 - 1e-15, p))))), 6) AS log_loss, round(any_value(ece), 6) AS ece FROM pred, e")
def calibration(spark, sf):
    return metrics.calibration(predictions(spark, sf)).select("n", *[r6(F.col(c)).alias(c) for c in ("brier", "log_loss", "ece")])


@query("a22_thresholds", f"WITH {PRED}, t AS (SELECT unnest([0.9::DOUBLE, 0.8, 0.7, 0.6, 0.5]) AS threshold) SELECT threshold, count(*) FILTER (WHERE p >= threshold) AS n, count(*) FILTER (WHERE p >= threshold AND y = 1) AS positives, round(CASE WHEN count(*) FILTER (WHERE p >= threshold) > 0 THEN count(*) FILTER (WHERE p >= threshold AND y = 1) / count(*) FILTER (WHERE p >= threshold) ELSE 0 END, 6) AS \"precision\", round(count(*) FILTER (WHERE p >= threshold AND y = 1) / sum(y), 6) AS recall FROM pred, t GROUP BY 1")
def thresholds(spark, sf):
    return metrics.thresholds(predictions(spark, sf)).select("threshold", "n", "positives", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("a23_score_histogram", f"WITH {PRED}, b AS (SELECT CAST(least(floor(p * 5), 4) AS INTEGER) AS bin, count(*) AS n FROM pred GROUP BY 1) SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(5) r LEFT JOIN b ON b.bin = r.range")
def histogram(spark, sf):
    return metrics.reliability(predictions(spark, sf), 5).select("bin", "n")


@query("a27_judged_gate", "WITH l AS (SELECT DISTINCT user_id AS seed, event_id % 100 AS cand, event_type AS source, 0 AS z FROM events), r AS (SELECT user_id AS seed, event_id % 100 AS cand, event_type AS source, max(CAST(floor(value) AS BIGINT) % 4) AS rating FROM events GROUP BY ALL) SELECT count(*) AS labels, count(DISTINCT seed) AS seeds, CAST(sum(CAST(rating >= 2 AS INTEGER)) AS BIGINT) AS positive, CASE WHEN count(*) < 50 THEN 'insufficient' WHEN count(*) < 200 THEN 'diagnostics' WHEN count(*) < 500 THEN 'candidate_profile' ELSE 'default_review' END AS status FROM r")
def judged_gate(spark, sf):
    labels = read(spark, sf, "events").groupBy(F.col("user_id").alias("seed"), (F.col("event_id") % 100).alias("cand"), F.col("event_type").alias("source")).agg(F.max(F.floor("value") % 4).alias("rating"))
    return metrics.judged_gate(labels)


@query("a39_auc_by_source", f"WITH {PRED}, r AS (SELECT source, y, rank() OVER (PARTITION BY source ORDER BY p) + (count(*) OVER (PARTITION BY source, p) - 1) / 2.0::DOUBLE AS r FROM pred), g AS (SELECT source, sum(r) FILTER (WHERE y = 1) AS s, sum(y) AS np, count(*) - sum(y) AS nn FROM r GROUP BY 1) SELECT source, round(CASE WHEN np > 0 AND nn > 0 THEN (s - np * (np + 1) / 2) / (np * nn) END, 6) AS auc FROM g")
def auc(spark, sf):
    return metrics.auc(predictions(spark, sf), ["source"]).select("source", r6(F.col("auc")).alias("auc"))


@query("a39_average_precision", f"WITH {PRED}, l AS (SELECT p, sum(y) AS pos, count(*) AS n FROM pred GROUP BY 1), r AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM l) SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM r")
def avg_precision(spark, sf):
    return metrics.average_precision(predictions(spark, sf)).select(r6(F.col("average_precision")).alias("average_precision"))


@query("m16_operating_points", f"WITH {PRED}, l AS (SELECT p, sum(y) AS pos, count(*) AS n FROM pred GROUP BY 1), r AS (SELECT sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS total FROM l) SELECT round(max(tp / total) FILTER (WHERE tp / seen >= 0.8), 6) AS recall_at_precision, round(max(tp / seen) FILTER (WHERE tp / total >= 0.8), 6) AS precision_at_recall FROM r")
def operating_points(spark, sf):
    return metrics.operating_points(predictions(spark, sf)).select(*[r6(F.col(c)).alias(c) for c in ("recall_at_precision", "precision_at_recall")])


@query("a40_spearman_lift", f"WITH {PRED}, r AS (SELECT y, row_number() OVER (ORDER BY p DESC, doc_id) AS rn, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (ORDER BY toxic) + (count(*) OVER (PARTITION BY toxic) - 1) / 2.0::DOUBLE AS rt FROM pred) SELECT round(corr(rp, rt), 6) AS spearman, round(avg(y) FILTER (WHERE rn <= 100) / avg(y), 6) AS lift FROM r")
def spearman(spark, sf):
    p = predictions(spark, sf)
    ranked = fusion.with_average_ranks(fusion.with_average_ranks(p, "p", "rp"), "toxic", "rt")
    top = p.orderBy(F.desc("p"), "doc_id").limit(100).agg(F.avg("y").alias("top"))
    return ranked.agg(r6(F.corr("rp", "rt")).alias("spearman"), F.avg("y").alias("mean")).crossJoin(top).select("spearman", r6(F.col("top") / F.col("mean")).alias("lift"))


@query("a41_a42_best_variant", f"WITH {SOURCES}, m AS (SELECT source, avg(score) AS mean FROM src GROUP BY 1) SELECT source, round(mean, 6) AS mean, round(mean - (SELECT mean FROM m WHERE source = 'full'), 6) AS delta, mean = (SELECT max(mean) FROM m) AS best FROM m")
def best_variant(spark, sf):
    m = sources(spark, sf).groupBy("source").agg(F.avg("score").alias("mean"))
    facts = m.agg(F.max(F.when(F.col("source") == "full", F.col("mean"))).alias("base"), F.max_by("source", "mean").alias("top"))
    return m.crossJoin(F.broadcast(facts)).select("source", r6(F.col("mean")).alias("mean"), r6(F.col("mean") - F.col("base")).alias("delta"), (F.col("source") == F.col("top")).alias("best"))


@query("d17_ablation", f"""WITH {SOURCES}, v AS (SELECT * FROM (VALUES ('all', 'full'), ('all', 'left'), ('all', 'right'), ('full', 'full'), ('left', 'left'), ('right', 'right'), ('no_full', 'left'), ('no_full', 'right'), ('no_left', 'full'), ('no_left', 'right'), ('no_right', 'full'), ('no_right', 'left')) t(variant, source)),
f AS (SELECT variant, seed, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best FROM src JOIN v USING (source) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY variant, seed ORDER BY round(score, 9) DESC, best, vec_id) AS rank FROM f)
SELECT variant, round(avg(CAST(e.label = s.label AS DOUBLE)), 6) AS same_label FROM r JOIN emb e USING (vec_id) JOIN emb s ON s.vec_id = r.seed WHERE r.rank <= 10 GROUP BY 1""")
def ablation(spark, sf):
    names = ["full", "left", "right"]
    variants = [("all", n) for n in names] + [(n, n) for n in names] + [(f"no_{n}", m) for n in names for m in names if m != n]
    v = spark.createDataFrame(variants, "variant string, source string")
    f = fusion.rrf(sources(spark, sf).join(F.broadcast(v), "source"), ["variant", "seed", "vec_id"])
    r = fusion.ranked_by(f, ["variant", "seed"], F.desc(F.round("score", 9)), "best_rank", "vec_id").where("rank <= 10")
    e = embeddings(spark, sf).select("vec_id", "label")
    j = r.join(e, "vec_id").join(e.select(F.col("vec_id").alias("seed"), F.col("label").alias("seed_label")), "seed")
    return j.groupBy("variant").agg(r6(F.avg((F.col("label") == F.col("seed_label")).cast("double"))).alias("same_label"))


@query("d16_d19_risk_sweep", f"""WITH {SOURCES}, f AS (SELECT seed, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS raw, min(rank) AS best, count(*) AS n FROM src GROUP BY 1, 2), g AS (SELECT *, raw / max(raw) OVER (PARTITION BY seed) AS norm, 1 - n / 3 AS risk FROM f), w AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 1.0]) AS w)
SELECT w, seed, vec_id, round(norm - w * risk, 6) AS adjusted, row_number() OVER (PARTITION BY w, seed ORDER BY round(norm - w * risk, 9) DESC, round(raw, 9) DESC, best, vec_id) AS rank FROM g, w""")
def risk_sweep(spark, sf):
    f = fusion.rrf(sources(spark, sf), ["seed", "vec_id"])
    g = f.withColumn("norm", fusion.max_normalised(F.col("score"), ["seed"])).withColumn("risk", 1 - F.col("source_count") / 3)
    weights = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,)], "w double")
    a = g.crossJoin(F.broadcast(weights)).withColumn("adjusted", F.col("norm") - F.col("w") * F.col("risk"))
    out = fusion.ranked_by(a, ["w", "seed"], F.desc(F.round("adjusted", 9)), F.desc(F.round("score", 9)), "best_rank", "vec_id")
    return out.select("w", "seed", "vec_id", r6(F.col("adjusted")).alias("adjusted"), "rank")


@query("u7_d20_weight_grid", f"""WITH {SOURCES}, g AS (SELECT a / 4 AS wf, b / 4 AS wl, (4 - a - b) / 4 AS wr FROM range(5) x(a), range(5) y(b) WHERE a + b <= 4),
f AS (SELECT wf, wl, wr, seed, vec_id, sum(CASE source WHEN 'full' THEN wf WHEN 'left' THEN wl ELSE wr END / (60 + rank)) AS s FROM src, g GROUP BY ALL) SELECT wf, wl, wr, round(avg(s), 6) AS mean_score FROM f GROUP BY ALL""")
def weight_grid(spark, sf):
    grid = spark.createDataFrame([(w["full"], w["left"], w["right"]) for w in fusion.simplex(["full", "left", "right"], 0.25)], "wf double, wl double, wr double")
    w = F.when(F.col("source") == "full", F.col("wf")).when(F.col("source") == "left", F.col("wl")).otherwise(F.col("wr"))
    f = sources(spark, sf).crossJoin(F.broadcast(grid)).groupBy("wf", "wl", "wr", "seed", "vec_id").agg(F.sum(w / (60 + F.col("rank"))).alias("s"))
    return f.groupBy("wf", "wl", "wr").agg(r6(F.avg("s")).alias("mean_score"))
