"""Classifier studies, data checks, nearest-neighbour recall and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandex.functions import expr as X
from strandex.operators import ann, classifiers, quality
from strandex.plans.base import registrar
from strandex.plans.views import CLASSIFIER, FEATURES, TRACKS, classifier_scores, embeddings, features, r6, read, tracks
from strandex.runtime import shared_path
from strandex.streaming import events as streams

QUERIES, ORACLES, query = registrar()

FEEDBACK = "fb AS (SELECT event_id % 2000 AS cand, count(*) AS n, count(*) FILTER (WHERE CAST(floor(value) AS BIGINT) % 4 >= 2) AS positive, count(*) FILTER (WHERE CAST(floor(value) AS BIGINT) % 4 <= 1) AS negative, avg(CAST(floor(value) AS BIGINT) % 4) AS mean FROM events GROUP BY 1)"


def _feedback(spark, sf):
    e = read(spark, sf, "events").select((F.col("event_id") % 2000).alias("cand"), (F.floor("value") % 4).alias("rating"))
    return classifiers.feedback_totals(e)


@query("a25_feedback_totals", f"WITH {FEEDBACK} SELECT cand, n, positive, negative, round(mean, 6) AS mean FROM fb")
def feedback_totals(spark, sf):
    return _feedback(spark, sf).select("cand", "n", "positive", "negative", r6(F.col("mean")).alias("mean"))


@query("a26_d26_classifier_report", f"WITH {TRACKS}, {CLASSIFIER} SELECT classifier_key, count(*) AS scored, count(*) FILTER (WHERE score < 0.3) AS low, count(*) FILTER (WHERE score >= 0.3 AND score < 0.7) AS medium, count(*) FILTER (WHERE score >= 0.7) AS high, (SELECT count(*) FROM tracks) AS total, round(count(*) / (SELECT count(*) FROM tracks), 6) AS coverage FROM cls GROUP BY 1")
def classifier_report(spark, sf):
    return classifiers.coverage(classifier_scores(spark, sf), tracks(spark, sf)).withColumn("coverage", r6(F.col("coverage")))


@query("d27_suggest_uncertain", f"WITH {CLASSIFIER}, s AS (SELECT track_id, score, round(abs(score - 0.5), 9) AS o, substr(sha256('123:uncertainty:' || track_id), 1, 16) AS tie FROM cls WHERE classifier_key = 'voice') SELECT track_id, round(score, 6) AS score, row_number() OVER (ORDER BY o, tie) AS rank FROM s ORDER BY rank LIMIT 25")
def suggest_uncertain(spark, sf):
    own = classifier_scores(spark, sf).where("classifier_key = 'voice'")
    return classifiers.suggestions(own, _feedback(spark, sf), "uncertainty").select("track_id", r6(F.col("score")).alias("score"), "rank")


@query("t10_suggest_disagreement", f"WITH {CLASSIFIER}, {FEEDBACK}, s AS (SELECT track_id, score, round(-abs(score - coalesce(mean / 3, score)), 9) AS o, substr(sha256('123:disagreement:' || track_id), 1, 16) AS tie FROM cls LEFT JOIN fb ON cand = track_id WHERE classifier_key = 'voice') SELECT track_id, round(score, 6) AS score, row_number() OVER (ORDER BY o, tie) AS rank FROM s ORDER BY rank LIMIT 25")
def suggest_disagreement(spark, sf):
    own = classifier_scores(spark, sf).where("classifier_key = 'voice'")
    return classifiers.suggestions(own, _feedback(spark, sf), "disagreement").select("track_id", r6(F.col("score")).alias("score"), "rank")


@query("a43_label_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def label_counts(spark, sf):
    return read(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("l4_stratified_folds", "SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY substr(sha256('42:' || doc_id), 1, 16), doc_id) - 1) % 5 AS fold FROM labels")
def stratified_folds(spark, sf):
    return classifiers.folds(read(spark, sf, "labels"), "quality", "doc_id").select("doc_id", "quality", "fold")


def _document_features(spark, sf):
    d = read(spark, sf, "documents")
    words = F.size(F.split("text", " ")).cast("double")
    rows = d.select("doc_id", F.col("n_chars").cast("double").alias("chars"), words.alias("words"), (F.length(F.regexp_replace("text", r"[\p{L}\s]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("odd"))
    return rows


def _labelled_features(spark, sf):
    return _document_features(spark, sf).join(read(spark, sf, "labels"), "doc_id")


@query("l1_l3_d28_train_and_score")
def train_and_score(spark, sf):
    """Learned from the labelled documents of folds 1 to 4; every document is scored, with its fold where it has a label."""
    dealt = classifiers.folds(_labelled_features(spark, sf), "quality", "doc_id")
    model = classifiers.train_logistic(dealt.where("fold > 0"), ["chars", "words", "odd"], "quality")
    rows = _document_features(spark, sf).join(dealt.select("doc_id", "fold"), "doc_id", "left")
    return classifiers.score_with(model, rows, "doc_id", "fold")


@query("l4_validation_metrics")
def validation_metrics(spark, sf):
    """Five folds, each scored by a model of the other four: mean and deviation of the folds' metrics."""
    scored = classifiers.cross_validated(_labelled_features(spark, sf), ["chars", "words", "odd"], "quality", "doc_id")
    return classifiers.fold_summary(scored, "quality").select("metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "folds")


@query("v1_v4_findings", f"""WITH {FEATURES} SELECT 'bpm_range' AS code, track_id::VARCHAR AS key FROM feat WHERE bpm NOT BETWEEN 75 AND 165 UNION ALL SELECT 'energy_unit', track_id::VARCHAR FROM feat WHERE NOT (energy BETWEEN 0 AND 0.51)
UNION ALL SELECT 'orphan_line', l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 17 <> 0) UNION ALL SELECT 'duplicate_name', lower(p_name) FROM part GROUP BY lower(p_name) HAVING count(*) > 1""")
def findings(spark, sf):
    f = features(spark, sf)
    p = read(spark, sf, "part")
    rules = {"bpm_range": F.col("bpm").between(75, 165), "energy_unit": F.col("energy").between(0, 0.51)}
    return quality.report(
        quality.findings(f, "track_id", rules),
        quality.orphans(read(spark, sf, "lineitem"), "l_partkey", p.where("p_partkey % 17 <> 0"), "p_partkey", "orphan_line"),
        quality.duplicates(p.select(F.lower("p_name").alias("name")), ["name"], "duplicate_name"),
    )


@query("v4_probability_check", "SELECT event_id, abs((event_id % 11) / 10 + 0.3 - 1) <= 1e-6 AND (event_id % 11) / 10 <= 1 AS valid FROM events")
def probability_check(spark, sf):
    p = F.create_map(F.lit("a"), (F.col("event_id") % 11) / 10, F.lit("b"), F.lit(0.3))
    return read(spark, sf, "events").select("event_id", quality.probabilities_valid(p).alias("valid"))


@query("l10_feature_inventory", f"WITH {FEATURES} SELECT 'bpm' AS name, count(bpm) AS present, count(*) - count(bpm) AS missing FROM feat UNION ALL SELECT 'key', count(key), count(*) - count(key) FROM feat UNION ALL SELECT 'density', count(density), count(*) - count(density) FROM feat")
def inventory(spark, sf):
    names = ("bpm", "key", "density")
    f = features(spark, sf).agg(*[F.count(n).alias(n) for n in names], F.count(F.lit(1)).alias("total"))
    return f.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("present"), (F.col("total") - F.col(n)).alias("missing")) for n in names])).alias("r")).select("r.*")


@query("i1_i4_ann_recall")
def ann_recall(spark, sf):
    """Every vector is indexed; queries are the vectors whose id is divisible by 50."""
    items = embeddings(spark, sf)
    spec = ann.IndexSpec(64)
    path = shared_path(spark, "index")
    ann.build(items, spec, path)
    index, spec = ann.load(items, path)
    queries = items.where("vec_id % 50 = 0")
    return ann.recall(ann.search(items, index, spec, queries, 10), ann.exact(items, queries, 10))


@query("r_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    return streams.windowed(read(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("r_sliding_windows", "SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2")
def sliding(spark, sf):
    return streams.windowed(read(spark, sf, "events"), "1 hour", "30 minutes").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("r_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, no")
def event_sessions(spark, sf):
    return streams.sessions(read(spark, sf, "events")).select("user_id", "start", "n", F.round("total", 4).alias("total"))


@query("x33_canonical_json", "SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS body, sha256('{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}') AS seal FROM events")
def canonical_json(spark, sf):
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return read(spark, sf, "events").select("event_id", body.alias("body"), F.sha2(body, 256).alias("seal"))


@query("x25_path_keys", "SELECT page_id, lower(rtrim(regexp_replace(replace(url, '\\', '/'), '/+', '/', 'g'), '/')) AS key FROM pages")
def path_keys(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.path_key(F.col("url")).alias("key"))
