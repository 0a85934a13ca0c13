"""Toy cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from strandex.functions import expr as X
from strandex.functions import python
from strandex.operators import ann, classifiers, dedup, fusion, library, metrics, ranks, tempo, transition, vectors
from strandex.operators.graph import connected_components
from strandex.plans import ranking, studies
from strandex.sources import tables
from strandex.streaming import events
from tests.conftest import SF


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def row_of(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def ranked(spark, *lists):
    rows = [(s, i + 1, r) for s, rels in enumerate(lists) for i, r in enumerate(rels)]
    return spark.createDataFrame(rows, "s int, rank int, rel int")


def test_list_metrics(spark):
    got = {r.s: r for r in metrics.list_metrics(ranked(spark, [3, 0, 2], [0, 3, 2], [0, 0, 3]), ["s"], 2).collect()}
    assert got[0].precision == 0.5
    three = {r.s: r for r in metrics.list_metrics(ranked(spark, [0, 3, 2], [3, 2]), ["s"], 3).collect()}
    assert three[0].ap == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert three[1].dcg == pytest.approx(7 + 3 / math.log2(3))


def test_clicks(spark):
    got = {r.s: r.clicks for r in metrics.list_metrics(ranked(spark, [0] * 10 + [3], [0] * 25), ["s"], 10).collect()}
    assert got == {0: 1, 1: 3}


def test_rrf_does_not_renormalise(spark):
    rows = spark.createDataFrame([(1, "mert", 2), (1, "maest", 4), (2, "maest", 3)], "item int, source string, rank int")
    got = {r.item: r.score for r in fusion.rrf(rows, ["item"], weights={"mert": 0.75, "maest": 0.25}).collect()}
    assert got[1] == pytest.approx(0.75 / 62 + 0.25 / 64)
    assert got[2] == pytest.approx(0.25 / 63)


def test_tempo_and_key(spark):
    assert one(spark, X.tempo_distance(F.lit(60.0), F.lit(120.0))) == 0
    pairs = {("8A", "8A"): 1.0, ("8A", "9A"): 0.95, ("12B", "1B"): 0.95, ("8A", "8B"): 0.9, ("8A", "3B"): 0.2}
    for (a, b), score in pairs.items():
        assert one(spark, X.camelot_score(F.lit(a), F.lit(b))) == score
    assert one(spark, X.camelot_score(F.lit(None).cast("string"), F.lit("8A"))) == 0.55


def test_clamp_of_what_is_not_finite(spark):
    nan = F.lit(float("nan"))
    assert one(spark, X.clamp01(nan, 1.0)) == 1.0
    assert one(spark, X.clamp01(nan)) == 0.0
    assert one(spark, X.clamp01(F.lit(None).cast("double"))) is None


def test_weighted_mean_skips_missing(spark):
    none = F.lit(None).cast("double")
    assert one(spark, X.weighted_mean_available([(F.lit(1.0), 1.0), (none, 5.0), (F.lit(0.0), 3.0)])) == 0.25
    assert one(spark, X.weighted_mean_available([(none, 1.0)])) is None


def test_seed_search(spark):
    pad = [0.0] * 3
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.7071068, 0.7071068, 0.0]), (4, [0.0, 0.0, 1.0])]
    items = spark.createDataFrame([(i, v + pad) for i, v in rows], "vec_id long, v array<double>")
    seeds = items.where("vec_id < 3").select("vec_id")
    got = vectors.seed_search(items, seeds, vectors.SearchFilters()).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 4]
    with pytest.raises(ValueError):
        vectors.SearchFilters(limit=0)


def test_epsilon_band_is_whole(spark, tmp_path):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), *[(i, 0, [1.0, 0.0]) for i in range(2, 702)], (702, 0, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = ranking.QUERIES["f12_epsilon_band"](spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in got) == list(range(2, 702))


def test_every_document_is_scored(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    complete = {r.doc_id for r in docs.where("text IS NOT NULL AND n_chars IS NOT NULL").collect()}
    rows = studies.QUERIES["l1_l3_d28_train_and_score"](spark, SF).collect()
    assert len(rows) == len(complete) and {r.doc_id for r in rows} == complete
    assert {r.doc_id for r in rows if r.fold is not None} == complete & {r.doc_id for r in labels.collect()}
    assert {r.fold for r in rows} == {None, 0, 1, 2, 3, 4}


def test_folds_are_each_validated_by_the_others(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, float(x), int(x + rng.normal() > 0)) for i, x in enumerate(rng.normal(size=200))], "id long, x double, y int")
    scored = classifiers.cross_validated(rows, ["x"], "y", "id")
    kept = scored.collect()
    assert sorted(r.id for r in kept) == list(range(200)) and {r.fold for r in kept} == {0, 1, 2, 3, 4}
    got = {r.metric: (r["mean"], r["std"]) for r in classifiers.fold_summary(scored, "y").collect()}
    accuracy = [np.mean([r.predicted == r.y for r in kept if r.fold == f]) for f in range(5)]
    recall = [np.mean([r.predicted for r in kept if r.fold == f and r.y]) for f in range(5)]
    assert got["accuracy"] == pytest.approx((np.mean(accuracy), np.std(accuracy))) and got["recall"] == pytest.approx((np.mean(recall), np.std(recall))) and got["accuracy"][0] > 0.6


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (3, 4), (4, 4)] + [(i, i + 1) for i in range(100, 160)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}
    assert all(got[i] == 100 for i in range(100, 161))
    assert connected_components(edges.limit(0)).count() == 0


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, v string")
    got = {r.k: (r.v, r.action) for r in library.upsert(old, new, ["k"], ["v"]).collect()}
    assert got == {1: ("a", "kept"), 2: ("b", "unchanged"), 3: ("x", "updated"), 4: ("d", "added")}


def test_like_escapes(spark):
    rows = spark.createDataFrame([(1, "50% off"), (2, "500 off"), (3, "a_b"), (4, "axb")], "id int, t string")
    assert [r.id for r in library.like_search(rows, "50%", ["t"]).collect()] == [1]
    assert [r.id for r in library.like_search(rows, "A_b", ["t"]).collect()] == [3]


def test_strict_selection(spark):
    rows = spark.range(5).withColumnRenamed("id", "track_id")
    assert [r.track_id for r in library.select_in_order(rows, [3, 1, 3]).collect()] == [3, 1, 3]
    with pytest.raises(KeyError):
        library.select_in_order(rows, [9])


def test_band_pairs_equal_theta_join(spark):
    rows = spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(60)], "id int, x double")
    got = {(r.a, r.b) for r in dedup.band_pairs(rows, "id", "x", 7.0).collect()}
    v = {i: (i * 37) % 101 for i in range(60)}
    assert got == {(a, b) for a in v for b in v if a < b and abs(v[a] - v[b]) <= 7}


def test_index_refuses_changed_items(spark, tmp_path):
    items = spark.createDataFrame([(i, [math.sin(i * j + 1.0) for j in range(1, 9)]) for i in range(40)], "vec_id long, v array<double>")
    path = f"file://{tmp_path}/index"
    ann.build(items, ann.IndexSpec(8, 4, 3), path)
    index, spec = ann.load(items, path)
    assert ann.search(items, index, spec, items.limit(3), 5).count() > 0
    with pytest.raises(ValueError):
        ann.load(items.where("vec_id > 0"), path)


def test_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seed_track_id,candidate_track_id,rating,reason_tags,notes,source\n1,2,3,good_groove, ,manual\n1,3,0,\"a, b\",,\n")
    rows = tables.read_labels(spark, f"file://{tmp_path}/a.csv").collect()
    assert [(r.rating, r.reason_tags, r.source) for r in rows] == [(3, ["good_groove"], "manual"), (0, ["a", "b"], "manual")]
    (tmp_path / "b.jsonl").write_text('{"seed_track_id": 1, "candidate_track_id": 2, "rating": 7}\n')
    with pytest.raises(Exception, match="bad label"):
        tables.read_labels(spark, f"file://{tmp_path}/b.jsonl").collect()


def test_playlist_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", "One", "/x/1.mp3"), (2, "B", "Two", "/x/2.mp3")], "position int, artist string, title string, path string")
    tables.write_playlist(rows, f"file://{tmp_path}/list")
    got = tables.read_playlist(spark, f"file://{tmp_path}/list/*.txt").orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, "A", "One", "/x/1.mp3"), (2, "B", "Two", "/x/2.mp3")]


def test_event_stream_equals_batch(spark, tmp_path):
    from tests.conftest import SF

    source = tmp_path / "in"
    source.mkdir()
    (source / "e.parquet").symlink_to(f"{SF}/events.parquet")
    seen = []
    stream = events.windowed(events.distinct_events(events.read_events(spark, f"file://{source}", "40 days")), "1 day")
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.windowed(spark.read.parquet(f"{SF}/events.parquet"), "1 day").collect()
    assert {(r.start, r.event_type, r.n) for r in seen} == {(r.start, r.event_type, r.n) for r in batch}


def test_incremental_work_sees_new_files_once(spark, tmp_path):
    from tests.conftest import SF

    source, seen = tmp_path / "in", []
    source.mkdir()
    rows = spark.read.parquet(f"{SF}/events.parquet")
    for part in (0, 1):
        rows.where(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(f"file://{source}")
        events.incremental(events.read_events(spark, f"file://{source}"), lambda df, n: seen.extend(r.event_id for r in df.collect()), f"file://{tmp_path}/cp").awaitTermination()
        assert sorted(seen) == sorted(r.event_id for r in rows.where(f"event_id % 2 <= {part}").collect())


def test_tempo_deltas(spark):
    lit = lambda x: F.lit(float(x))
    row = row_of(spark, *[X.relative_tempo_delta(lit(a), lit(b)) for a, b in ((65, 120), (120, 65), (60, 240), (128.8, 64))])
    assert list(row) == pytest.approx([10 / 120, 5 / 65, 0.5, 0.8 / 128])
    risks = row_of(spark, *[transition.plain_bpm_risk(lit(a), lit(b)) for a, b in ((64, 128.8), (60, 240), (130, 132), (100, 104), (0, 100))])
    assert list(risks) == [pytest.approx(0.0520833333), 1.0, pytest.approx(2 / 130 / 0.12), pytest.approx(4 / 100 / 0.12), None]


def evidence(bpm=None, confidence=None, grid=None, candidates="[]", tag=None):
    lit = lambda x: F.lit(x).cast("double")
    return tempo.evidence(lit(bpm), lit(confidence), lit(grid), tempo.candidate_tempi(F.lit(candidates)), lit(tag))


def test_tempo_evidence(spark):
    cases = [
        (evidence(120, 0.9, 0.25), (120.0, [120.0], "measured", math.sqrt(0.9 * 0.25))),
        (evidence(120, 0.2, None, "[[120, 0.5], [90.0, 0.2], 60]", 91), (91.0, [120.0, 90.0, 60.0, 91.0], "tag_confirmed", 0.2)),
        (evidence(120, 0.2, None, "not json", 80), (120.0, [120.0], "measured_low", 0.2)),
        (evidence(120, None, None, "[90]", 90), (120.0, [120.0, 90.0], "measured_low", 0.0)),
        (evidence(None, 0.9, 0.9, "[90]", 100), (100.0, [100.0], "tag", 1.0)),
        (evidence(500, 0.9, None, "[90]", None), (None, [], None, 0.0)),
    ]
    for got, (bpm, alternatives, source, reliability) in zip(row_of(spark, *[c for c, _ in cases]), [w for _, w in cases], strict=True):
        assert (got.bpm, got.alternatives, got.source) == (bpm, alternatives, source) and got.reliability == pytest.approx(reliability)
    made = {"sure": evidence(128, 1.0), "unsure": evidence(128, 0.25), "unknown": evidence(128), "none": evidence(), "half": evidence(64, 1.0), "other": evidence(1e2, 0.81), "slow": evidence(60, 1.0), "fast": evidence(240, 1.0)}
    sure, unsure, unknown, none, half, other, slow, fast = (F.col(n) for n in made)
    row = spark.range(1).select(*[c.alias(n) for n, c in made.items()]).select(*[c.alias(f"c{i}") for i, c in enumerate([tempo.score(sure, half), tempo.score(sure, unsure), tempo.score(sure, unknown), tempo.score(sure, none), tempo.pair_reliability(other, unsure), tempo.score(slow, fast), tempo.target_score(sure, F.lit(64.0), 8.0), tempo.risk(sure, unknown)])]).first()
    assert list(row) == [1.0, 0.75, 0.5, None, pytest.approx(0.45), 0.0, 0.0, 0.5]


def test_transition_parts(spark):
    null = F.lit(None).cast("double")
    row = row_of(
        spark,
        transition.plain_key_risk(F.lit("8A"), F.lit("9A")), transition.plain_key_risk(F.lit("8A"), F.lit("2B")), transition.plain_key_risk(F.lit("odd"), F.lit(" ODD")),
        transition.key_risk(F.lit("8A"), F.lit("9A"), null, null), transition.source_risk(F.lit(1), F.lit(4)), transition.source_risk(F.lit(1), F.lit(0)),
        transition.grid_risk(F.lit(0.81), F.lit(1.0)), transition.grid_risk(F.lit(0.81), null), transition.missing_risk([F.lit(0.1), null, null]), transition.missing_risk([null, null]),
        transition.vocal_risk(F.create_map(F.lit("Lead_Voice"), F.lit(0.2)), F.create_map(F.lit("Lead_Voice"), F.lit(0.7), F.lit("groove"), F.lit(1.0))),
        transition.vocal_risk(F.create_map(F.lit("x"), F.lit(0.2)), F.create_map(F.lit("voice"), F.lit(0.7)), {"voice": 0.5}),
        transition.feature_similarity(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(1.0)), True), X.camelot_relation(F.lit("8A"), F.lit("8B")),
    )
    want = [0.05, 0.8, 0.0, 0.05, 0.75, None, 0.1, None, 0.35 * 2 / 3, None, 0.5, 0.35, 1.0, "relative"]
    assert [x if isinstance(x, str) or x is None else round(x, 9) for x in row] == [x if isinstance(x, str) or x is None else round(x, 9) for x in want]
    parts = {"bpm": F.lit(0.2), "key": null, "energy": F.lit(0.8)}
    assert one(spark, transition.total(parts)) == pytest.approx(0.5)
    assert one(spark, transition.warnings(parts)) == ["missing_key", "high_energy"]


def test_numbered_equals_one_window(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11, float(i % 5)) for i in range(500)], "id int, x int, w double").repartition(7)
    got = {r.id: (r["rank"], r.upto) for r in ranks.numbered(rows, [F.desc("x"), F.col("id")], running={"upto": "w"}).collect()}
    order, total = sorted(range(500), key=lambda i: (-((i * 37) % 11), i)), 0.0
    for n, i in enumerate(order, 1):
        total += i % 5
        assert got[i] == (n, total)
    assert ranks.numbered(rows.limit(0), [F.col("id")]).count() == 0
    averaged = fusion.with_average_ranks(rows, "x", "r").collect()
    assert all(r.r == pytest.approx(sum(1 for i in range(500) if (i * 37) % 11 < r.x) + (sum(1 for i in range(500) if (i * 37) % 11 == r.x) + 1) / 2) for r in averaged)


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 8)
    data = {i: [math.sin(i * j + 1.0) for j in range(1, 6)] for i in range(90)} | {200 + i: [1.0, 2.0, 3.0, 4.0, 5.0] for i in range(30)} | {500: [0.0] * 5}
    rows = spark.createDataFrame(list(data.items()), "vec_id long, v array<double>").repartition(3)
    unit = {i: [x / (math.sqrt(sum(y * y for y in v)) or 1.0) for x in v] for i, v in data.items()}
    got = {}
    for r in vectors.nearest(rows, rows.where("vec_id % 5 = 0"), 7).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [i for i in sorted(data) if i % 5 == 0]
    for q, found in got.items():
        score = {i: sum(a * b for a, b in zip(unit[i], unit[q], strict=True)) for i in data if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:7]
        assert [i for _, i, _ in sorted(found)] == want


def test_python_rules(spark):
    rows = spark.createDataFrame([("Ｂjörk – Ｏne", 2.675, 7), (None, None, None)], "name string, seconds double, id long")
    got = rows.select(python.identity_text("name").alias("n"), python.stored_duration("seconds").alias("d"), python.tie_breaker(F.lit("groove"), F.lit("low"), F.col("id"), F.lit(3)).alias("t")).collect()
    import hashlib

    assert (got[0].n, got[0].d) == ("björkone".replace("̈", ""), 2.67) and int(got[0].t) == int.from_bytes(hashlib.blake2b(b"groove:low:3:7", digest_size=8).digest(), "big")
    assert (got[1].n, got[1].d) == (None, None)


def test_recommended_weights(spark):
    def weights(*rows):
        return {r.source: r.weight for r in fusion.recommended_weights(spark.createDataFrame(rows, "source string, coverage double, consensus double, stability double")).collect()}

    assert weights(("a", 1.0, 0.5, 1.0), ("b", 0.5, 0.5, 1.0)) == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    assert weights(("a", 1.0, 0.0, 1.0), ("b", 0.5, 0.0, 0.5)) == {"a": pytest.approx(0.8), "b": pytest.approx(0.2)}
    assert weights(("a", 0.4, 0.0, 1.0)) == {"a": 1.0} and weights(("a", 0.0, 0.0, 1.0)) == {"a": 0.0}
