"""Tempo evidence, key resolution and the risk of transitions between neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandex.functions import expr as X
from strandex.operators import tempo, transition
from strandex.plans.base import registrar
from strandex.plans.views import FEATURES, features, r6

QUERIES, ORACLES, query = registrar()


def items(spark, sf):
    """Features with what tempo, key and transition rules read; much is missing by rule."""
    k = F.col("track_id")
    f = features(spark, sf).withColumn("size", (k * 7) % 50)
    unless = lambda n, c: F.when(k % n != 0, c)
    return f.select(
        "track_id", "bpm", "bpm_confidence", "energy", "dance", "valence", "key_confidence",
        unless(10, F.col("energy")).alias("grid"),
        unless(4, F.concat(F.lit("[["), (60 + F.col("size")).cast("string"), F.lit(", 0.9], "), (90 + F.col("size")).cast("string"), F.lit("]"))).alias("candidates"),
        unless(3, 62.0 + F.col("size")).alias("tag_bpm"),
        F.when(k % 13 == 0, "Am").when(k % 17 == 0, "3b").alias("tag_key"),
        F.col("key").alias("analysed_key"),
        F.when(k % 4 == 0, "C").alias("analysed_name"),
        F.col("density").alias("onset_density"),
        (F.col("energy") / 10).alias("rms_mean"),
        (F.col("loudness") % 30 - 30).alias("loudness"),
        F.array(F.col("energy") * 10, F.col("valence") * 5, unless(2, F.col("dance"))).alias("mfcc_mean"),
        F.col("loudness").alias("spectral_centroid"),
        F.col("dance").alias("spectral_flatness"),
        F.col("dance").alias("acousticness"),
        (F.col("energy") * 10).alias("energy_level"),
        F.col("energy").alias("energy_curve_mean"),
        F.lit(0.0).alias("energy_curve_stddev"),
        unless(5, F.col("valence")).alias("energy_curve_min"),
        (200.0 + k % 40).alias("duration"),
        unless(8, F.lit(195.0)).alias("outro_start"),
        (k % 25).cast("double").alias("intro_end"),
        F.when(k % 3 != 0, F.create_map(F.lit("lead_voice"), (k % 101) / 100, F.lit("groove"), F.lit(0.9), F.lit("Vocal"), F.col("energy"))).otherwise(F.create_map(F.lit("Vocal"), F.col("energy"))).alias("classifiers"),
        (1 + k % 3).alias("n_sources"),
    )


ITEMS = f"""{FEATURES}, it AS (SELECT *, track_id * 7 % 50 AS size FROM feat),
item AS (SELECT track_id, bpm, bpm_confidence, energy, dance, valence, key_confidence, CASE WHEN track_id % 10 <> 0 THEN energy END AS grid,
 CASE WHEN track_id % 4 <> 0 THEN [60.0::DOUBLE + size, 90.0::DOUBLE + size] ELSE []::DOUBLE[] END AS cands, CASE WHEN track_id % 3 <> 0 THEN 62.0::DOUBLE + size END AS tag_bpm,
 CASE WHEN track_id % 13 = 0 THEN 'Am' WHEN track_id % 17 = 0 THEN '3b' END AS tag_key, key AS analysed_key, CASE WHEN track_id % 4 = 0 THEN 'C' END AS analysed_name,
 density AS onset_density, energy / 10 AS rms_mean, loudness % 30 - 30 AS loudness, [energy * 10, valence * 5, CASE WHEN track_id % 2 <> 0 THEN dance END] AS mfcc_mean,
 loudness AS spectral_centroid, dance AS spectral_flatness, dance AS acousticness, energy * 10 AS energy_level, [energy, CASE WHEN track_id % 5 <> 0 THEN valence END] AS curve,
 200.0::DOUBLE + track_id % 40 AS duration, CASE WHEN track_id % 8 <> 0 THEN 195.0::DOUBLE END AS outro_start, (track_id % 25)::DOUBLE AS intro_end,
 CASE WHEN track_id % 3 <> 0 THEN (track_id % 101) / 100 END AS lead, energy AS vocal, 1 + track_id % 3 AS n_sources FROM it),
c AS (SELECT *, CASE WHEN bpm_confidence IS NOT NULL THEN least(1, greatest(0, bpm_confidence)) END AS conf, list_distinct(list_filter([bpm] || cands, lambda x: x BETWEEN 20 AND 300)) AS opts FROM item),
cf AS (SELECT *, bpm IS NOT NULL AND conf < 0.45 AND tag_bpm IS NOT NULL AND len(list_filter(opts, lambda x: least(abs(tag_bpm - x), abs(tag_bpm / 2 - x), abs(tag_bpm * 2 - x), abs(tag_bpm - x / 2), abs(tag_bpm - x * 2)) <= 4)) > 0 AS confirmed FROM c),
ev AS (SELECT *, CASE WHEN bpm IS NULL OR confirmed THEN tag_bpm ELSE bpm END AS tempo,
 CASE WHEN bpm IS NULL THEN CASE WHEN tag_bpm IS NULL THEN []::DOUBLE[] ELSE [tag_bpm] END WHEN conf >= 0.45 THEN [bpm] WHEN confirmed THEN list_distinct(opts || [tag_bpm]) ELSE opts END AS alts,
 CASE WHEN bpm IS NULL THEN CASE WHEN tag_bpm IS NULL THEN 0 ELSE 1 END WHEN grid IS NULL THEN coalesce(conf, 0) ELSE sqrt(coalesce(conf, 0) * least(1, greatest(0, grid))) END::DOUBLE AS rel,
 CASE WHEN bpm IS NULL THEN CASE WHEN tag_bpm IS NOT NULL THEN 'tag' END WHEN conf >= 0.45 THEN 'measured' WHEN confirmed THEN 'tag_confirmed' ELSE 'measured_low' END AS origin,
 CASE WHEN tag_key = '3b' THEN '3B' WHEN analysed_key IS NOT NULL THEN analysed_key WHEN tag_key = 'Am' THEN '8A' WHEN analysed_name = 'C' THEN '8B' END AS wheel,
 CASE WHEN tag_key = '3b' THEN 'tag' WHEN analysed_key IS NOT NULL THEN 'analysed' WHEN tag_key = 'Am' THEN 'tag_name' WHEN analysed_name = 'C' THEN 'analysed_name' END AS wheel_source,
 CASE WHEN tag_key IS DISTINCT FROM '3b' AND (analysed_key IS NOT NULL OR analysed_name = 'C') AND key_confidence IS NOT NULL THEN least(1, greatest(0, key_confidence)) END AS wheel_conf FROM cf),
pr AS (SELECT a, b FROM ev a JOIN ev b ON b.track_id = a.track_id + 1)"""


def evidence_of(f):
    """``items`` with tempo evidence and resolved keys."""
    e = tempo.evidence(F.col("bpm"), F.col("bpm_confidence"), F.col("grid"), tempo.candidate_tempi(F.col("candidates")), F.col("tag_bpm"))
    key = (F.col("tag_key"), F.col("analysed_key"), F.col("analysed_name"))
    return f.select(
        "*", e.alias("tempo"), X.resolved_camelot(*key).alias("wheel"), X.resolved_key_source(*key).alias("wheel_source"),
        X.resolved_key_confidence(*key, F.col("key_confidence")).alias("wheel_confidence"),
    )


def _pairs(spark, sf):
    """Each item with the next one: the seed's columns begin with a_, the candidate's with b_."""
    f = evidence_of(items(spark, sf))
    a, b = (f.select(*[F.col(c).alias(f"{side}_{c}") for c in f.columns]) for side in "ab")
    return a.join(b, F.col("b_track_id") == F.col("a_track_id") + 1)


def _sides(pairs, key: str, confidence: str):
    out = []
    for prefix in ("a_", "b_"):
        side = transition.side_of(pairs.columns, prefix)
        out.append(side | {"key": side[key], "key_confidence": side[confidence]})
    return out



def _ids():
    return [F.col("a_track_id").alias("a_id"), F.col("b_track_id").alias("b_id")]


NEAR = "least(abs(x - y), abs(x / 2 - y), abs(x * 2 - y), abs(x - y / 2), abs(x - y * 2))"
CHANGE = "least(abs(x - y) / y, abs(x / 2 - y) / y, abs(x * 2 - y) / y, abs(x - y / 2) / (y / 2), abs(x - y * 2) / (y * 2))"


@query("x6_x8_tempo", f"WITH {FEATURES}, p AS (SELECT track_id, bpm AS x, 128.0::DOUBLE AS y FROM feat) SELECT track_id, round({NEAR}, 6) AS distance, round({CHANGE}, 6) AS relative, round(CASE WHEN x IS NOT NULL THEN least(1, greatest(0, 1 - {NEAR} / 16)) END, 6) AS score FROM p")
def tempo_rules(spark, sf):
    a, b = F.col("bpm"), F.lit(128.0)
    return features(spark, sf).select("track_id", r6(X.tempo_distance(a, b)).alias("distance"), r6(X.relative_tempo_delta(a, b)).alias("relative"), r6(X.tempo_score(a, b)).alias("score"))


@query("x9_x11_tempo_evidence", f"WITH {ITEMS} SELECT track_id, tempo AS bpm, len(alts) AS n_alternatives, list_sum(alts) AS total, round(rel, 6) AS reliability, origin FROM ev")
def tempo_evidence(spark, sf):
    t = F.col("tempo")
    total = F.when(F.size(t["alternatives"]) > 0, F.aggregate(t["alternatives"], F.lit(0.0), lambda s, x: s + x))
    return evidence_of(items(spark, sf)).select("track_id", t["bpm"].alias("bpm"), F.size(t["alternatives"]).alias("n_alternatives"), total.alias("total"), r6(t["reliability"]).alias("reliability"), t["source"].alias("origin"))


def _over(inner: str, best: str) -> str:
    return f"list_{best}(list_transform(b.alts, lambda x: list_{best}(list_transform(a.alts, lambda y: {inner}))))"


PAIR = "sqrt(least(1, greatest(0, a.rel)) * least(1, greatest(0, b.rel)))"
BPM2 = f"CASE WHEN a.tempo IS NOT NULL AND b.tempo IS NOT NULL THEN least(1, greatest(0, {PAIR} * least(1, greatest(0, {_over(CHANGE, 'min')} / 0.12)) + (1 - {PAIR}) * 0.5)) END"


@query("x10_confident_tempo", f"WITH {ITEMS} SELECT a.track_id AS a_id, b.track_id AS b_id, round(CASE WHEN a.tempo IS NOT NULL AND b.tempo IS NOT NULL THEN {PAIR} * least(1, greatest(0, 1 - {_over(NEAR, 'min')} / 16)) + (1 - {PAIR}) * 0.5 END, 6) AS score, round({BPM2}, 6) AS risk, round(CASE WHEN a.tempo IS NOT NULL THEN a.rel * greatest(0, 1 - list_min(list_transform(a.alts, lambda x: abs(x - 128))) / 8) + (1 - a.rel) * 0.5 END, 6) AS target FROM pr")
def confident_tempo(spark, sf):
    a, b = F.col("a_tempo"), F.col("b_tempo")
    return _pairs(spark, sf).select(*_ids(), r6(tempo.score(b, a)).alias("score"), r6(tempo.risk(b, a)).alias("risk"), r6(tempo.target_score(a, F.lit(128.0), 8.0)).alias("target"))


@query("x16_key_resolution", f"WITH {ITEMS} SELECT track_id, wheel, wheel_source, round(wheel_conf, 6) AS confidence FROM ev")
def key_resolution(spark, sf):
    return evidence_of(items(spark, sf)).select("track_id", "wheel", "wheel_source", r6(F.col("wheel_confidence")).alias("confidence"))


def _wheel(a: str, b: str) -> str:
    number = lambda k: f"CAST(regexp_extract({k}, '^\\d+') AS INTEGER)"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN right({a}, 1) = right({b}, 1) AND ({number(a)} - {number(b)} + 24) % 12 IN (1, 11) THEN 0.95 WHEN {number(a)} = {number(b)} THEN 0.9 WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 0.2 END"


def _alike(x: str, y: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN greatest(0, 1 - abs({x} - {y}) / greatest(abs({x}), abs({y}), 1)) END"


def _alike_list(x: str, y: str) -> str:
    own = f"list_filter({x}, lambda v: v IS NOT NULL AND v <> 0)" if "curve" in x else f"list_filter({x}, lambda v: v IS NOT NULL)"
    other = own.replace(x, y)
    n = f"least(len({own}), len({other}))"
    each = f"list_transform(range(1, {n} + 1), lambda i: {_alike(f'({own})[i]', f'({other})[i]')})"
    return f"CASE WHEN {n} > 0 THEN list_sum({each}) / {n} END"


def _mean(parts: list[str], weights: list[float] | None = None) -> str:
    weights = weights or [1.0] * len(parts)
    top = " + ".join(f"coalesce(({p}) * {w}, 0)" for p, w in zip(parts, weights, strict=True))
    return f"({top}) / nullif({' + '.join(f'CASE WHEN ({p}) IS NOT NULL THEN {w} ELSE 0 END' for p, w in zip(parts, weights, strict=True))}, 0)"


DENSITY = _mean([_alike("a.onset_density", "b.onset_density")] * 2 + [_alike(f"a.{c}", f"b.{c}") for c in ("rms_mean", "loudness")])
TEXTURE = _mean([_alike_list("a.mfcc_mean", "b.mfcc_mean"), _alike("a.spectral_centroid", "b.spectral_centroid"), _alike("a.spectral_flatness", "b.spectral_flatness")])
MOOD = _mean([_alike(f"a.{c}", f"b.{c}") for c in ("valence", "acousticness", "energy", "spectral_centroid")])
VOCAL = _mean(["abs(b.lead - a.lead)", "least(1, abs(b.vocal - a.vocal))"])
FIT = _mean(["CASE WHEN a.outro_start IS NOT NULL THEN least(1, least(a.duration - a.outro_start, b.intro_end) / 16) END", "greatest(0, 1 - abs(b.energy_level - a.energy_level) / 10)", _alike_list("a.curve", "b.curve")])
STRENGTH = "exp(coalesce((coalesce(ln(greatest(least(1, a.wheel_conf / 0.45), 1e-12)), 0) + coalesce(ln(greatest(least(1, b.wheel_conf / 0.45), 1e-12)), 0)) / nullif(CAST(a.wheel_conf IS NOT NULL AS INTEGER) + CAST(b.wheel_conf IS NOT NULL AS INTEGER), 0), 0))"
NAMES = list(transition.RISK_WEIGHTS)
PARTS = f"""{ITEMS}, p1 AS (SELECT a.track_id AS a_id, b.track_id AS b_id, {BPM2} AS bpm, 1 - (0.55 + (({_wheel('b.wheel', 'a.wheel')}) - 0.55) * {STRENGTH}) AS key, least(1, abs(b.energy - a.energy)) AS energy, 1 - b.n_sources / 3 AS sources,
 1 - {DENSITY} AS density, 1 - {TEXTURE} AS texture, 1 - {MOOD} AS mood, {VOCAL} AS vocal, 1 - sqrt(a.grid * b.grid) AS grid, 1 - {FIT} AS structure FROM pr),
parts AS (SELECT *, CASE (density IS NULL)::INT + (texture IS NULL)::INT + (mood IS NULL)::INT WHEN 0 THEN 0 WHEN 1 THEN 0.35 / 3 WHEN 2 THEN 0.7 / 3 END::DOUBLE AS missing FROM p1)"""


@query("d9_d29_structure_fit", f"WITH {ITEMS} SELECT a.track_id AS a_id, b.track_id AS b_id, round({FIT}, 6) AS fit FROM pr")
def structure(spark, sf):
    p = _pairs(spark, sf)
    return p.select(*_ids(), r6(transition.structure_score(*_sides(p, "wheel", "wheel_confidence"))).alias("fit"))


V1 = f"""{ITEMS}, q AS (SELECT a.track_id AS a_id, b.track_id AS b_id, coalesce(a.bpm, a.tag_bpm) AS x, coalesce(b.bpm, b.tag_bpm) AS y, coalesce(a.tag_key, a.analysed_name) AS ka, coalesce(b.tag_key, b.analysed_name) AS kb, abs(b.energy - a.energy) AS energy, 1 - b.n_sources / 3 AS sources FROM pr),
n AS (SELECT *, CASE ka WHEN 'Am' THEN '8A' WHEN 'C' THEN '8B' WHEN '3b' THEN '3B' END AS wa, CASE kb WHEN 'Am' THEN '8A' WHEN 'C' THEN '8B' WHEN '3b' THEN '3B' END AS wb FROM q),
v AS (SELECT a_id, b_id, least(1, least(abs(y - x / 2) / (x / 2), abs(y - x) / x, abs(y - x * 2) / (x * 2)) / 0.12) AS bpm, 1 - ({_wheel('wb', 'wa')}) AS key, energy, sources FROM n),
w AS (SELECT a_id, b_id, CASE WHEN bpm IS NOT NULL THEN bpm END AS bpm, key, energy, sources FROM v)"""


@query("d10_transition_risk_v1", f"WITH {V1} SELECT a_id, b_id, round(bpm, 6) AS bpm, round(key, 6) AS key, round(energy, 6) AS energy, round(sources, 6) AS sources, round({_mean(['bpm', 'key', 'energy', 'sources'])}, 6) AS risk FROM (SELECT n.a_id, n.b_id, CASE WHEN n.x IS NOT NULL AND n.y IS NOT NULL THEN w.bpm END AS bpm, w.key, w.energy, w.sources FROM n JOIN w USING (a_id, b_id))")
def first_version(spark, sf):
    p = _pairs(spark, sf)
    a, b = (s | {"key": F.coalesce(s["tag_key"], s["analysed_name"])} for s in _sides(p, "wheel", "wheel_confidence"))
    made = transition.with_parts(p, transition.first_version(a, b, F.col("b_n_sources"), F.lit(3)))
    parts = {n: F.col(n) for n in transition.FIRST_VERSION}
    return made.select(*_ids(), *[r6(c).alias(n) for n, c in parts.items()], r6(transition.total(parts)).alias("risk"))


def _second(spark, sf):
    p = _pairs(spark, sf)
    parts = transition.second_version(*_sides(p, "wheel", "wheel_confidence"), F.col("b_n_sources"), F.lit(3))
    return transition.with_missing(transition.with_parts(p, parts)), {n: F.col(n) for n in NAMES}


@query("d12_d13_transition_components", f"WITH {PARTS} SELECT a_id, b_id, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM parts")
def components(spark, sf):
    p, parts = _second(spark, sf)
    return p.select(*_ids(), *[r6(c).alias(n) for n, c in parts.items()])


@query("d11_transition_risk", f"WITH {PARTS} SELECT a_id, b_id, round({_mean(NAMES, list(transition.RISK_WEIGHTS.values()))}, 6) AS risk FROM parts")
def second_version(spark, sf):
    p, parts = _second(spark, sf)
    return p.select(*_ids(), r6(transition.total(parts, transition.RISK_WEIGHTS)).alias("risk"))


@query("d14_warnings", f"WITH {PARTS} SELECT a_id, b_id, coalesce(concat_ws(',', {', '.join(f'''CASE WHEN {n} IS NULL THEN 'missing_{n}' WHEN round({n}, 9) >= 0.6 THEN 'high_{n}' END''' for n in NAMES)}), '') AS codes FROM parts")
def warnings(spark, sf):
    p, parts = _second(spark, sf)
    return p.select(*_ids(), F.array_join(transition.warnings({n: F.round(c, 9) for n, c in parts.items()}), ",").alias("codes"))
