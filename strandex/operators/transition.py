"""Risk of going from one item (seed) to another (candidate), in parts, some of which may be missing.

A side is a mapping from field names to columns; fields that a table lacks are left out. The first
version is the plain mean of tempo, key, energy and sources; the second weighs eleven parts.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandex.functions import expr as X
from strandex.operators import tempo

Side = Mapping[str, Column]

# fixed values: weights of the parts in the second version, the fields of each group of features
RISK_WEIGHTS = {"bpm": 1.0, "key": 1.0, "energy": 1.0, "sources": 1.0, "density": 0.75, "texture": 0.75, "mood": 0.75, "vocal": 0.6, "grid": 0.6, "structure": 0.65, "missing": 0.4}
DENSITY_FIELDS = ("onset_density", "onset_density", "rms_mean", "loudness", "dynamic_range")
TEXTURE_FIELDS = ("mfcc_mean", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness", "spectral_contrast_mean")
MOOD_FIELDS = ("valence", "acousticness", "energy", "spectral_centroid")
ENERGY_CURVE = ("energy_curve_mean", "energy_curve_stddev", "energy_curve_min", "energy_curve_max")
VOCAL_WORDS = ("voice", "vocal")
MIX_SECONDS, LEVELS = 16.0, 10.0

FIRST_VERSION = ("bpm", "key", "energy", "sources")
MAY_BE_MISSING = ("density", "texture", "mood")
ARRAYS = ("mfcc_mean", "spectral_contrast_mean")


def of(side: Side, name: str) -> Column:
    return side[name] if name in side else F.lit(None).cast("array<double>" if name in ARRAYS else "double")


def side_of(columns: list[str], prefix: str) -> dict[str, Column]:
    """The fields of a pair table whose columns begin with ``prefix``."""
    return {c.removeprefix(prefix): F.col(c) for c in columns if c.startswith(prefix)}


def plain_bpm_risk(seed: Column, candidate: Column) -> Column:
    """Relative change from the seed's tempo as it is, halved or doubled, as a share of 12 %."""
    usable = (seed > 0) & (candidate > 0)
    change = F.least(*[F.abs(candidate - seed * f) / (seed * f) for f in (0.5, 1.0, 2.0)])
    return F.when(usable, X.clamp01(change / tempo.RISK_TOLERANCE))


def plain_key_risk(seed: Column, candidate: Column) -> Column:
    """By wheel position; keys that have none are the same or unknown."""
    a, b = (F.coalesce(X.camelot(k), X.key_to_camelot(k)) for k in (candidate, seed))
    raw = F.when(F.lower(F.trim(seed)) == F.lower(F.trim(candidate)), 1.0).otherwise(X.KEY_NEUTRAL)
    return F.when(seed.isNotNull() & candidate.isNotNull(), 1 - F.when(a.isNull() | b.isNull(), raw).otherwise(X.camelot_score(a, b)))


def key_risk(seed: Column, candidate: Column, seed_confidence: Column, candidate_confidence: Column) -> Column:
    """By wheel positions, drawn to neutral where the keys are not sure."""
    score = X.attenuate(X.camelot_score(candidate, seed), seed_confidence, candidate_confidence)
    return F.when(seed.isNotNull() & candidate.isNotNull(), X.once(1 - score, X.clamp01))


def energy_risk(seed: Column, candidate: Column) -> Column:
    return F.when(seed.isNotNull() & candidate.isNotNull(), X.clamp01(F.abs(candidate - seed)))


def source_risk(count: Column, most: Column) -> Column:
    """The share of sources that did not name the candidate; null where counts make no sense."""
    return F.when((most > 0) & (count >= 0), 1 - X.clamp01(count / most))


def feature_similarity(a: Column, b: Column, is_array: bool = False) -> Column:
    """Similarity of two numbers, or mean similarity of two arrays over the places both have."""
    if not is_array:
        return X.once(X.numeric_similarity(X.finite(a), X.finite(b)), X.clamp01)
    left, right = (F.filter(v, lambda x: X.finite(x).isNotNull()) for v in (a, b))
    # the longer one's surplus meets nothing and gives null
    each = F.zip_with(left, right, lambda x, y: X.clamp01(X.numeric_similarity(x, y)))
    return X.once(F.filter(each, lambda x: x.isNotNull()), lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)))


def group_risk(seed: Side, candidate: Side, fields: tuple[str, ...]) -> Column:
    """1 less the mean similarity over the fields that both sides have."""
    return X.once(1 - X.mean_of([feature_similarity(of(seed, f), of(candidate, f), f in ARRAYS) for f in fields]), X.clamp01)


def vocal_risk(seed: Column, candidate: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Mean over the vocal classifiers of ``candidate`` (maps from key to score): their change, or score by a given weight."""
    weights = weights or {}
    chosen = F.map_filter(candidate, lambda k, v: F.lower(k).rlike("|".join(VOCAL_WORDS)) & v.isNotNull())
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None

    def term(entry: Column) -> Column:
        change = X.clamp01(F.abs(entry["value"] - F.try_element_at(seed, entry["key"])))
        if given is None:
            return change
        weight = F.try_element_at(given, entry["key"])
        return F.when(weight > 0, X.clamp01(entry["value"] * weight)).otherwise(change)

    terms = F.filter(F.transform(F.map_entries(chosen), term), lambda x: x.isNotNull())
    return X.once(terms, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)))


def grid_risk(seed: Column, candidate: Column) -> Column:
    return F.when(seed.isNotNull() & candidate.isNotNull(), X.clamp01(1 - F.sqrt(X.clamp01(seed) * X.clamp01(candidate))))


def structure_fit(seed: Side, candidate: Side) -> Column:
    """Mean of what there is: the seed's outro against the candidate's intro over 16 s, energy levels, energy curves.

    Zeros in a curve's figures are left out before they are compared one by one.
    """
    outro = F.greatest(F.lit(0.0), of(seed, "duration") - of(seed, "outro_start"))
    intro = F.greatest(F.lit(0.0), of(candidate, "intro_end"))
    have = of(seed, "duration").isNotNull() & of(seed, "outro_start").isNotNull() & of(candidate, "intro_end").isNotNull()
    levels = X.clamp01(1 - F.abs(of(candidate, "energy_level") - of(seed, "energy_level")) / LEVELS)
    curve = lambda side: F.filter(F.array(*[of(side, c) for c in ENERGY_CURVE]), lambda x: x != 0)
    return X.mean_of([F.when(have, X.clamp01(F.least(outro, intro) / MIX_SECONDS)), levels, feature_similarity(curve(seed), curve(candidate), True)])


def structure_score(seed: Side, candidate: Side) -> Column:
    return structure_fit(seed, candidate)


def missing_risk(parts: list[Column]) -> Column:
    """0.35 times the share of the parts that could not be judged; null where none could."""
    gone = reduce(lambda a, b: a + b, [p.isNull().cast("double") for p in parts])
    return F.when(gone < len(parts), gone / len(parts) * 0.35)


def first_version(seed: Side, candidate: Side, count: Column, most: Column) -> dict[str, Column]:
    bpm = lambda side: F.coalesce(of(side, "bpm"), of(side, "tag_bpm"))
    return {
        "bpm": plain_bpm_risk(bpm(seed), bpm(candidate)),
        "key": plain_key_risk(seed["key"], candidate["key"]),
        "energy": energy_risk(of(seed, "energy"), of(candidate, "energy")),
        "sources": source_risk(count, most),
    }


def second_version(seed: Side, candidate: Side, count: Column, most: Column, classifier_weights: Mapping[str, float] | None = None) -> dict[str, Column]:
    """All eleven parts but ``missing``, which :func:`with_missing` adds once they are columns. ``key`` is a wheel position here; ``tempo`` is evidence; ``classifiers`` maps keys to scores."""
    return {
        "bpm": tempo.risk(candidate["tempo"], seed["tempo"]),
        "key": key_risk(seed["key"], candidate["key"], of(seed, "key_confidence"), of(candidate, "key_confidence")),
        "energy": energy_risk(of(seed, "energy"), of(candidate, "energy")),
        "sources": source_risk(count, most),
        "density": group_risk(seed, candidate, DENSITY_FIELDS),
        "texture": group_risk(seed, candidate, TEXTURE_FIELDS),
        "mood": group_risk(seed, candidate, MOOD_FIELDS),
        "vocal": vocal_risk(seed["classifiers"], candidate["classifiers"], classifier_weights),
        "grid": grid_risk(of(seed, "grid"), of(candidate, "grid")),
        "structure": X.once(1 - structure_fit(seed, candidate), X.clamp01),
    }


def with_parts(pairs: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """``pairs`` with each part as a column of its name, so that what follows reads it instead of computing it again."""
    return pairs.withColumns(dict(parts))


def with_missing(parts: DataFrame) -> DataFrame:
    return parts.withColumn("missing", missing_risk([F.col(n) for n in MAY_BE_MISSING]))


def total(parts: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of the parts there are; without weights the plain one."""
    return X.weighted_mean_available([(c, 1.0 if weights is None else weights[name]) for name, c in parts.items()])


def warnings(parts: Mapping[str, Column], high: float = 0.6) -> Column:
    """Names of parts that are missing or high, in order."""
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(f"missing_{n}")).when(c >= high, F.lit(f"high_{n}")) for n, c in parts.items()]))
