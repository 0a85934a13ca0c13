"""Tempo evidence: a measured tempo, its alternatives and how far to trust them, and scores that use it.

Evidence is a struct column (bpm, alternatives, confidence, grid, reliability, source). A measured
tempo of low confidence keeps its candidates as alternatives, and a tag that one of them confirms
takes its place. Without a measured tempo the tag stands, fully trusted; a measured tempo without a
confidence is not trusted at all, so that scores stay neutral.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandex.functions import expr as X

RISK_TOLERANCE = 0.12


def _none() -> Column:
    return F.lit(None).cast("double")


def unit_interval(x: Column) -> Column:
    """``x`` within [0, 1]; null where it is not a finite number."""
    return F.when(X.finite(x).isNotNull(), X.clamp01(x))


def distinct_tempi(values: Column) -> Column:
    """The valid tempi of an array in order, each once (two within a millionth are one)."""
    valid = F.filter(F.transform(values, X.valid_bpm), lambda x: x.isNotNull())
    return F.aggregate(valid, F.array().cast("array<double>"), lambda kept, x: F.when(F.exists(kept, lambda y: F.abs(y - x) < 1e-6), kept).otherwise(F.concat(kept, F.array(x))))


def candidate_tempi(text: Column) -> Column:
    """Tempi of a JSON array of numbers, or of arrays that begin with one; anything else gives none."""
    items = F.from_json(text, "array<string>")
    numbers = F.transform(items, lambda x: F.regexp_extract(x, r'^\s*\[?\s*"?([-+.eE0-9]+)', 1).try_cast("double"))
    return distinct_tempi(F.coalesce(numbers, F.array().cast("array<double>")))


def evidence(detected: Column, confidence: Column, grid: Column, candidates: Column, tag: Column) -> Column:
    """The evidence of one item; ``candidates`` is an array of tempi."""
    given = F.struct(X.valid_bpm(detected).alias("bpm"), X.valid_bpm(tag).alias("tag"), unit_interval(confidence).alias("confidence"), unit_interval(grid).alias("grid"), candidates.alias("candidates"))
    return X.once(given, lambda g: _resolve(g["bpm"], g["tag"], g["confidence"], g["grid"], g["candidates"]))


def _resolve(measured: Column, tag: Column, confidence: Column, grid: Column, candidates: Column) -> Column:
    every = distinct_tempi(F.concat(F.array(measured), F.coalesce(candidates, F.array().cast("array<double>"))))
    return X.once(every, lambda options: _choose(measured, tag, confidence, grid, options))


def _choose(measured: Column, tag: Column, confidence: Column, grid: Column, options: Column) -> Column:
    low = confidence.isNull() | (confidence < X.LOW_CONFIDENCE)
    confirmed = confidence.isNotNull() & low & F.exists(options, lambda x: X.tempo_distance(tag, x) <= X.TAG_TOLERANCE)
    only_tag = F.when(tag.isNotNull(), F.array(tag)).otherwise(F.array().cast("array<double>"))
    own = F.struct(
        F.when(confirmed, tag).otherwise(measured).alias("bpm"),
        F.when(~low, F.array(measured)).when(confirmed, distinct_tempi(F.concat(options, F.array(tag)))).otherwise(options).alias("alternatives"),
        confidence.alias("confidence"),
        grid.alias("grid"),
        X.tempo_reliability(confidence, grid).alias("reliability"),
        F.when(~low, "measured").when(confirmed, "tag_confirmed").otherwise("measured_low").alias("source"),
    )
    from_tag = F.struct(
        tag.alias("bpm"),
        only_tag.alias("alternatives"),
        _none().alias("confidence"),
        _none().alias("grid"),
        F.when(tag.isNotNull(), 1.0).otherwise(0.0).alias("reliability"),
        F.when(tag.isNotNull(), "tag").alias("source"),
    )
    return F.when(measured.isNotNull(), own).otherwise(from_tag)


def pair_reliability(a: Column, b: Column) -> Column:
    return F.sqrt(X.clamp01(a["reliability"]) * X.clamp01(b["reliability"]))


def _over_pairs(a: Column, b: Column, value) -> Column:
    return F.flatten(F.transform(a["alternatives"], lambda x: F.transform(b["alternatives"], lambda y: value(x, y))))


def _blend(trust: Column, value: Column, neutral: float) -> Column:
    return X.once(trust, lambda t: X.once(t * value + (1 - t) * neutral, X.clamp01))


def score(candidate: Column, reference: Column, neutral: float = X.TEMPO_NEUTRAL) -> Column:
    """Best match over both sides' alternatives, drawn to neutral as the pair is less reliable."""
    best = F.array_max(_over_pairs(candidate, reference, X.tempo_score))
    both = candidate["bpm"].isNotNull() & reference["bpm"].isNotNull()
    return F.when(both, _blend(pair_reliability(candidate, reference), best, neutral))


def risk(candidate: Column, reference: Column, neutral: float = X.TEMPO_NEUTRAL, tolerance: float = RISK_TOLERANCE) -> Column:
    """Least relative change over both sides' alternatives as a share of the tolerance, drawn to neutral."""
    least = F.array_min(_over_pairs(candidate, reference, X.relative_tempo_delta)) / tolerance
    both = candidate["bpm"].isNotNull() & reference["bpm"].isNotNull()
    return F.when(both, _blend(pair_reliability(candidate, reference), X.once(least, X.clamp01), neutral))


def target_score(e: Column, target: Column, tolerance: float, neutral: float = X.TEMPO_NEUTRAL) -> Column:
    """How near an item comes to a wanted tempo; halves and doubles do not count."""
    if tolerance <= 0:
        return _none()
    best = F.array_max(F.transform(e["alternatives"], lambda x: X.clamp01(1 - F.abs(x - target) / tolerance)))
    return F.when(e["bpm"].isNotNull(), _blend(e["reliability"], best, neutral))
