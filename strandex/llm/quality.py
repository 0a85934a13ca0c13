"""Quality rules: hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Two multinomials over hashed byte 4-grams are counted: one over all documents, one over a bounded
sample of trusted ones (``MAX_TRUSTED`` ids in hash order, the only bounded part). A document's score
is the mean log ratio of its n-grams. Every document is judged by the same fixed threshold, so the
verdict of a document depends on nothing but its text and the two tables.

Some rules come first and always reject: fewer than 20 words, or more than 30 % of the words inside
8-word windows that occur twice or more in the text.

Defined results: null and empty texts have no words, fail the base rules and are not kept; without
trusted documents every ratio is 0 and the base rules decide alone; repeated rows get equal verdicts;
texts of any length are read whole; an empty table gives an empty result; extra columns are kept as
they are, and the verdict comes last (with underscores at its name's end where that is taken).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.wordhash import Words, chunks, mix, words_of
from strandex.runtime import fresh

BITS = 16
GRAM = 4
MAX_TRUSTED = 20_000
SMOOTH = 1.0
THRESHOLD = -0.25
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_FIRST, _SECOND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def gram_buckets(raw: np.ndarray) -> np.ndarray:
    """Bucket of the 4-gram at each byte (the last three have none)."""
    wide = raw.astype(np.uint32)
    gram = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    gram ^= gram >> np.uint32(15)
    return (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _gram_ranges(text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's n-grams begin and end; the space before a text belongs to it."""
    begin = text_at[:-1] - 1
    return begin, np.maximum(begin, text_at[1:] - 1 - (GRAM - 1))


def count_grams(raws: list[bytes], into: np.ndarray, trusted: np.ndarray) -> None:
    """Add the n-gram counts of some texts to ``into[0]``, and of the trusted ones to ``into[1]``."""
    joined = np.frombuffer(b" " + b" ".join(raws) + b" " * GRAM, np.uint8)
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    text_at = np.concatenate([[1], 1 + np.cumsum(sizes + 1)])
    buckets = gram_buckets(joined)
    begin, end = _gram_ranges(text_at)
    change = np.zeros(len(buckets) + 1, np.int64)
    for row, some in ((0, np.ones(len(raws), bool)), (1, trusted)):
        change[:] = 0
        np.add.at(change, begin[some], 1)
        np.add.at(change, end[some], -1)
        inside = np.cumsum(change[:-1]) > 0
        into[row] += np.bincount(buckets[inside], minlength=1 << BITS)


def segment_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[end] - run[begin]


def repeated_words(words: Words) -> np.ndarray:
    """Per text, how many words lie in an 8-word window found twice or more in it."""
    n = len(words.hashes)
    texts = len(words.first) - 1
    if n < WINDOW:
        return np.zeros(texts, np.int64)
    rolled = words.hashes
    for reach in (1, 2, 4):
        rolled = mix(rolled[:-reach] * _FIRST + rolled[reach:] * _SECOND)
    owner = words.owner
    whole = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    key = rolled[at] + owner[at].astype(np.uint64) * _FIRST
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[repeated], 1)
    np.add.at(change, at[repeated] + WINDOW, -1)
    return segment_sums(np.cumsum(change[:-1]) > 0, words.first[:-1], words.first[1:])


def judge(texts: list, ratio: np.ndarray, threshold: float = THRESHOLD) -> pd.DataFrame:
    """All columns of the verdict for some texts."""
    parts = []
    for _, raws in chunks(texts):
        words = words_of(raws)
        n_words = np.diff(words.first)
        begin, end = words.text_at[:-1], words.text_at[1:] - 1
        lead = (words.raw & 0xC0) != 0x80
        inside = np.zeros(len(words.raw) + 1, np.int8)
        inside[words.starts] = 1
        inside[words.ends] -= 1
        word_chars = segment_sums(lead & (np.cumsum(inside[:-1]) > 0), begin, end)
        symbols = segment_sums(_SYMBOL[words.raw], begin, end)
        dup_lines = np.zeros(len(raws), np.int64)
        for i, raw in enumerate(raws):
            lines = [line for line in raw.split(b"\n") if line.strip()]
            dup_lines[i] = len(lines) - len(set(lines))
        repeats = repeated_words(words)
        grams = gram_buckets(np.concatenate([words.raw, np.full(GRAM, 32, np.uint8)]))
        g_begin, g_end = _gram_ranges(words.text_at)
        score = segment_sums(ratio[grams].astype(np.float64), g_begin, g_end) / np.maximum(g_end - g_begin, 1)
        failed = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
        parts.append(pd.DataFrame({"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats, "base_failed": failed, "kept": ~failed & (np.round(score, 9) >= threshold), "score": np.round(score, 9)}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=VERDICT_FIELDS)


VERDICT = "struct<n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double>"
VERDICT_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """Log ratio of each n-gram bucket: trusted share over raw share, both smoothed by ``SMOOTH``.

    Counts cover all documents; each task sends one row per bucket, so what is shuffled and what
    reaches the driver is bounded by the number of buckets.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("__id"), "__id").limit(max_trusted).withColumn("__trusted", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(trusted), F.col("id") == F.col("__id"), "left").select("text", F.coalesce("__trusted", F.lit(False)).alias("trusted"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            flags = batch["trusted"].to_numpy(bool)
            for start, raws in chunks(batch["text"].tolist()):
                count_grams(raws, total, flags[start : start + len(raws)])
        used = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": used.astype(np.int32), "raw": total[0][used], "trusted": total[1][used]})

    counts = rows.mapInPandas(count, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    got = counts.toPandas()
    raw, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[got["bucket"]], good[got["bucket"]] = got["raw"], got["trusted"]
    if not good.sum():
        return np.zeros(1 << BITS, np.float32)
    # smoothing follows the raw shares, so an n-gram not seen in the sample is judged by how much of it was due
    prior = (raw + SMOOTH) / (raw + SMOOTH).sum()
    weight = SMOOTH * (1 << BITS)
    return np.log((good + weight * prior) / (good.sum() + weight) / prior).astype(np.float32)


def annotate(docs: DataFrame, ratio: np.ndarray, text: str = "text", into: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct column of rule counts, score and verdict."""

    @F.pandas_udf(VERDICT)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return judge(texts.tolist(), ratio, threshold)

    return docs.withColumn(fresh(docs, into), verdict(F.col(text)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    into = fresh(docs, "__quality")
    return annotate(docs, fit(docs, labels), into=into).where(F.col(f"{into}.kept")).drop(into)


def op5_quality_llr(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return annotate(docs, fit(docs, labels)).select("doc_id", "quality.*")
