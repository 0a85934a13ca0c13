"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, takes styled letters (bold, circled, full-width, small capitals) and look-alike
letters of other scripts for Latin ones, drops accents and invisible characters, and reads digits and
signs inside words as the letters they stand for.
Entries are word beginnings with a weight (their log odds among labelled documents); an entry counts
where it starts a word. Exception phrases, an entry with the word before or after it that is found in
clean documents only, cancel the matches they cover. A document's score is logistic in its weighted
matches and in their rate per word.

Lexicon, exceptions and the two coefficients are learned from at most ``MAX_LABELLED`` labelled
documents and ``MAX_LABELLED_BYTES`` of text in hash order (the only bounded part), without those that
are held out, in one task. Scoring covers whole texts of all documents.

Defined results: null and empty texts have no match and get the score of a clean text; without
labels, or with one class only, the lexicon is empty and every score is the smoothed share of toxic
labels; repeated rows get equal scores; texts and gaps between words of any length are read whole; an empty
table gives an empty result; extra columns are kept, and the score comes last (with underscores at its
name's end where that is taken).
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandex.runtime import fresh, stage

MAX_LABELLED, MAX_LABELLED_BYTES = 8_000, 64 << 20
MIN_DOCS = 4
MIN_LOG_ODDS = 2.0
PREFIX = (4, 10)
EXCEPTION_DOCS = 3
CUT = 0.7

# fixed values: letters of other scripts that look like Latin ones, and the Latin letters
LOOKALIKES = "абвгекмнорстухіјѕԁԛԝһӏαβεικνορτυχγοօոսցıɑɡɩʟɴʀʏᴀʙᴄᴅᴇꜰɢʜɪᴊᴋᴍᴏᴘꜱᴛᴜᴠᴡᴢłøđ"
LATIN_FOR = "a6brekmhopctyxijsdqwhlabeiknoptuxyoonugiagilnryabcdefghijkmopstuvwzlod"
# fixed values: digits and signs used for letters inside words
SIGNS = "0134578@$!"
LETTER_FOR = "oieastbasi"

_FOLD = {ord(a): b for a, b in zip(LOOKALIKES, LATIN_FOR, strict=True)}
_FOLD |= dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_MARKS = re.compile("[\u0300-\u036f\u20d0-\u20f0]+")
_SIGN = str.maketrans(SIGNS, LETTER_FOR)
_WITH_SIGN = re.compile(r"[0134578@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![\w.@])|(?<=[^\W\d_])!(?=[^\W\d_])")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """The text as the lexicon sees it."""
    low = (text or "").lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low)).lower().translate(_FOLD)
    return _WITH_SIGN.sub(lambda m: m.group().translate(_SIGN), low) if _WITH_SIGN.search(low) else low


@dataclass
class Lexicon:
    """Word beginnings with weights, exception phrases, and the logistic coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[tuple[str, str], ...] = ()
    coefficients: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def matcher(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        if self.weights:
            machine.make_automaton()
        return machine


def matches(folded: str, machine, exceptions: frozenset) -> list[tuple[int, float]]:
    """(start, weight) of the entries that start a word and that no exception phrase covers."""
    found: dict[int, tuple[int, float]] = {}
    for end, (length, weight) in machine.iter(folded) if len(machine) else ():
        start = end - length + 1
        if (not start or not folded[start - 1].isalpha()) and length > found.get(start, (0, 0.0))[0]:
            found[start] = (length, weight)
    if not exceptions:
        return [(s, w) for s, (_, w) in found.items()]
    kept = []
    for start, (_, weight) in found.items():
        before, own, after = neighbours(folded, start)
        if (before, own) not in exceptions and (own, after) not in exceptions:
            kept.append((start, weight))
    return kept


def neighbours(folded: str, start: int) -> tuple[str, str, str]:
    """The word before, the word at and the word after a place; empty where there is none."""
    own = _WORD.match(folded, start)
    if own is None:
        return "", "", ""
    after = _WORD.search(folded, own.end())
    end = start
    while end and not _LETTER.match(folded, end - 1):
        end -= 1
    first = end
    while first and _LETTER.match(folded, first - 1):
        first -= 1
    return folded[first:end], own.group(), after.group() if after else ""


def measures(found: list[tuple[int, float]], n_words: int) -> tuple[float, float]:
    """Weighted matches, and their rate per hundred words (of twenty at least), both damped."""
    total = sum(w for _, w in found)
    return math.log1p(total), math.log1p(100 * total / max(n_words, 20))


def _prefixes(words: set[str]) -> set[str]:
    low, high = PREFIX
    return {w[:n] for w in words for n in range(low, min(high, len(w)) + 1)}


def learn(rows: list[tuple[str | None, int]]) -> Lexicon:
    """A lexicon from (text, toxic 0 or 1)."""
    folded = [fold(t) for t, _ in rows]
    toxic = np.array([y for _, y in rows], float)
    n_toxic, n_clean = toxic.sum(), (1 - toxic).sum()
    share = (n_toxic + 1) / (n_toxic + n_clean + 10)
    plain = Lexicon(coefficients=(math.log(share / (1 - share)), 0.0, 0.0))
    if not n_toxic or not n_clean:
        return plain
    bags = [set(_WORD.findall(f)) for f in folded]
    seen = Counter()
    for bag, y in zip(bags, toxic, strict=True):
        if y:
            seen.update(_prefixes(bag))
    able = {p for p, n in seen.items() if n >= MIN_DOCS}
    clean = Counter()
    for bag, y in zip(bags, toxic, strict=True):
        if not y:
            clean.update(_prefixes(bag) & able)
    odds = {p: math.log((seen[p] + 0.5) / (n_toxic - seen[p] + 0.5)) - math.log((clean[p] + 0.5) / (n_clean - clean[p] + 0.5)) for p in able}
    # evidence, not odds alone: a G-test keeps chance findings among very many prefixes out
    def evidence(p: str) -> float:
        a, b, expected = seen[p], clean[p], (seen[p] + clean[p]) * n_toxic / (n_toxic + n_clean)
        return 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0)) if a > expected else 0.0

    ranked = sorted((p for p in able if odds[p] >= MIN_LOG_ODDS and evidence(p) >= 20.0), key=lambda p: (-round(evidence(p), 6), -len(p), p))
    weights: dict[str, float] = {}
    for p in ranked:
        if not any(p.startswith(q) or q.startswith(p) for q in weights):
            weights[p] = round(odds[p], 6)
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(folded, toxic, lexicon)
    machine, out = lexicon.matcher(), frozenset(lexicon.exceptions)
    x = np.array([(1.0, *measures(matches(f, machine, out), len(f.split()))) for f in folded])
    lexicon.coefficients = _logistic(x, toxic)
    return lexicon


def _exceptions(folded: list[str], toxic: np.ndarray, lexicon: Lexicon) -> tuple[tuple[str, str], ...]:
    """Word pairs with a lexicon word that several clean documents have and no toxic one."""
    machine, none = lexicon.matcher(), frozenset()
    pairs = {0: Counter(), 1: Counter()}
    for text, y in zip(folded, toxic, strict=True):
        own = set()
        for start, _ in matches(text, machine, none):
            before, word, after = neighbours(text, start)
            own |= {(before, word)} if before else set()
            own |= {(word, after)} if after else set()
        pairs[int(y)].update(own)
    return tuple(sorted(p for p, n in pairs[0].items() if n >= EXCEPTION_DOCS and p not in pairs[1]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Coefficients by Newton steps with a small ridge; negative slopes are set to zero."""
    active = np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        beta = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x[:, active].T @ (y - p) - ridge * beta[active]
            hess = (x[:, active] * (p * (1 - p))[:, None]).T @ x[:, active] + ridge * np.eye(active.sum())
            step = np.linalg.solve(hess, grad)
            beta[active] += step
            if np.abs(step).max() < 1e-9:
                break
        bad = (beta < 0) & (np.arange(len(beta)) > 0)
        if not bad.any():
            break
        active &= ~bad
    return tuple(round(float(b), 9) for b in np.where(active, beta, 0.0))


def score_texts(texts: list, lexicon: Lexicon, machine=None) -> np.ndarray:
    machine = lexicon.matcher() if machine is None else machine
    out, exceptions, beta = np.empty(len(texts)), frozenset(lexicon.exceptions), lexicon.coefficients
    for i, text in enumerate(texts):
        folded = fold(text if isinstance(text, str) else None)
        a, b = measures(matches(folded, machine, exceptions), len(folded.split()))
        out[i] = 1 / (1 + math.exp(-min(30.0, max(-30.0, beta[0] + beta[1] * a + beta[2] * b))))
    return np.round(out, 9)


def with_scores(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), lexicon))

    return docs.withColumn(fresh(docs, into), score(F.col(text)))


def fold_of(doc_id, parts: int = 3):
    """crc32 of the id as text, modulo ``parts``; a missing id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_LABELLED_BYTES) -> DataFrame:
    """(doc_id, text, toxic) to learn from, one row an id: in hash order, ``max_labelled`` ids and ``max_bytes`` at most."""
    able = labels.where("doc_id is not null and toxic in (0, 1)").where(fold_of(F.col("doc_id")) != 1)
    able = able.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(able), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = stage(rows, "toxlabelled")
    # a few thousand rows by their bound, so one task may add up their sizes
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("upto", upto).where(F.col("upto") <= max_bytes).drop("upto")


def learn_on(docs: DataFrame, labels: DataFrame, **bounds) -> Lexicon:
    """The lexicon of the labelled sample, learned in one task; the driver receives the lexicon alone."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(i), t, int(y)) for batch in batches for i, t, y in zip(batch["doc_id"], batch["text"].where(batch["text"].notna(), ""), batch["toxic"], strict=True))
        yield pd.DataFrame({"lexicon": [pickle.dumps(learn([(t, y) for _, t, y in rows]))]})

    got = labelled_sample(docs, labels, **bounds).coalesce(1).mapInPandas(fit, "lexicon binary").collect()
    return pickle.loads(got[0].lexicon) if got else learn([])


def op7_toxic_lexicon(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = with_scores(docs, learn_on(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
