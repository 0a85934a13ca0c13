"""Personal data: fixed patterns, plus spans found by a character BiLSTM with CRF transitions.

The patterns give the base spans. The model, trained in numpy from labelled spans of a bounded sample
(``MAX_TRAIN_DOCS`` documents in hash order), reads overlapping windows of character classes, is
decoded by Viterbi, and its windows are reconciled per document: every character takes the tag of the
window in which it lies furthest from an edge.

It finds what the patterns miss. Its labelled spans are those of the sample's documents as they
stand, the same rewritten as people hide or mistype them (``rewritten``: bracketed at and dot, spaced
addresses, other separators in cards and phones), several in a row, which a greedy pattern swallows,
and secrets, a fifth kind: long keys of mixed letters and digits, labelled where a name such as
``token`` is assigned one, found wherever they stand. A decoded span is added if it is plausible
(:func:`plausible`: enough digits, Luhn, parts up to 255, a separator or sign in a phone) and
touches no base span and no earlier added one.

Every kind holds a digit, an ``@`` or a bracketed at, so windows are laid around these with
``MARGIN`` characters of context; the rest of a text cannot hold a span.

Defined results: null and empty texts have no spans; texts of any length are read whole; offsets are
code points, ends exclusive; repeated rows get equal results; without labelled spans in the sample
the model adds nothing; an empty table gives an empty result; extra columns are kept, and the new
one comes last (with underscores at its end where its name is taken).
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm.sample import hash_sample
from strandex.runtime import fresh

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
TAGS = 1 + 2 * len(KINDS)  # other, then begin and inside of each kind
WIDTH, STRIDE, MARGIN = 96, 64, 24
EMBED, HIDDEN = 10, 16
MAX_TRAIN_DOCS, STEPS, BATCH = 1_500, 400, 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_TRIGGER = re.compile(r"[0-9@]|[\[({] ?(?:at|AT|At) ?[\])}]")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api_?key|access_?key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/=_-]{24,})")
_NAMED = re.compile(r"(?i)\b(?:token|secret|password|passwd|api_?key|access_?key)\b[\"']?\s*[:=]\s*[\"']?$")
_EMAIL_FORM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def valid(kind: int, s: str) -> bool:
    """Whether a string has the form of a kind."""
    if kind == 0:
        return bool(_EMAIL_FORM.fullmatch(s))
    if kind == 1:
        return bool(_IP.fullmatch(s)) and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
    if kind == 2:
        return bool(_CARD.fullmatch(s)) and 12 <= len(d := _digits(s)) <= 19 and luhn(d)
    return bool(_PHONE.fullmatch(s)) and 9 <= len(_digits(s)) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, each found from its @ sign in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            out.append((start, domain.end()))
            done = domain.end()
        else:
            done = max(done, at + 1)  # no start before a failed @ can match later
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by start, then kind. Matches that fail a check are dropped."""
    if not _DIGIT.search(text):
        return []
    spans = [(s, 0, e) for s, e in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(spans)


_AT, _DOT = r"(?:@|[\[({] ?at ?[\])}])", r"(?:\.|[\[({] ?(?:dot|\.) ?[\])}])"
_LOOSE = (
    re.compile(rf"[A-Za-z0-9._%+-]+ ?{_AT} ?[A-Za-z0-9-]+(?: ?{_DOT} ?[A-Za-z0-9-]+)+", re.IGNORECASE),
    re.compile(rf"[0-9]{{1,3}}(?: ?{_DOT} ?[0-9]{{1,3}}){{3}}"),
    re.compile(r"[0-9](?:[ ._/-]{0,3}[0-9])+"),
    re.compile(r"[+(\[]{0,2} ?[0-9](?:[][ ().+/_-]{0,3}[0-9])+"),
    re.compile(r"[A-Za-z0-9+/=_-]{24,}"),
)


def plausible(kind: int, s: str) -> bool:
    """Whether a decoded string can be of a kind, however it is written."""
    if not _LOOSE[kind].fullmatch(s):
        return False
    digits = _digits(s)
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall(r"[0-9]+", s))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(digits) <= 15 and len(s) > len(digits)
    if kind == 4:
        return len(digits) >= 4 and sum(c.isalpha() for c in s) >= 4
    return True


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- the model -------------------------------------------------------------------------------------

_CLASSED = "@.-+() \n,:;%_\"='#$&*!|/"
CLASSES = 6 + len(_CLASSED)  # padding, digit, a-f, other ASCII letter, other letter, other, then those signs


def _class_table() -> np.ndarray:
    table = np.full(0x250, 5, np.int8)
    for code in range(0x250):
        c = chr(code)
        if c in _CLASSED:
            table[code] = 6 + _CLASSED.index(c)
        elif "0" <= c <= "9":
            table[code] = 1
        elif c in "abcdefABCDEF":
            table[code] = 2
        elif c.isascii() and c.isalpha():
            table[code] = 3
        elif c.isalpha():
            table[code] = 4
    return table


_TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], 4).astype(np.int8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def init_params(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
    p = {"embed": draw(CLASSES, EMBED), "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "begin": np.zeros(TAGS)}
    for way in "fb":
        p[f"x{way}"], p[f"h{way}"], p[f"b{way}"] = draw(EMBED, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN)
        p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1.0  # remember by default
    return p


def _barred() -> np.ndarray:
    """Transitions into the inside of a kind from anywhere but its own begin or inside."""
    bar = np.zeros((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        bar[:, 2 + 2 * k] = True
        bar[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    return bar


_BAR = np.where(_barred(), -1e4, 0.0)
_BAR_BEGIN = np.where(np.arange(TAGS) % 2 == 0, -1e4, 0.0) * (np.arange(TAGS) > 0)


def _lstm(x: np.ndarray, w_x: np.ndarray, w_h: np.ndarray, b: np.ndarray):
    """Hidden states of one direction, (time, batch, hidden), and what the gradient needs."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
    from_x, hs, saved = x @ w_x + b, np.empty((steps, batch, HIDDEN)), []
    for t in range(steps):
        z = from_x[t] + h @ w_h
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before_c, before_h = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        saved.append((i, f, o, g, tc, before_c, before_h))
    return hs, saved


def _lstm_back(dh: np.ndarray, x: np.ndarray, saved: list, w_x: np.ndarray, w_h: np.ndarray):
    steps, batch, _ = dh.shape
    dz_all = np.empty((steps, batch, 4 * HIDDEN))
    next_h, next_c, dw_h = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN)), np.zeros_like(w_h)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, tc, before_c, before_h = saved[t]
        d = dh[t] + next_h
        dc = d * o * (1 - tc * tc) + next_c
        dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        dw_h += before_h.T @ dz
        next_h, next_c = dz @ w_h.T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return dz_all @ w_x.T, x.reshape(-1, EMBED).T @ flat, dw_h, flat.sum(axis=0)


def emissions(p: dict, ids: np.ndarray):
    """(time, batch, tags) scores of class ids (batch, time), and what the gradient needs."""
    x = p["embed"][ids.T]
    ahead, saved_f = _lstm(x, p["xf"], p["hf"], p["bf"])
    behind, saved_b = _lstm(x[::-1], p["xb"], p["hb"], p["bb"])
    both = np.concatenate([ahead, behind[::-1]], axis=2)
    return both @ p["out"] + p["out_b"], (x, both, saved_f, saved_b)


def loss_and_gradient(p: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of the tag paths, and its gradient."""
    e, (x, both, saved_f, saved_b) = emissions(p, ids)
    steps, batch, _ = e.shape
    trans, begin, path = p["trans"] + _BAR, p["begin"] + _BAR_BEGIN, tags.T
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = begin + e[0]
    for t in range(1, steps):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _logsum(alpha[-1], 1)
    rows = np.arange(batch)
    right = begin[path[0]] + e[np.arange(steps)[:, None], rows, path].sum(axis=0) + trans[path[:-1], path[1:]].sum(axis=0)
    marginal = np.exp(alpha + beta - log_z[None, :, None])
    de = marginal.copy()
    de[np.arange(steps)[:, None], rows, path] -= 1
    d_trans = np.zeros_like(trans)
    for t in range(steps - 1):
        d_trans += np.exp(alpha[t][:, :, None] + trans + (e[t + 1] + beta[t + 1])[:, None, :] - log_z[:, None, None]).sum(axis=0)
    np.add.at(d_trans, (path[:-1].ravel(), path[1:].ravel()), -1)
    d_both = de @ p["out"].T
    dx_f, g_xf, g_hf, g_bf = _lstm_back(d_both[:, :, :HIDDEN], x, saved_f, p["xf"], p["hf"])
    dx_b, g_xb, g_hb, g_bb = _lstm_back(d_both[::-1, :, HIDDEN:], x[::-1], saved_b, p["xb"], p["hb"])
    d_embed = np.zeros_like(p["embed"])
    np.add.at(d_embed, ids.T.ravel(), (dx_f + dx_b[::-1]).reshape(-1, EMBED))
    grads = {"embed": d_embed, "out": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "out_b": de.sum(axis=(0, 1)), "trans": d_trans, "begin": de[0].sum(axis=0), "xf": g_xf, "hf": g_hf, "bf": g_bf, "xb": g_xb, "hb": g_hb, "bb": g_bb}
    return float((log_z - right).mean()), {k: g / batch for k, g in grads.items()}


def viterbi(p: dict, ids: np.ndarray) -> np.ndarray:
    """Best tag path of each window: (batch, time)."""
    e, _ = emissions(p, ids)
    trans = p["trans"] + _BAR
    best, back = p["begin"] + _BAR_BEGIN + e[0], np.empty(e.shape, np.int8)
    for t in range(1, len(e)):
        scores = best[:, :, None] + trans
        back[t] = scores.argmax(axis=1)
        best = scores.max(axis=1) + e[t]
    out = np.empty(e.shape[:2], np.int8)
    out[-1] = best.argmax(axis=1)
    rows = np.arange(e.shape[1])
    for t in range(len(e) - 1, 0, -1):
        out[t - 1] = back[t][rows, out[t]]
    return out.T


def window_starts(text: str) -> list[int]:
    """Starts of windows that cover every digit and @ with its margin."""
    out: list[int] = []
    covered = -1
    for m in _TRIGGER.finditer(text):
        at = m.start()
        if not out or at + MARGIN > covered:
            # a new run of windows, or the next window of a run that goes on
            start = max(0, at - MARGIN) if not out or at - MARGIN > out[-1] + STRIDE else out[-1] + STRIDE
            out.append(start)
            covered = start + WIDTH
    return out


def windows_of(text: str) -> tuple[list[int], np.ndarray]:
    starts = window_starts(text)
    ids = np.zeros((len(starts), WIDTH), np.int8)
    if starts:
        own = classes(text)
        for row, s in zip(ids, starts, strict=True):
            part = own[s : s + WIDTH]
            row[: len(part)] = part
    return starts, ids


def form_spans(text: str) -> list[Span]:
    """Spans for training: by form alone (a card need not pass Luhn), secrets, and none that overlaps another."""
    out: list[Span] = []
    secrets = [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text)]
    for s, k, e in sorted(secrets + [(s, 0, e) for s, e in _emails(text)] + [(m.start(), k, m.end()) for k, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)) for m in pattern.finditer(text)], key=lambda x: (x[0], -x[2])):
        n = len(_digits(text[s:e]))
        if (k == 2 and not 12 <= n <= 19) or (k == 3 and not 9 <= n <= 15) or (out and s < out[-1][2]):
            continue
        out.append((s, k, e))
    return out


def rewritten(kind: int, value: str, rng: np.random.Generator) -> str:
    """A span as people hide or mistype it; the patterns do not find these forms."""
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    if kind == 0:
        user, host = value.split("@", 1)
        at = pick("[at]", " [at] ", "(at)", " (at) ", " @ ", "{at}")
        dot = pick(".", " [dot] ", "[dot]", "(dot)", " . ")
        return f"{user}{at}{host.replace('.', dot)}"
    if kind == 1:
        return value.replace(".", pick(" . ", "[.]", "(.)", ". ", " [dot] "))
    digits = _digits(value)
    if kind == 2:
        return pick(".", "/", "  ", "_", " - ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        country, area, first, last = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
        if not country:
            return f"({area}) {first}-{last}"
        return pick(f"{country}-{area}-{first}-{last}", f"({area}) {first}-{last}", f"+{country}/{area}/{first}/{last}", f"+ {country} {area} {first} {last}", f"+{country} [{area}] {first}-{last}")
    return value


def training_set(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tag paths: spans in place, in place but rewritten, alone, and next to each other."""
    rng, windows, paths, pool = np.random.default_rng(seed), [], [], []

    def add(text: str, spans: list[Span]) -> None:
        tags = np.zeros(len(text) + WIDTH, np.int8)
        for s, k, e in spans:
            tags[s] = 1 + 2 * k
            tags[s + 1 : e] = 2 + 2 * k
        starts, ids = windows_of(text)
        windows.extend(ids)
        paths.extend(tags[s : s + WIDTH] for s in starts)

    for text in texts:
        spans = form_spans(text)
        pool += [(k, text[s:e], text[max(0, s - 30) : s], text[e : e + 30]) for s, k, e in spans]
        add(text, spans)
        if spans:  # the same text with its spans rewritten, and secrets without the name before them
            for _ in range(2):
                made, moved, at = "", [], 0
                for s, k, e in spans:
                    before = text[at:s]
                    if k == 4:
                        before = _NAMED.sub("", before)
                    value = rewritten(k, text[s:e], rng)
                    made += before
                    moved.append((len(made), k, len(made) + len(value)))
                    made, at = made + value, e
                add(made + text[at:], moved)
    if not pool:
        return np.empty((0, WIDTH), np.int8), np.empty((0, WIDTH), np.int8)
    # kinds in equal shares, so that rare ones are seen in every pairing
    by_kind = {k: [x for x in pool if x[0] == k] for k in range(len(KINDS))}
    able = [k for k in by_kind if by_kind[k]]
    for _ in range(max(400, len(windows) // 3)):
        parts = [by_kind[k][rng.integers(len(by_kind[k]))] for k in rng.choice(able, rng.integers(1, 4))]
        text, spans = parts[0][2], []
        for k, value, _, _ in parts:
            value = rewritten(k, value, rng) if rng.random() < 0.4 else value
            spans.append((len(text), k, len(text) + len(value)))
            text += value + " "
        add(text[:-1] + parts[-1][3], spans)
    return np.array(windows), np.array(paths)


@dataclass
class Model:
    params: dict | None

    def tags(self, ids: np.ndarray) -> np.ndarray:
        if self.params is None or not len(ids):
            return np.zeros(ids.shape, np.int8)
        return np.concatenate([viterbi(self.params, ids[i : i + 512]) for i in range(0, len(ids), 512)])


def train(texts: list[str], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam over random batches; a sample without spans gives a model that adds nothing."""
    windows, paths = training_set(texts)
    if not len(windows) or not paths.any():
        return Model(None)
    rng, p = np.random.default_rng(seed), init_params(seed)
    marked = np.flatnonzero(paths.any(axis=1))
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(marked, batch * 3 // 4), rng.integers(0, len(windows), batch // 4)])
        _, grads = loss_and_gradient(p, windows[pick], paths[pick])
        scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads.values()))))
        pace = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g * scale
            v[k] = 0.99 * v[k] + 0.01 * (g * scale) ** 2
            p[k] = p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(p)


def reconcile(n: int, starts: list[int], tags: np.ndarray) -> dict[int, int]:
    """Tag of each character in some window, from the window where it is furthest from an edge."""
    best: dict[int, tuple[int, int]] = {}
    depth = np.minimum(np.arange(WIDTH), WIDTH - 1 - np.arange(WIDTH)).tolist()
    for start, row in zip(starts, tags, strict=True):
        for j in np.flatnonzero(row).tolist():
            best[start + j] = max(best.get(start + j, (-1, 0)), (depth[j], int(row[j])))
        for j in np.flatnonzero(row == 0).tolist():
            if start + j in best and best[start + j][0] < depth[j]:
                best[start + j] = (depth[j], 0)
    return {at: tag for at, (_, tag) in best.items() if tag and at < n}


def added_spans(text: str, tags: dict[int, int], base: list[Span]) -> list[Span]:
    """Decoded spans with the form of their kind that keep clear of base spans and each other."""
    spans: list[list[int]] = []
    for at in sorted(tags):
        tag = tags[at]
        kind, inside = (tag - 1) // 2, tag % 2 == 0
        if inside and spans and spans[-1][2] == at and spans[-1][1] == kind:
            spans[-1][2] = at + 1
        else:
            spans.append([at, kind, at + 1])
    taken = [(s, e) for s, _, e in base]
    out: list[Span] = []
    for s, k, e in spans:
        if plausible(k, text[s:e]) and not any(s < b and a < e for a, b in taken):
            out.append((s, k, e))
            taken.append((s, e))
    return out


def find_spans(texts: list, model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    rows, batch, where = [], [], []
    for i, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        base = base_spans(text)
        rows.append((text, base))
        starts, ids = windows_of(text)
        if starts:
            where.append((i, starts))
            batch.append(ids)
    out: list[tuple[list[Span], list[Span]]] = [(base, []) for _, base in rows]
    if batch:
        tags, at = model.tags(np.concatenate(batch)), 0
        for i, starts in where:
            text, base = rows[i]
            own = tags[at : at + len(starts)]
            at += len(starts)
            if own.any():
                out[i] = (base, added_spans(text, reconcile(len(text), starts, own), base))
    return out


FOUND = "struct<n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, added_email long, added_ip long, added_card long, added_phone long, added_secret long, n_spans long>"


def with_spans(docs: DataFrame, model: Model, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds counts and digest of the base spans, all spans, and how many of each kind the model added."""

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        out = []
        values = texts.tolist()
        for i in range(0, len(values), 500):
            for base, added in find_spans(values[i : i + 500], model):
                counts = [sum(1 for _, k, _ in base if k == kind) for kind in range(len(BASE))]
                more = [sum(1 for _, k, _ in added if k == kind) for kind in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(sorted(base + added)), len(added), *more, len(base) + len(added)))
        return pd.DataFrame(out, columns=[f.split(" ")[0] for f in FOUND.removeprefix("struct<").removesuffix(">").split(", ")])

    return docs.withColumn(fresh(docs, into), found(F.col(text)))


def train_on(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """A model from a bounded sample, in hash order, of the documents with an @ or a long number.

    One task trains on the sample, so the driver only receives the few thousand parameters.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = sorted(t for batch in batches for t in batch["value"])
        yield pd.DataFrame({"params": [pickle.dumps(train(texts).params)]})

    able = docs.where(F.col(text).rlike(r"@|[0-9][ ().0-9-]{7}|[0-9a-f]{24}"))
    sample = hash_sample(able, F.xxhash64(text), F.col(text), max_docs)
    trained = sample.mapInPandas(fit, "params binary").collect()
    return Model(pickle.loads(trained[0].params) if trained else None)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
            at = e
    return "".join(out) + text[at:]


def op9_bilstm_crf_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(docs, train_on(docs)).select("doc_id", "pii.*")
