"""Words of many texts at once, as 64-bit hashes, in numpy.

Words are the runs of bytes other than space and 0x09-0x0D in the UTF-8 form. A word's hash is a
polynomial over random byte values modulo 2^64, taken from running sums, then mixed; equal words
have equal hashes in every process, and two given words share one with a chance near 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 18  # a chunk takes about 100 times its bytes while it is worked on, in each Python worker
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed * 0xD1342543DE82EF95 & _MASK))


_BYTES = random_words(256, 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK) * 3 // 2
        out = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(size, np.uint64)
            done, step = 1, factor
            while done < size:  # double the filled part each time
                more = min(done, size - done)
                table[done : done + more] = table[:more] * np.uint64(step)
                done, step = done + more, step * step & _MASK
            out.append(table)
        have = _powers[0] = (out[0], out[1])
    return have


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are those of the i-th."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    text_at: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(texts: list, limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as UTF-8) for runs of texts of about ``limit`` bytes; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield start, held


def words_of(raws: list[bytes], lower: bool = False) -> Words:
    """The words of the given texts; ``lower`` folds A-Z first."""
    buf = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    if lower:
        buf = buf.copy()
        buf[(buf >= 65) & (buf <= 90)] += 32
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_table(len(buf) + 1)
    run = np.empty(len(buf) + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=run[1:])
    hashes = mix((run[ends] - run[starts]) * down[starts])
    text_at = np.empty(len(raws) + 1, np.int64)
    text_at[0] = 1
    np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1, out=text_at[1:])
    text_at[1:] += 1
    return Words(buf, starts, ends, hashes, np.searchsorted(starts, text_at), text_at)
