"""Best-fit packing of token sequences, improved by swaps between underfull bins.

Documents become token ids of a public tokenizer followed by an end id; only those longer than a
sequence are cut, with the shorter piece first. Pieces are dealt evenly into groups of about
``GROUP`` rows, packed best-fit decreasing, then a local search moves documents, swaps one for one
and two for one (either way) between underfull bins. Every accepted step makes the fuller bin fuller,
so the sum of squared fills rises, and bins run empty. A group wastes less than one bin more than
one big group would, so the number of groups hardly matters for the number of sequences.

Ids are those of the vocabulary's tokenizer file, its special strings included. They are made by a
faster library with the same rules; a text on which that one gives up (a run of white space of many
hundred thousand characters) goes through the file's own.

Defined results: null and empty texts are the end id alone; texts of any length are read whole; ties
are settled by length, id and piece; repeated rows are packed as often as they come; an empty table
gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.runtime import stage

CAPACITY = 1024
END_ID = 2
GROUP = 65_536
TOKENIZER = "byte_bpe_50k"


class Encoder:
    """The byte-level BPE of a public vocabulary: same ids as its tokenizer file."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.own = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        special = {token.content: i for i, token in self.own.get_added_tokens_decoder().items()}
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> bytes:
        """All ids of a text, four bytes each, lowest first."""
        if not text:
            return b""
        try:
            made = self.model.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern needs too deep a stack
            made = np.array(self.own.encode(text, add_special_tokens=False).ids)
        return made.astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = TOKENIZER) -> Encoder:
    """One per process and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    head = total % capacity or capacity
    return [(0, head)] + [(at, capacity) for at in range(head, total, capacity)]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = TOKENIZER, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    end = np.array([end_id], "<u4").tobytes()
    fields = "struct<piece int, start long, length long, ids_crc32 long" + (", ids array<int>>" if with_ids else ">")

    @F.pandas_udf(f"array<{fields}>")
    def tokens(texts: pd.Series) -> pd.Series:
        encode, out = encoder(vocabulary).ids, []
        for text in texts:
            ids = encode(text) + end
            made = []
            for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + length)]
                row = {"piece": piece, "start": start, "length": length, "ids_crc32": zlib.crc32(part)}
                made.append(row | {"ids": np.frombuffer(part, "<u4").astype(np.int32)} if with_ids else row)
            out.append(made)
        return pd.Series(out)

    made = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("p"))
    return made.select("doc_id", "p.*")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit over lengths in the given order: bins as lists of positions.

    Open bins are kept by free space; the set of free spaces in use is one integer's bits, so the
    tightest fit is its lowest set bit at or above the length.
    """
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    in_use = 0
    for i, length in enumerate(lengths):
        fits = in_use >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                in_use ^= 1 << free
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        free -= length
        if free:
            by_free[free].append(b)
            in_use |= 1 << free
    return bins


class Exchange:
    """Local search over underfull bins that fills the fuller ones and empties the rest."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = {b: list(items) for b, items in enumerate(bins)}
        self.fill = {b: sum(lengths[i] for i in items) for b, items in self.bins.items()}
        # where a length, or the sum of two lengths, can be taken out: free space -> bins
        self.single: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.double: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.most1 = np.full(capacity + 1, -1)
        self.most2 = np.full(capacity + 1, -1)
        # all underfull bins by free space; the frees in use are one integer's bits
        self.steps = 0
        self.by_free: dict[int, set[int]] = defaultdict(set)
        self.frees = 0
        for b in self.bins:
            if self.fill[b] < capacity:
                self._register(b, True)

    def _sums(self, b: int) -> tuple[set[int], set[int]]:
        own = [self.lengths[i] for i in self.bins[b]]
        return set(own), {x + y for n, x in enumerate(own) for y in own[n + 1 :]}

    def _register(self, b: int, add: bool) -> None:
        free = self.capacity - self.fill[b]
        if not free or not self.bins[b]:
            return
        (self.by_free[free].add if add else self.by_free[free].discard)(b)
        self.frees = self.frees | 1 << free if self.by_free[free] else self.frees & ~(1 << free)
        for table, most, sums in zip((self.single, self.double), (self.most1, self.most2), self._sums(b), strict=True):
            for s in sums:
                if add:
                    table[s][free].add(b)
                    most[s] = max(most[s], free)
                else:
                    table[s][free].discard(b)
                    if not table[s][free]:
                        del table[s][free]
                        most[s] = max(table[s], default=-1)

    def _target(self, table, most: np.ndarray, give: int, source: int) -> tuple[int, int] | None:
        """The largest gain: a bin that takes ``give`` for something of ``give - gain`` and has room for the gain."""
        gains = np.arange(1, give)
        possible = np.flatnonzero(most[give - gains] >= gains)
        for gain in gains[possible[::-1]].tolist():
            for free, bins in table[give - gain].items():
                if free >= gain:
                    for b in bins:
                        if b != source and self.fill[b] >= self.fill[source]:
                            return gain, b
        return None

    def _pick(self, b: int, total: int, count: int) -> list[int]:
        items = self.bins[b]
        if count == 1:
            return [next(i for i in items if self.lengths[i] == total)]
        return next([i, j] for n, i in enumerate(items) for j in items[n + 1 :] if self.lengths[i] + self.lengths[j] == total)

    def _swap(self, a: int, out_of_a: list[int], b: int, out_of_b: list[int]) -> None:
        self.steps += 1
        for x in (a, b):
            self._register(x, False)
        for x, gone, come in ((a, out_of_a, out_of_b), (b, out_of_b, out_of_a)):
            self.bins[x] = [i for i in self.bins[x] if i not in gone] + come
            self.fill[x] += sum(self.lengths[i] for i in come) - sum(self.lengths[i] for i in gone)
        for x in (a, b):
            self._register(x, True)

    def _step(self, source: int) -> bool:
        """Move or exchange something of ``source`` so that another bin gets fuller."""
        items = sorted(self.bins[source], key=lambda i: -self.lengths[i])
        for i in items:  # a plain move, to the bin it fills best
            b = self._room(self.lengths[i], source)
            if b is not None:
                self._swap(source, [i], b, [])
                return True
        offers = [([i], self.lengths[i]) for i in items]
        offers += [([i, j], self.lengths[i] + self.lengths[j]) for n, i in enumerate(items) for j in items[n + 1 :] if self.lengths[i] + self.lengths[j] <= self.capacity]
        best = None
        for give, total in offers:
            for table, most, count in ((self.single, self.most1, 1), (self.double, self.most2, 2)):
                if len(give) == 2 and count == 2:
                    continue
                found = self._target(table, most, total, source)
                if found and (best is None or found[0] > best[0]):
                    best = (*found, give, total - found[0], count)
        if best is None:
            return False
        _, b, give, wanted, count = best
        self._swap(source, give, b, self._pick(b, wanted, count))
        return True

    def _room(self, length: int, source: int) -> int | None:
        """The fullest bin with room for ``length``, if the move raises the sum of squared fills."""
        fits = self.frees >> length
        free = length - 1
        while fits:
            step = (fits & -fits).bit_length()
            free += step
            if self.capacity - free + length <= self.fill[source]:
                return None
            for b in self.by_free[free]:
                if b != source:
                    return b
            fits >>= step
        return None

    def _pass(self, left: int, lowest: int) -> int:
        """Try to empty every underfull bin once, the emptiest first; returns the bins left."""
        for _, source in sorted((self.fill[b], b) for b in self.bins if self.bins[b] and self.fill[b] < self.capacity):
            if left <= lowest:
                break
            while self.bins[source] and self.fill[source] < self.capacity and self._step(source):
                pass
            left -= not self.bins[source]
        return left

    def run(self, lowest: int) -> list[list[int]]:
        """Until no bin can be emptied any further, or only ``lowest`` bins (a bound) are left."""
        left, before = len(self.bins), -1
        while left > lowest and self.steps != before:
            before = self.steps
            left = self._pass(left, lowest)
        return [items for items in self.bins.values() if items]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, largest_first: bool = True) -> list[list[int]]:
    """Bins of positions for lengths up to ``capacity``: best fit, largest first or as they come, then the exchange."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i]) if largest_first else range(len(lengths))
    bins = [[order[i] for i in b] for b in best_fit([lengths[i] for i in order], capacity)]
    lowest = -(-sum(lengths) // capacity)
    return bins if len(bins) <= lowest else Exchange(bins, lengths, capacity).run(lowest)


def assign(made: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces. Groups are dealt by position, so no key can fill one."""
    rows = stage(made, "pieces")
    groups = max(1, round(rows.count() / group))
    # ids travel as text, since pandas would turn a column with nulls into floats
    kind = rows.schema["doc_id"].dataType
    dealt = rows.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([c for c in ("length", "doc_id", "piece", "start", "ids_crc32") if c in part], ignore_index=True)
        lengths = part["length"].tolist()
        sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for number, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = number, at
                at += lengths[i]
        part["sequence_id"] = sequence + part["group"].to_numpy(np.int64) * (1 << 32)
        part["offset"] = offset
        return part

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, `offset` long"
    placed = dealt.groupBy("group").applyInPandas(pack, schema).drop("group")
    return placed.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = TOKENIZER, with_ids: bool = False, **options) -> DataFrame:
    """Pieces of all documents with their place: sequence_id and offset (and ids if asked for)."""
    return assign(pieces(docs, doc_id, text, capacity, vocabulary=vocabulary, with_ids=with_ids, **options), capacity)


def op1_swap_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
