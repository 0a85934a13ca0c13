"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each text's distinct word shingles are hashed to 64 bits. Texts with the same shingle set form one
   class, so copies are handled once, however many there are. Each class gets ``TREES * 4`` MinHash
   values.
2. Every tree sorts the classes by its own order of the signature. The sort is a range partitioning
   on (tree, prefix, rest, class), so equal prefixes may spread over many tasks. Classes that share
   the first ``BASE_DEPTH`` values form a region; a region of more than ``LEAF`` classes is split one
   value deeper, and again, while there are values (adaptive depth). Each class is paired with the
   first class of its deepest region, and that one with the first of the region around it.
3. Pairs are confirmed on the full shingle sets, and links are closed to components. A class with
   many partners meets them in chunks of ``PARTNERS`` or fewer, so its set is not copied to each of them and no
   task holds them all.
4. Regions that still hold several components are searched again: each class with its nearest
   neighbours of another component in the sorted order.
5. What is left goes to an exact pass: regions that still hold several components are dealt into
   blocks, and blocks are compared two by two, so no region is ever in one task. Blocks grow with the
   region, from 2,000 to 16,000 classes, so that a region of m classes is copied m / 16,000 times at
   most. A pair is taken up in the first tree whose region it shares, unless the estimate from
   ``WIDE`` further hashes is ``SIGMAS`` standard deviations below the threshold (three looks, at 64,
   256 and 1024 hashes, so a pair at the very threshold is lost with a chance of about 1e-5). So every
   pair that shares a region is either confirmed, refuted by its sets or that estimate, or already in
   one component; nothing is capped.

A pair at the threshold shares a prefix in at least one of the 20 trees with a chance of
1 - (1 - s^4)^20: 0.9999996 at 0.85 and 0.99997 at 0.8; closer pairs are surer.

Defined results: null and empty texts, and texts without words, have no shingles and are linked with
nothing; texts of any length are read whole; a text with fewer words than a shingle is one shingle; rows without an id belong to their
class and take its smallest id; repeated rows get equal results; an empty table gives an empty one;
extra columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex import runtime
from strandex.llm.wordhash import Words, chunks, mix, random_words, words_of
from strandex.operators.graph import connected_components
from strandex.runtime import drop_staged, fresh, stage

TREES = 20
BASE_DEPTH = 4
FULL_DEPTH = 8
LEAF = 32
HASHES = TREES * BASE_DEPTH
BYTES_A_TASK = 24 << 20
WIDE = 1024
SIGMAS = 4.5
WINDOW = 8
BLOCK, LARGEST_BLOCK = 2_000, 16_000
PARTNERS, CHUNK_SHINGLES = 32, 1 << 19

_ODD = random_words(HASHES, 7) | np.uint64(1)
_WIDE_ODD = random_words(WIDE, 23) | np.uint64(1)
_JOIN = np.uint64(0x9FB21C651E98DF25)
_SALT = random_words(64, 11)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, in order, and where each text's begin (one more than texts)."""
    h, counts = words.hashes, np.diff(words.first)
    rolled = h.copy()
    for j in range(1, size):
        rolled[: len(h) - j] = mix(rolled[: len(h) - j] * _JOIN + h[j:]) if len(h) > j else rolled[: len(h) - j]
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    keep = np.zeros(len(h), bool)
    begin = words.first[:-1]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + per_text, -1)
    keep = np.cumsum(change[:-1]) > 0
    for i in np.flatnonzero((counts > 0) & (counts < size)):  # the whole sequence is the one shingle
        value = np.uint64(_SALT[counts[i]])
        for x in h[begin[i] : begin[i] + counts[i]]:
            value = mix(np.array([value * _JOIN + x], np.uint64))[0]
        rolled[begin[i]] = value
    return rolled[keep], np.concatenate([[0], np.cumsum(per_text)])


def shingle_sets(raws: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each begins."""
    with np.errstate(over="ignore"):
        hashes, first = shingle_hashes(words_of(raws, lower=True), size)
    parts = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return (np.concatenate(parts) if parts else hashes), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, HASHES) 16-bit MinHash values; rows of empty sets are zero."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, HASHES), np.uint16)
    if len(full):
        at = first[full]
        for j in range(HASHES):
            out[full, j] = np.minimum.reduceat(sets * _ODD[j], at) >> np.uint64(20) & np.uint64(0xFFFF)
    return out


def wide_signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, WIDE) 8-bit MinHash values, for estimates of the similarity of single pairs; no set is empty."""
    out = np.empty((len(first) - 1, WIDE), np.uint8)
    for j in range(WIDE if len(first) > 1 else 0):
        out[:, j] = np.minimum.reduceat(sets * _WIDE_ODD[j], first[:-1]) >> np.uint64(20) & np.uint64(0xFF)
    return out


def set_keys(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values that depend on the set alone."""
    keys = []
    for salt in _SALT[:2]:
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ salt))])
        keys.append((run[first[1:]] - run[first[:-1]]).view(np.int64))
    return keys[0], keys[1]


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, a, b, sig) of every row, and its columns ``keep``."""

    @F.pandas_udf("struct<n long, a long, b long, sig binary>")
    def prints(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for _, raws in chunks(texts.tolist()):
            sets, first = shingle_sets(raws, shingle)
            a, b = set_keys(sets, first)
            sig = signatures(sets, first)
            parts.append(pd.DataFrame({"n": np.diff(first), "a": a, "b": b, "sig": [row.tobytes() for row in sig]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["n", "a", "b", "sig"])

    return docs.select(F.col(doc_id).alias("doc_id"), *keep, prints(F.col(text)).alias("p")).select("doc_id", *keep, "p.*")


ENTRY_BYTES = 60
ENTRIES = "tree int, k1 long, k2 long, cid long, n long, comp long"


def tree_entries(classes: DataFrame) -> DataFrame:
    """One row per class and tree: the first four values of the tree's order, the next four, the class."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["sig"]), np.uint16).reshape(-1, HASHES)
            for t in range(TREES):
                order = (np.arange(FULL_DEPTH) + t * BASE_DEPTH) % HASHES
                key = np.ascontiguousarray(sig[:, order].astype(">u2")).view(">i8").astype(np.int64)
                yield pd.DataFrame({"tree": np.int32(t), "k1": key[:, 0], "k2": key[:, 1], "cid": batch["cid"], "n": batch["n"], "comp": batch["comp"]})

    return classes.select("cid", "n", "comp", "sig").mapInPandas(expand, ENTRIES)


def in_order(entries: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Entries range-partitioned and sorted, in as many tasks as their bytes ask for."""
    spark = entries.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * row_bytes // BYTES_A_TASK))
    by = ["tree", "k1", "k2", "cid"]
    return entries.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


REGION_ROWS = "kind int, tree int, k1 long, cid long, n long, leader long, leader_n long"


def _leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of each class with the first of its region, from one sorted run of entries.

    kind 0: a class and the leader of its deepest region; 1: that leader and the one around it;
    2: the outermost leader of a region that may go on in the next or previous task.
    """
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    tree, k1, k2, cid, n = (rows[c].to_numpy() for c in ("tree", "k1", "k2", "cid", "n"))
    size = len(rows)
    new = _runs(tree, k1)
    starts = np.flatnonzero(new)
    region = np.cumsum(new) - 1
    counts = np.diff(np.append(starts, size))
    low = np.minimum.reduceat(cid, starts)[region]
    leader, around, splitting = low.copy(), low.copy(), counts[region] > LEAF
    for depth in range(1, FULL_DEPTH - BASE_DEPTH + 1):
        if not splitting.any():
            break
        deeper = new | _runs(k2 >> np.int64(16 * (FULL_DEPTH - BASE_DEPTH - depth)))
        at = np.flatnonzero(deeper)
        sub = np.cumsum(deeper) - 1
        sub_low = np.minimum.reduceat(cid, at)[sub]
        around[splitting], leader[splitting] = leader[splitting], sub_low[splitting]
        splitting &= np.diff(np.append(at, size))[sub] > LEAF
    of = dict(zip(cid.tolist(), n.tolist(), strict=True))
    wide = counts[region] > 1

    def out(kind: int, pick: np.ndarray, lead: np.ndarray) -> pd.DataFrame:
        lead = lead[pick]
        return pd.DataFrame({"kind": np.int32(kind), "tree": tree[pick], "k1": k1[pick], "cid": cid[pick], "n": n[pick], "leader": lead, "leader_n": [of[x] for x in lead.tolist()]})

    yield out(0, np.flatnonzero(wide), leader)
    yield out(1, np.flatnonzero(wide & (cid == leader) & (leader != around)), around)
    border = (region == 0) | (region == region[-1])
    yield out(2, np.flatnonzero(border & (cid == low)), low)


def _worth(left: pd.DataFrame, right: pd.DataFrame, i: np.ndarray, j: np.ndarray, sigs: tuple, wides: tuple, tree: int, percent: int) -> np.ndarray:
    """Which of the pairs (i of left, j of right) should be confirmed in this tree."""
    n1, n2 = left["n"].to_numpy()[i], right["n"].to_numpy()[j]
    ok = (left["comp"].to_numpy()[i] != right["comp"].to_numpy()[j]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
    s = percent / 100
    for hashes in (WIDE // 16, WIDE // 4, WIDE):
        at = np.flatnonzero(ok)
        share = (wides[0][i[at], :hashes] == wides[1][j[at], :hashes]).mean(axis=1)
        ok[at] = share >= s - SIGMAS * (s * (1 - s) / hashes) ** 0.5
    at = np.flatnonzero(ok)
    ok[at] = (sigs[0][i[at]] == sigs[1][j[at]]).argmax(axis=1) == tree  # the first shared region
    return ok


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of all trees, one word each, and the wide signatures."""
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint64).reshape(len(rows), TREES)
    return sig, np.frombuffer(b"".join(rows["wide"]), np.uint8).reshape(len(rows), WIDE)


def _found(left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right)})


def _neighbours(percent: int):
    """Pairs up to ``WINDOW`` apart in one region, from sorted runs of entries."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        sig, wide = _arrays(rows)
        tree = rows["tree"].to_numpy()
        region = np.cumsum(_runs(tree, rows["k1"].to_numpy()))
        cid = rows["cid"].to_numpy()
        for gap in range(1, WINDOW + 1):
            at = np.flatnonzero(region[gap:] == region[:-gap])
            for t in np.unique(tree[at]):
                own = at[tree[at] == t]
                ok = own[_worth(rows, rows, own, own + gap, (sig, sig), (wide, wide), t, percent)]
                if len(ok):
                    yield _found(cid[ok], cid[ok + gap])

    return scan


def _block_pairs(percent: int):
    """All pairs worth confirming between two blocks of a region, or within one."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi, tree = (int(rows[c].iloc[0]) for c in ("lo", "hi", "tree"))
        left = rows[rows["block"] == lo].reset_index(drop=True)
        right = left if lo == hi else rows[rows["block"] == hi].reset_index(drop=True)
        if left["comp"].nunique() == 1 and set(left["comp"].unique()) == set(right["comp"].unique()):
            return _found(np.empty(0, np.int64), np.empty(0, np.int64))
        (s1, w1), (s2, w2) = _arrays(left), _arrays(right)
        a, b = [], []
        for i in range(len(left)):
            j = np.arange(i + 1 if lo == hi else 0, len(right))
            ok = j[_worth(left, right, np.full(len(j), i), j, (s1, s2), (w1, w2), tree, percent)]
            a.append(np.full(len(ok), left["cid"].iloc[i], np.int64))
            b.append(right["cid"].to_numpy()[ok])
        return _found(np.concatenate(a or [np.empty(0, np.int64)]), np.concatenate(b or [np.empty(0, np.int64)]))

    return pairs


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets reach the threshold."""

    @F.pandas_udf("array<long>")
    def linked(own: pd.Series, partners: pd.Series) -> pd.Series:
        out = []
        for x, some in zip(own, partners, strict=True):
            p, kept = np.frombuffer(x, np.uint64), []
            for partner in some:
                q = np.frombuffer(partner["theirs"], np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")  # two sorted runs, which are merged
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(both) - shared):
                    kept.append(partner["other"])
            out.append(kept)
        return pd.Series(out)

    # the end with more partners is the hub; its partners meet it in chunks
    ends_of = lambda end: pairs.groupBy(F.col(end).alias("cid")).agg(F.count(F.lit(1)).alias("d"))
    degrees = ends_of("a").unionAll(ends_of("b")).groupBy("cid").agg(F.sum("d").alias("d")).join(sets.select("cid", "n"), "cid")
    # partners of a pair are of like size, so the hub's tells how many fit a chunk
    degrees = degrees.withColumn("fit", F.least(F.lit(PARTNERS), F.greatest(F.lit(1), F.floor(F.lit(CHUNK_SHINGLES) / F.col("n")))))
    of = lambda end: degrees.select(F.col("cid").alias(end), F.col("d").alias(f"d_{end}"), F.col("fit").alias(f"fit_{end}"))
    ends = pairs.join(of("a"), "a").join(of("b"), "b")
    hub = F.col("d_a") >= F.col("d_b")
    ends = ends.select(F.when(hub, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub, F.col("b")).otherwise(F.col("a")).alias("other"), F.when(hub, F.ceil(F.col("d_a") / F.col("fit_a"))).otherwise(F.ceil(F.col("d_b") / F.col("fit_b"))).alias("chunks"))
    ends = ends.withColumn("chunk", F.pmod(F.xxhash64("other"), F.col("chunks")))
    other = sets.select(F.col("cid").alias("other"), F.col("members").alias("theirs"))
    met = ends.join(other, "other").groupBy("hub", "chunk").agg(F.collect_list(F.struct("other", "theirs")).alias("partners"))
    own = sets.select(F.col("cid").alias("hub"), F.col("members").alias("own"))
    found = met.join(own, "hub").select("hub", F.explode(linked("own", "partners")).alias("other"))
    return found.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"))


@contextmanager
def _small_batches(spark, rows: int = 100):
    """Arrow batches of few rows, since a row here may hold many full shingle sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _links(pairs: DataFrame, sets: DataFrame, percent: int, stage) -> DataFrame:
    with _small_batches(pairs.sparkSession):
        return stage(_confirm(pairs, sets, percent), "ndlinks")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row, with its columns ``keep``.

    Two documents are linked where 100 * shared >= percent * united over their distinct shingles.
    """
    base = stage(fingerprints(docs, shingle, doc_id, text, keep), "ndbase")
    grouped = base.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stage(grouped.withColumn("cid", F.monotonically_increasing_id()), "ndclass")
    used: list[DataFrame] = []
    labels = _class_components(docs, classes, shingle, percent, doc_id, text, used)
    if labels is None:
        named = classes.where("copies > 1").select("a", "b", F.col("first_doc").alias("component_id"))
    else:
        whole = classes.join(labels, "cid", "left").select("a", "b", "copies", "first_doc", F.coalesce("comp", "cid").alias("comp"), F.col("comp").isNotNull().alias("linked"))
        firsts = whole.where("linked").groupBy("comp").agg(F.min("first_doc").alias("component_first"))
        named = whole.where("linked or copies > 1").join(firsts, "comp", "left").select("a", "b", F.coalesce("component_first", "first_doc").alias("component_id"))
    named = stage(named.withColumn("named", F.lit(True)), "ndnamed")
    for table in (classes, *used):
        drop_staged(table)
    out = base.join(named, ["a", "b"], "left")
    component = F.when(F.col("named") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), *keep)


def _class_components(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, doc_id: str, text: str, used: list[DataFrame]) -> DataFrame | None:
    """(cid, comp) of the classes that are linked with another one; None where there are none. ``used`` gets the staged tables."""

    def stage(df: DataFrame, label: str) -> DataFrame:
        used.append(runtime.stage(df, label))
        return used[-1]

    rows = classes.count() * TREES
    own = classes.withColumn("comp", F.col("cid"))
    regions = stage(in_order(tree_entries(own), rows, ENTRY_BYTES).mapInPandas(_leaders, REGION_ROWS), "ndregions")
    borders = regions.where("kind = 2")
    meet = borders.groupBy("tree", "k1").agg(F.min("cid").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    meet = borders.join(meet, ["tree", "k1"]).where("cid <> m").join(classes.select(F.col("cid").alias("m"), F.col("n").alias("m_n")), "m")
    tied = regions.where("kind < 2 and cid <> leader").select(F.least("cid", "leader").alias("a"), F.greatest("cid", "leader").alias("b"), "n", F.col("leader_n").alias("o"))
    tied = tied.unionAll(meet.select(F.least("cid", "m").alias("a"), F.greatest("cid", "m").alias("b"), "n", F.col("m_n").alias("o")))
    tied = stage(tied.distinct(), "ndtied")
    involved = stage(tied.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ndinvolved")
    if involved.isEmpty():
        return None
    some = classes.join(involved, "cid")
    sets = stage(_sets_of(docs, some, shingle, doc_id, text), "ndsets")
    pairs = tied.where(100 * F.least("n", "o") >= percent * F.greatest("n", "o")).select("a", "b")
    tested = stage(pairs.distinct(), "ndtested")
    links = _links(tested, sets, percent, stage)
    now = _relabel(some.select("cid", "n", "sig", F.col("cid").alias("comp")), links, stage)

    near = _mixed_regions(now, sets, stage)
    if near is not None:
        found = stage(in_order(near.drop("members"), near.count(), ENTRY_BYTES + 2 * HASHES + WIDE).mapInPandas(_neighbours(percent), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"), "ndnear")
        now = _relabel(now, _links(found, sets, percent, stage), stage)
        tested = tested.unionAll(found)
        rest = _mixed_regions(now, sets, stage)
        if rest is not None:
            size = F.least(F.lit(LARGEST_BLOCK), F.greatest(F.lit(BLOCK), F.col("members") / 8))
            blocks = F.ceil(F.col("members") / size).cast("int")
            dealt = rest.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            dealt = dealt.select("tree", "k1", "cid", "n", "comp", "sig", "wide", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
            found = stage(dealt.groupBy("tree", "k1", "lo", "hi").applyInPandas(_block_pairs(percent), "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"), "ndrest")
            now = _relabel(now, _links(found, sets, percent, stage), stage)
    sizes = now.groupBy("comp").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return now.join(sizes, "comp").select("cid", "comp")


def _relabel(now: DataFrame, links: DataFrame, stage) -> DataFrame:
    """``now`` with components closed over further links between classes."""
    if links.isEmpty():
        return now
    at = now.select("cid", "comp")
    joined = links.join(at.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), "a").join(at.select(F.col("cid").alias("b"), F.col("comp").alias("cb")), "b")
    merged = connected_components(joined, "ca", "cb")
    return stage(now.join(merged, F.col("comp") == F.col("node"), "left").select("cid", "n", "sig", F.coalesce("component", "comp").alias("comp")), "ndnow")


def _mixed_regions(now: DataFrame, sets: DataFrame, stage) -> DataFrame | None:
    """Entries, with signatures, of the regions that hold several components; None where there are none."""
    entries = tree_entries(now)
    mixed = entries.groupBy("tree", "k1").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"))
    mixed = stage(mixed.where("low < high").select("tree", "k1", "members"), "ndmixed")
    if mixed.isEmpty():
        return None
    rows = entries.join(mixed, ["tree", "k1"]).join(now.select("cid", "sig"), "cid").join(sets.select("cid", "wide"), "cid")
    return stage(rows.select("tree", "k1", "k2", "cid", "n", "comp", "sig", "wide", "members"), "ndactive")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """(cid, n, members, wide): the full shingle set of each wanted class, from a row with its smallest id."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, raws in chunks(batch["text"].tolist()):
                rows = batch.iloc[start : start + len(raws)]
                sets, first = shingle_sets(raws, shingle)
                a, b = set_keys(sets, first)
                wide = wide_signatures(sets, first)
                right = np.flatnonzero((a == rows["a"].to_numpy()) & (b == rows["b"].to_numpy()))
                yield pd.DataFrame({"cid": rows["cid"].to_numpy()[right], "n": np.diff(first)[right], "members": [sets[first[i] : first[i + 1]].tobytes() for i in right], "wide": [wide[i].tobytes() for i in right]})

    ids = wanted.select("first_doc", "a", "b", "cid")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("first_doc")))
    made = rows.select("text", "a", "b", "cid").mapInPandas(make, "cid long, n long, members binary, wide binary")
    return made.groupBy("cid").agg(F.first("n").alias("n"), F.first("members").alias("members"), F.first("wide").alias("wide"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with its own columns: that with the smallest id.

    Rows go by id and text together: of two texts that share an id, or have none, only the one that is
    another's copy goes. Rows equal in both are one document and stay or go together.
    """
    name, seal = fresh(docs, "__gone"), fresh(docs, "__seal")
    sealed = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias(seal))
    gone = near_duplicates(sealed, shingle, percent, keep=(seal,)).where("not kept").select(F.col("doc_id").alias(name), seal).distinct()
    gone = stage(gone, "ndgone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)) & F.md5(F.col("text").cast("binary")).eqNullSafe(F.col(seal)), "left_anti")


def op8_lsh_forest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, percent=85)
