"""SimHash near-duplicates through a Gray-order hierarchical index.

Every distinct fingerprint is routed by each of its segments (one more segment than differing bits
allowed, so a linked pair agrees in one of them at least). Within a segment value, fingerprints are
sorted by Gray rank, so that neighbours share most bits, and a tree is built over them: a node keeps
the bits that all below it share as a mask and a pattern. The self-join walks pairs of nodes from
the root; a child adds only the differences in bits that its parents' masks left open to the
difference accumulated so far, and a pair of groups is dropped as a whole once that exceeds the bound.

A segment value held by more than ``hot`` distinct fingerprints (a large cluster of near copies) is
not joined in one task: its fingerprints are routed on by segments of the bits that are left, each
with its own tree.

Links become components; only fingerprints, never documents or all pairs, are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import join_groups, staged, text_batches
from quillon.llm.components import components
from quillon.session import table

BITS = 2
FAN = 8
#: A segment value with more distinct fingerprints is split by further segments.
HOT = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str | None) -> list[bytes]:
    """The words between white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text's word shingles, repeats included."""
    import xxhash

    words = words_of(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    totals, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, n, 1 << 14):
        hi = min(n, lo + (1 << 14))
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo:hi], ends[lo + shingle - 1 : hi + shingle - 1], strict=True)], np.uint64)
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return run(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each code in the binary-reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_ranks(words: np.ndarray) -> list[np.ndarray]:
    """The Gray rank of codes of several words, first word highest: a word whose rank before ends in 1 is inverted."""
    ranks: list[np.ndarray] = []
    for k in range(words.shape[1]):
        rank = gray_rank(words[:, k])
        ranks.append(rank ^ -(ranks[-1] & np.uint64(1)) if ranks else rank)
    return ranks


class GrayIndex:
    """Trees over the groups of equal key of Gray-sorted fingerprints, one root for each group.

    A fingerprint is one 64-bit word or a row of several. levels[l] holds a level's nodes: pattern, mask
    of shared bits, first child and end of children. ``order`` tells which input row each place holds.
    """

    def __init__(self, key: np.ndarray, fp: np.ndarray):
        words = fp.reshape(len(fp), -1)
        self.order = order = np.lexsort((*gray_ranks(words)[::-1], key))
        self.key, self.fp, words = key[order], fp[order], words[order]
        self.levels = [(words, np.full(words.shape, ~np.uint64(0)), None, None)]
        owner = self.key
        while True:
            low, high = self.levels[-1][0], self.levels[-1][0] | ~self.levels[-1][1]
            new_key = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            within = np.arange(len(owner)) - np.repeat(new_key, np.diff(np.append(new_key, len(owner))))
            first = np.flatnonzero(within % FAN == 0)
            shared_ones, any_ones = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            self.levels.append((shared_ones, ~(shared_ones ^ any_ones), first, np.append(first[1:], len(owner))))
            owner = owner[first]
            if len(new_key) == len(first):
                return

    def pairs(self, bits: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i < j) of fingerprints of one group within ``bits`` differing bits."""
        for i, j, _ in self.near(bits, most):
            yield i, j

    def near(self, bits: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions (i < j) of fingerprints of one group within ``bits`` differing bits, and how many differ."""
        top, roots = len(self.levels) - 1, np.arange(len(self.levels[-1][0]))
        stack = [(top, roots, roots, np.zeros(len(roots), np.int64))]
        while stack:
            level, i, j, far = stack.pop()
            if level == 0:
                yield i, j, far
                continue
            if len(i) > most // FAN**2:
                half = len(i) // 2
                stack += [(level, i[:half], j[:half], far[:half]), (level, i[half:], j[half:], far[half:])]
                continue
            _, mask, first, end = self.levels[level]
            pattern, below, _, _ = self.levels[level - 1]
            a = first[i][:, None, None] + np.arange(FAN)[None, :, None]
            b = first[j][:, None, None] + np.arange(FAN)[None, None, :]
            real = (a < end[i][:, None, None]) & (b < end[j][:, None, None]) & ((a < b) if level == 1 else (a <= b))
            at, x, y = np.nonzero(real)
            a, b = first[i][at] + x, first[j][at] + y
            differ = pattern[a] ^ pattern[b]
            if level > 1:  # leaves know all their bits; what their parents had is counted with the rest
                known = mask[i] & mask[j]
                differ &= below[a] & below[b] & ~known[at]
                far = far[at] + np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            else:
                far = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            near = far <= bits
            if near.any():
                stack.append((level - 1, a[near], b[near], far[near]))


def lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n through the links (i, j)."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> pa.RecordBatch:
    """Edges from each linked fingerprint to the first of its component within its group."""
    index = GrayIndex(key, fp.view(np.uint64))
    label = np.arange(len(fp))
    for i, j in index.pairs(bits):
        label = lowest(len(fp), np.concatenate((np.arange(len(fp)), i)), np.concatenate((label, j)))
    at = np.flatnonzero(label != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays([pa.array(index.fp[at].view(np.int64)), pa.array(index.fp[label[at]].view(np.int64))], names=["a", "b"])


def _join_groups_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            if len(key) < 20_000:
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _links(key[:cut], fp[:cut], bits)
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield _links(key, fp, bits)

    return run


def split(mask: int, parts: int = BITS + 1) -> list[int]:
    """``mask`` and one of ``parts`` even runs of the bits it leaves out: fingerprints that agree in the mask and
    differ in fewer bits than there are parts agree in one of the results too."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _routed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(key, mask, fp): a fingerprint's value under each mask; ``fps`` may have a column ``within``, the one mask to split."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    known = F.array(*(F.struct(F.lit(signed(of)).cast("long").alias("of"), F.lit(signed(m)).cast("long").alias("m")) for of in masks for m in split(of)))
    own = F.filter(known, lambda x: x["of"] == F.col("within")) if "within" in fps.columns else known
    return fps.select("fp", F.explode(own).alias("x")).select(F.xxhash64("x.m", F.col("fp").bitwiseAND(F.col("x.m"))).alias("key"), F.col("x.m").alias("mask"), "fp")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): enough links between distinct fingerprints (fp) to connect all within two bits.

    A value that more than ``hot`` fingerprints have under a mask is routed on by segments of the bits that
    are left, each again with its own tree, until no group is larger or three levels are split: what then
    still agrees leaves under 20 bits free."""
    masks, open_rows, found = [0], fps, None
    for level in range(3):
        routed = _routed(open_rows, masks)
        large = staged(routed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot-segments") if level < 2 else None
        if large is None or large.isEmpty():
            cold, open_rows = routed, None
        else:
            tagged = staged(join_groups(routed, large, ["key"], "left"), "segments")
            cold = tagged.where("n is null").select("key", "mask", "fp")
            open_rows = tagged.where("n is not null").select("fp", F.col("mask").alias("within"))
            masks = [m for of in masks for m in split(of)]
        part = cold.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_join_groups_of(BITS), "a long, b long")
        found = part if found is None else found.union(part)
        if open_rows is None:
            return found


def simhash_components(marked: DataFrame) -> DataFrame:
    """Adds ``keep``, the struct (null id, id, rid) of the smallest document reachable, to rows of
    (id, rid, fp): documents whose fingerprints differ in two bits or fewer are linked."""
    fps = staged(marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "rid")).alias("first")), "fingerprints")
    roots = components(links(fps))
    rooted = staged(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    keep = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    by_fp = staged(join_groups(rooted.select("fp", "root"), keep, ["root"]).select("fp", "keep"), "kept")
    return marked.join(by_fp, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every row of ``documents``."""
    text_batches(spark)
    docs = table(spark, sf_dir, "documents")
    marked = staged(docs.select(F.col("doc_id").alias("id"), fingerprints(F.col("text")).alias("fp"), F.monotonically_increasing_id().alias("rid")), "simhash")
    return simhash_components(marked).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("keep.id").alias("component_id")
    )
