"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the tokens in a window and ignore the others, so a window still hashes
alike after a substitution at an ignored place. The benchmark's hashes for every mask and position
are sorted; each batch of documents computes its own and joins them by binary search. A hit fixes an
item and a diagonal; along it the whole overlap is compared token by token, and the best local segment
(a match counts 1, a mismatch -2), or any other segment, must hold enough matches.

Short items are cut into one piece more than they may have mismatches, so one piece at least is whole in
every leak; the pieces are their seeds.

The benchmark is the query set: it is taken in blocks of ``BLOCK_ITEMS`` items and ``BLOCK_CHARS``
characters, each broadcast and run against all documents. More blocks than one are run one after the
other, each pass writing only the rows it hits, so one block at a time is held however long the
benchmark is. Documents are never shuffled.

Seeds that repeat within an item and a text (one word over and over) hit many places of the same few
diagonals; diagonals are marked, not listed by hit, and each is compared once.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import staged, text_batches, with_row_id
from quillon.session import table

WORD = re.compile(r"[^\W_]+")
#: The seed masks (1: the token counts, 0: it is ignored).
MASKS = ("11011011", "110111011", "110111101", "1110110111", "10110111", "11101101011")
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32 << 20
#: Seed hits of a text that are sorted out together, and the most diagonals that are marked in one array.
HITS = 1 << 20
MARKS = 1 << 28
#: Tokens that must match (MIN_SHARE of an item's, if that is fewer), and their least share of the segment.
MIN_MATCHES = 13
MIN_SHARE = 0.8
MISMATCH = -2
#: Items under this many tokens are no evidence of a leak within a text; they are found where they are the whole text.
MIN_ITEM = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xA0761D6478BD642F], np.uint64)


def tokens(text: str | None) -> list[str]:
    """Lower-cased words of a whole text."""
    return WORD.findall((text or "").lower())


def seed_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows all of whose selected tokens are known (id > 0)."""
    picks = [i for i, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids > 0
    good = known[picks[0] : picks[0] + n].copy()
    for p in picks[1:]:
        good &= known[p : p + n]
    at = np.flatnonzero(good)
    h = np.zeros(len(at), np.uint64)
    for p, odd in zip(picks, _ODD, strict=False):
        h = (h ^ (ids[at + p].astype(np.uint64) * odd)) * _ODD[0]
        h ^= h >> np.uint64(29)
    return at, h


def needed(n: int) -> int:
    """The tokens of an item of ``n`` that a leak must match."""
    return min(MIN_MATCHES, math.ceil(MIN_SHARE * n - 1e-9))


def pieces(n: int) -> list[tuple[int, int]]:
    """(start, width) of the pieces of a short item: more than it may have mismatches. None for longer ones."""
    need = needed(n)
    if n < MIN_ITEM or need < MIN_SHARE * n - 1e-9:
        return []
    cuts = [n * i // (n - need + 1) for i in range(n - need + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Block:
    """The seed table of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.tokens = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(t)], np.int32) for _, t in items]
        self.longest = max(map(len, self.tokens), default=0)
        self.whole: dict[tuple[str, ...], list[int]] = {}
        for i, t in items:
            if 0 < len(words := tuple(tokens(t))) < MIN_ITEM:
                self.whole.setdefault(words, []).append(int(i))
        self.seeds = []
        short = [pieces(len(t)) for t in self.tokens]
        widths = sorted({w for p in short for _, w in p})
        for mask in (*MASKS, *("1" * w for w in widths)):
            found = [(k, *seed_hashes(t, mask)) for k, t in enumerate(self.tokens) if mask in MASKS and len(t) >= MIN_ITEM]
            if mask not in MASKS:
                for k, p in enumerate(short):
                    starts, h = seed_hashes(self.tokens[k], mask)
                    own = np.isin(starts, [start for start, w in p if w == len(mask)])
                    found.append((k, starts[own], h[own]))
            h = np.concatenate([f[2] for f in found]) if found else np.empty(0, np.uint64)
            item = np.concatenate([np.full(len(f[1]), f[0]) for f in found]) if found else np.empty(0, np.int64)
            at = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
            order = np.argsort(h, kind="stable")
            self.seeds.append((mask, h[order], item[order], at[order]))

    def hits(self, text: str | None) -> list[dict]:
        """The items that a text holds, each with its best segment: words from ``start``, ``length``, matches."""
        words, lookup = tokens(text), self.vocabulary.get
        if len(words) < MIN_ITEM:
            return [{"item_id": i, "start": 0, "length": len(words), "matches": len(words)} for i in self.whole.get(tuple(words), ())]
        ids = np.array([lookup(w, 0) for w in words], np.int32)
        span = len(ids) + self.longest + 1
        best: dict[int, dict] = {}
        for code in self.diagonals(ids, span).tolist():
            k, offset = code // span, code % span - self.longest
            if (found := self.segment(ids, k, offset) or self.inner(ids, k, offset)) and found["matches"] > best.get(k, {"matches": 0})["matches"]:
                best[k] = found
        return list(best.values())

    def diagonals(self, ids: np.ndarray, span: int) -> np.ndarray:
        """The items and diagonals that any seed hits, sorted, as item * span + offset + longest."""
        codes, marks = np.empty(0, np.int64), None
        for mask, table_h, item, at in self.seeds:
            start, h = seed_hashes(ids, mask)
            low, high = np.searchsorted(table_h, h, "left"), np.searchsorted(table_h, h, "right")
            some = np.flatnonzero(high > low)
            start, low, n = start[some], low[some], (high - low)[some]
            ends = np.cumsum(n)
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HITS, "right")))
                count = n[lo:hi]
                first = np.cumsum(count) - count
                hit = np.repeat(low[lo:hi] - first, count) + np.arange(int(count.sum()))
                found = item[hit] * span + np.repeat(start[lo:hi], count) - at[hit] + self.longest
                lo = hi
                if marks is None and (len(found) < HITS // 2 or len(self.tokens) * span > MARKS):
                    codes = np.unique(np.concatenate((codes, found)))
                    continue
                if marks is None:
                    marks = np.zeros(len(self.tokens) * span, bool)
                marks[found] = True
        return codes if marks is None else np.union1d(codes, np.flatnonzero(marks))

    def segment(self, ids: np.ndarray, k: int, offset: int) -> dict | None:
        """The best local segment (of equal ones the longest) of item k laid at ``offset`` of the text, if it is a leak."""
        item = self.tokens[k]
        lo, hi = max(0, -offset), min(len(item), len(ids) - offset)
        same = item[lo:hi] == ids[lo + offset : hi + offset]
        total = np.concatenate(([0], np.cumsum(np.where(same, 1, MISMATCH))))
        gain = total - np.minimum.accumulate(total)
        end = len(gain) - 1 - int(gain[::-1].argmax())
        start = int(total[: end + 1].argmin())
        matches, length = int(same[start:end].sum()), end - start
        if matches < needed(len(item)) or matches < MIN_SHARE * length:
            return None
        return {"item_id": int(self.ids[k]), "start": start + lo + offset, "length": length, "matches": matches}

    def inner(self, ids: np.ndarray, k: int, offset: int) -> dict | None:
        """Of all segments of item k laid at ``offset`` of the text that are leaks, the one with the most matches.

        A segment has the share if its tokens' weights, weighed so that the share sums to zero, sum to zero
        or more. Its matches only grow to the left, so for every end the leftmost start is the best one.
        """
        item = self.tokens[k]
        lo, hi = max(0, -offset), min(len(item), len(ids) - offset)
        same = item[lo:hi] == ids[lo + offset : hi + offset]
        count = np.concatenate(([0], np.cumsum(same)))
        if count[-1] < needed(len(item)):
            return None
        total = count - MIN_SHARE * np.arange(len(count)) + 1e-9 * np.arange(len(count))
        start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
        matches = count - count[start]
        end = int(matches.argmax())
        if matches[end] < needed(len(item)):
            return None
        places = np.flatnonzero(same[start[end] : end]) + int(start[end])
        first, length = int(places[0]), int(places[-1] - places[0]) + 1
        return {"item_id": int(self.ids[k]), "start": first + lo + offset, "length": length, "matches": int(matches[end])}


def benchmark_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark's items in blocks, read through a local iterator; null ids and texts are skipped."""
    part: list[tuple[int, str]] = []
    chars = 0
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        if part and (len(part) == BLOCK_ITEMS or chars + len(r["t"]) > BLOCK_CHARS):
            yield Block(part)
            part, chars = [], 0
        part.append((r["i"], r["t"]))
        chars += len(r["t"])
    if part:
        yield Block(part)


_LEAKS = "array<struct<item_id:long,start:int,length:int,matches:int>>"


def _search(held: Broadcast):
    """The leaks of a broadcast block in a column of texts."""

    @F.pandas_udf(_LEAKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([held.value.hits(t) for t in texts], dtype=object)

    return run


def find_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", out: str = "leaks") -> DataFrame:
    """Adds an array column ``out`` (replaced if it exists) to every row: item_id, start (word), length
    and matches of every benchmark item that the whole text holds, in item order. Of equally good places
    of an item the first is given. Null and empty texts hold none, an empty benchmark finds none. Rows are
    independent: repeated rows, null ids and columns of any name pass through. A repeated item is found
    as often as it is given. Items without a word can't be found, those of one to three words only as a
    whole text. Very long texts are searched whole."""
    spark = df.sparkSession
    text_batches(spark)
    blocks = benchmark_blocks(items)
    block, more = next(blocks, None), next(blocks, None)
    if block is None:
        return df.withColumn(out, F.array().cast(_LEAKS))
    if more is None:
        return df.withColumn(out, F.array_sort(_search(spark.sparkContext.broadcast(block))(F.col(text_col))))
    rows, found = with_row_id(df), None
    for part in itertools.chain((block, more), blocks):
        held = spark.sparkContext.broadcast(part)
        some = staged(rows.select(F.col("__rid").alias("rid"), _search(held)(F.col(text_col)).alias("found")).where(F.size("found") > 0), "leaks")
        held.destroy()
        found = some if found is None else found.union(some)
    found = found.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("__found"))
    joined = rows.join(found, rows["__rid"] == found["rid"], "left").withColumn(out, F.coalesce("__found", F.array().cast(_LEAKS)))
    return joined.select(*df.columns, *[out] * (out not in df.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the benchmark items it holds (comma-joined, in order), their number and
    the most matching tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
        F.size("leaks").cast("long").alias("n_items"),
        F.coalesce(F.array_max("leaks.matches"), F.lit(0)).cast("long").alias("matches"),
    )
