"""Substring deduplication by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if it lies in a string of ``length`` bytes (a window) that also starts anywhere else.
Sorting the suffix of every byte would move hundreds of times the input, so suffixes are taken at
anchors only. A window's anchor is the leftmost of its 64-byte grams with the least hash: it depends on
the window's bytes alone, so equal windows have equal anchors at equal offsets, and consecutive windows
mostly share theirs. Anchors whose gram occurs once in the corpus are done with.

Each task sorts the suffixes at its remaining anchors (by gram, then following bytes), merges equal
contexts and writes a front-coded run: the length of the prefix shared with the entry before, then the
rest; the bytes before the anchor are kept reversed in the same way. Runs are exchanged by gram range and
merged by loser trees in which every entry carries its common prefix with the last output: the longer one
wins without looking at bytes, and a tie is compared from that prefix on. The merge yields the suffix
order with its common-prefix array; a second order of the reversed bytes before the anchors gives the
same to the left. A window at offset o before its anchor recurs exactly if another entry agrees with it
in 400 - o bytes onwards and o bytes back, that is, in the classes which both arrays cut at these depths.

A gram in a very common passage has a context for each document at the passage's ends. Such grams are
split by offset: windows at different offsets never equal, so every chunk of offsets is a group of its
own. All windows of a chunk span the same bytes but for a few at either end; these common bytes go into
the group's 128-bit number, and contexts keep the few others only. Windows that differ there are in
different groups, in different tasks, and equal ones merge into one entry a run. For the hottest grams
a chunk is a single offset: its context is the number alone.

"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, flag_members, join_groups, staged, text_batches, with_row_id
from quillon.session import table

LENGTH = 400
GRAM = 64
#: Bytes of contexts that a task gathers before it writes a run, and of runs that one task merges.
RUN_BYTES = 32 << 20
MERGE_BYTES = 12 << 20
#: A gram at more anchors than this is taken apart by offsets, CHUNK (at most GRAM) at a time; at more than HOTTEST_GRAM, one at a time.
HOT_GRAM = 2048
CHUNK = 64
HOTTEST_GRAM = 1 << 18
#: Windows of a document that are looked at together (positions take 24 bits of an anchor's rank).
SEGMENT = 1 << 22
#: Entries whose offsets are resolved together.
RESOLVE = 16_384
_VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_HEAD = struct.Struct(">QHHHHIH")
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 17)
        for k, base in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base))), dtype=np.uint64)
    return _POWERS


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """The hash of every gram, from prefix sums of a polynomial."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by running minima within blocks from either side."""
    n = len(x) - w + 1
    blocks = np.concatenate((x, np.full(-len(x) % w, ~np.uint64(0)))).reshape(-1, w)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a whole text: anchors, the least and the largest offset of their windows, gram hashes."""
    out = []
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(data) - length + 1), SEGMENT):
        h = gram_hashes(data[start : start + SEGMENT + length - 1], gram)
        rank = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_least(rank, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        a = at[first]
        out.append((a + start, a - last, a - first, h[a].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, r, found = [], [], []
            for key_f, key_r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if len((got := anchors(text.as_py(), length))[0]):
                    found.append(got)
                    f.append(np.full(len(got[0]), key_f))
                    r.append(np.full(len(got[0]), key_r))
            if found:
                a, least, most, h = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)), pa.array(np.concatenate(r)), pa.array(a), pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(h)], names=["f", "r", "a", "least", "most", "h"])

    return run


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes needn't be looked at."""
    lo, hi = known, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    step = 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(hi, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def front_code(entries: list[tuple[int, bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (group, bytes on, reversed bytes back, number, mark). A mark's lowest bit tells that the run has
    the context more than once, the next that its chunk is one offset; the rest is the chunk's number from 1, or 0."""
    out, last_on, last_back, last_h = [], b"", b"", None
    for h, on, back, number, mark in entries:
        p = common(last_on, on, 0) if h == last_h else 0
        q = common(last_back, back, 0)
        out += (_HEAD.pack(h, p, len(on) - p, q, len(back) - q, number, mark), on[p:], back[q:])
        last_h, last_on, last_back = h, on, back
    return b"".join(out)


def front_decode(block: bytes) -> Iterator[tuple[bytes, int, bytes, int, int]]:
    """(sort string, prefix shared with the one before, reversed bytes back, number, mark)."""
    at, on, back, last_h = 0, b"", b"", None
    while at < len(block):
        h, p, n, q, m, number, mark = _HEAD.unpack_from(block, at)
        at += _HEAD.size
        on, back = on[:p] + block[at : at + n], back[:q] + block[at + n : at + n + m]
        at += n + m
        shared = 0 if last_h is None else 8 + p if h == last_h else (64 - (h ^ last_h).bit_length()) // 8
        last_h = h
        yield struct.pack(">Q", h) + on, shared, back, number, mark


class LoserTree:
    """Merges sorted runs of (string, prefix shared with the run's last string, ...). Every waiting
    string knows its common prefix with the last output, and no byte of it is compared again."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.now: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [0] * self.size

    def play(self, i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's prefix becomes the one shared with the winner."""
        if self.now[j] is None:
            return i, j
        if self.now[i] is None:
            return j, i
        p, q = self.shared[i], self.shared[j]
        if p != q:
            return (i, j) if p > q else (j, i)
        a, b = self.now[i][0], self.now[j][0]
        n = common(a, b, p)
        if a[n : n + 1] <= b[n : n + 1]:
            self.shared[j] = n
            return i, j
        self.shared[i] = n
        return j, i

    def build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, self.losers[node] = self.play(self.build(2 * node), self.build(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, int, tuple]]:
        """(run, prefix shared with the string before, entry) in order."""
        win = self.build(1)
        while (entry := self.now[win]) is not None:
            yield win, self.shared[win], entry
            self.now[win] = next(self.runs[win], None)
            self.shared[win] = self.now[win][1] if self.now[win] else 0
            node = (win + self.size) // 2
            while node:
                win, self.losers[node] = self.play(win, self.losers[node])
                node //= 2


def recurring_offsets(group: np.ndarray, shared: np.ndarray, backs: list[bytes], known: np.ndarray, lengths: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest recurring offset of each entry of whole groups in suffix order (least > largest:
    none). shared: bytes in common with the entry before; lengths: bytes onwards; known: bytes back that the whole
    group has in common, besides ``backs``."""
    n = len(backs)
    low, high = length - lengths, np.array([len(b) for b in backs]) + known
    groups = group.tolist()
    order = sorted(range(n), key=lambda k: (groups[k], backs[k]))
    back_shared = np.zeros(n, np.int64)
    for k in range(1, n):
        if groups[order[k - 1]] == groups[order[k]]:
            back_shared[k] = common(backs[order[k - 1]], backs[order[k]], 0) + known[order[k]]
    order = np.array(order)
    least, most = np.where(many, low, length), np.where(many, high, -1)
    left = np.empty(n, np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        on = np.cumsum(shared < length - o)
        left[order] = np.cumsum(back_shared < o)
        at = np.flatnonzero((low <= o) & (o <= high))
        if len(at) < 2:
            continue
        cls = on[at] * (n + 1) + left[at]
        ranked = np.argsort(cls, kind="stable")
        same = cls[ranked][1:] == cls[ranked][:-1]
        hit = at[ranked[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        least[hit] = np.minimum(least[hit], o)
        most[hit] = np.maximum(most[hit], o)
    return least, most


_RUNS = pa.schema([("part", pa.int32()), ("run", pa.string()), ("block", pa.binary()), ("number", pa.int32()), ("f", pa.int64()), ("r", pa.int64()), ("a", pa.list_(pa.int64()))])
_RUNS_SQL = "part int, run string, block binary, number int, f long, r long, a array<long>"


def group_of(h: int) -> int:
    """A gram's 64-bit number, spread evenly: anchors' hashes are the least of many, so they aren't."""
    h &= (1 << 64) - 1
    return (h * 0xD6E8FEB86659FD93 ^ h >> 31) & (1 << 64) - 1


def contexts(data: bytes, x: dict, length: int) -> Iterator[tuple[tuple[int, bytes, bytes, int], int]]:
    """((group, bytes on, reversed bytes back, mark), anchor) of an anchor's windows: one context, or one for each chunk
    of ``size`` offsets if its gram is hot."""
    import xxhash

    a, least, most, size = x["a"], x["least"], x["most"], x["size"]
    if not size:
        yield (group_of(x["h"]), data[a : a - least + length], data[a - most : a][::-1], 0), a
        return
    for k in range(least // size, most // size + 1):
        low, high = max(least, k * size), min(most, k * size + size - 1)
        start, end = a - k * size, a + length - (k * size + size - 1)
        core = xxhash.xxh3_128_digest(data[start:end], k)
        yield (int.from_bytes(core[:8], "big"), core[8:] + data[end : a - low + length], data[a - high : start][::-1], (k + 1) << 2 | (size == 1) << 1), a


def _sorted_runs(length: int, parts: int):
    """Rows of two kinds: a run's blocks (part, run, block), and members (run, number, f, r, a)."""

    def batch(n: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _RUNS], schema=_RUNS)

    def flush(entries: dict) -> Iterator[pa.RecordBatch]:
        run, owned = uuid.uuid4().hex, {"number": [], "f": [], "r": [], "a": []}
        part, own, held = None, [], 0

        def members() -> pa.RecordBatch:
            out = batch(len(owned["f"]), run=[run] * len(owned["f"]), **owned)
            for column in owned.values():
                column.clear()
            return out

        for number, key in enumerate(sorted(entries)):
            owners = entries.pop(key)
            last = None
            for f, r, a in zip(owners[::3], owners[1::3], owners[2::3], strict=True):
                if (f, r) != last:  # a document's places of one context make one row
                    last = f, r
                    for column, x in zip(owned.values(), (number, f, r, []), strict=True):
                        column.append(x)
                owned["a"][-1].append(a)
            held += len(owners)
            if held >= 60_000:
                yield members()
                held = 0
            if key[0] * parts >> 64 != part:
                if own:
                    yield batch(1, part=[part], run=[run], block=[front_code(own)])
                part, own = key[0] * parts >> 64, []
            own.append((*key[:3], number, key[3] | (len(owners) > 3)))
        if own:
            yield batch(1, part=[part], run=[run], block=[front_code(own)])
        if owned["f"]:
            yield members()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[tuple[int, bytes, bytes, int], list] = {}
        held = 0
        for batch in batches:
            for f, r, text, found in zip(*(batch.column(k) for k in range(4)), strict=True):
                data, f, r = text.as_py(), f.as_py(), r.as_py()
                for key, a in (c for x in found.as_py() for c in contexts(data, x, length)):
                    if key in entries:
                        entries[key] += (f, r, a)
                        held += 60
                    else:
                        entries[key] = [f, r, a]
                        held += 500 + len(key[1]) + len(key[2])
                if held > RUN_BYTES:
                    yield from flush(entries)
                    held = 0
        if entries:
            yield from flush(entries)

    return run


def _merge(length: int):
    """(run, number, least, most) of the entries with recurring windows, from rows sorted by part."""

    def merged(runs: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        names = sorted(runs)
        tree = LoserTree([front_decode(b"".join(runs[n])) for n in names])
        rows: list[tuple] = []
        for win, shared, (text, _, back, number, mark) in tree:
            new = shared < (16 if mark > 1 else 8)  # a chunk's number is 16 bytes long
            if new and len(rows) >= RESOLVE:
                yield from resolve(rows, names)
                rows = []
            rows.append((win, new, shared, len(text), back, number, mark))
        if rows:
            yield from resolve(rows, names)

    def resolve(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
        win, new, shared, lengths, backs, number, mark = zip(*rows, strict=True)
        new, shared, lengths, mark = np.array(new), np.array(shared), np.array(lengths), np.array(mark)
        chunk, size = mark >> 2, np.where(mark & 2, 1, CHUNK)
        known = np.where(chunk > 0, (chunk - 1) * size, 0)  # bytes back and on that a chunk's number stands for
        onwards = np.where(chunk > 0, length - known - size + 1 - 16, -8)
        least, most = recurring_offsets(np.cumsum(new), np.where(new, 0, shared + onwards), list(backs), known, lengths + onwards, (mark & 1) > 0, length)
        at = np.flatnonzero(least <= most)
        if len(at):
            yield pa.RecordBatch.from_arrays([
                pa.array([names[win[k]] for k in at]), pa.array(np.array(number, np.int32)[at]), pa.array(least[at].astype(np.int32)), pa.array(most[at].astype(np.int32))
            ], names=["run", "number", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, {}
        for batch in batches:
            for p, name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part:
                    if runs:
                        yield from merged(runs)
                    part, runs = p, {}
                runs.setdefault(name, []).append(block.as_py())
        if runs:
            yield from merged(runs)

    return run


def repeated_spans(docs: DataFrame, text: Column, length: int = LENGTH) -> DataFrame:
    """(rid, spans: array<struct<start, end>>) of the documents (__rid) that hold recurring windows."""
    rows = docs.select(F.col("__rid.f").alias("f"), F.col("__rid.r").alias("r"), F.coalesce(text.cast("binary"), F.lit("").cast("binary")).alias("text"))
    found = staged(rows.where(F.octet_length("text") >= length).mapInArrow(_find_anchors(length), "f long, r long, a long, least int, most int, h long"), "anchors")
    again = flag_members(found, found.select("h"), found.count(), 2).where("again")
    again = staged(again, "repeated-grams")
    size = F.when(F.col("n") > HOTTEST_GRAM, 1).otherwise(CHUNK).alias("size")
    hot = staged(again.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_GRAM).select("h", size), "hot-grams")
    contexts = again.count()
    if hot.isEmpty():
        marked = again.withColumn("size", F.lit(0))
    elif hot.count() <= 1 << 20:
        marked = again.join(F.broadcast(hot), "h", "left")
    else:
        marked = join_groups(again, hot, ["h"], "left")
    marked = staged(marked.groupBy("f", "r").agg(F.collect_list(F.struct("a", "least", "most", "h", F.coalesce("size", F.lit(0)).alias("size"))).alias("found")), "repeated-anchors")
    discard(again)
    discard(found)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-contexts * 2 * length // MERGE_BYTES))
    runs = staged(rows.join(marked, ["f", "r"]).select("f", "r", "text", "found").mapInArrow(_sorted_runs(length, parts), _RUNS_SQL), "suffix-runs")
    discard(marked)
    blocks = runs.where("block is not null").select("part", "run", "block").repartition(parts, "part").sortWithinPartitions("part", "run")
    offsets = staged(blocks.mapInArrow(_merge(length), "run string, number int, least int, most int"), "offsets")
    members = runs.where("block is null").select("run", "number", "f", "r", "a")
    span = lambda a: F.struct((a - F.col("most")).alias("start"), (a - F.col("least") + length).alias("end"))
    covered = members.join(offsets, ["run", "number"]).select("f", "r", F.transform("a", span).alias("spans"))
    return covered.groupBy("f", "r").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(0), batch.column(1), strict=True):
            data, merged = text.as_py(), []
            for s in spans.as_py() or ():
                if merged and s["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["end"])
                else:
                    merged.append([s["start"], s["end"]])
            kept, at = [], 0
            for start, end in merged:
                kept.append(data[at:start])
                at = end
            kept = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
        yield batch, out


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_bytes: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``keep_bytes``, the remaining bytes. Texts are UTF-8 bytes, null is empty; strings never cross
    documents. Repeated rows are documents of their own, so both lose what they share. Very long texts are
    taken whole, anchors being found SEGMENT windows at a time. Other columns,
    whatever their names, are not read. An empty table gives no rows."""
    text_batches(df.sparkSession)
    docs = with_row_id(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    spans = repeated_spans(docs, F.col("text"), length)
    rows = docs.select("id", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"), F.col("__rid.f").alias("f"), F.col("__rid.r").alias("r"))
    fields = [("id", None), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *[("kept", pa.binary())] * keep_bytes]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _cut(b.select([1, 2, 0]) for b in batches):
            columns = [batch.column(2)]
            for k, (_, kind) in enumerate(fields[1:]):
                columns.append(pa.array([row[k] for row in out], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    kind = f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return rows.join(spans, ["f", "r"], "left").select("id", "text", "spans").mapInArrow(cut, kind).withColumnRenamed("id", id_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over every whole text of ``documents``, with strings of 400 bytes."""
    return suffix_dedup(table(spark, sf_dir, "documents"), keep_bytes=False)
