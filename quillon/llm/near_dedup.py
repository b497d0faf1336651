"""SimHash near-deduplication: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Every text becomes the set of its hashed shingles and a SimHash of it, WIDE words wide: at a similarity
of 0.8 about 15% of the bits differ, of unrelated texts half. Equal sets are put together first. The
distinct ones are routed by values of sampled bits, by so many samples that a pair at the bound is missed
by all of them with a probability of ``MISS``; samples grow wider, and more, with the number of texts, so
a value's group stays small. A group is searched by the Gray-order hierarchical index, which prunes whole
groups of nodes by the differences accumulated over their shared masks, and every pair that it finds is
verified exactly on the two sets before it links anything.

A large cluster isn't paired off. The first pass takes a few partners of a text, the ``NEAREST`` ones and the
one with the least hash, verifies them and follows the links to components: a graph of several nearest
neighbours holds a cluster together, one of a single neighbour falls apart. The second pass only looks at
texts of different components. Its searches don't list the pairs, they tell which texts hang together by
candidates; such a cluster's sets then meet in one task, which goes over the candidates again, verifies
them on the sets, skips those that links have joined meanwhile and returns the links that join two
components. A value that more than ``HOT`` texts share is cut into blocks at random in the first pass (each
sample cuts another way); in the second, the blocks of all texts outside its commonest component meet every
other block, a pair of blocks at a time, and clusters are cut in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, join_groups, staged, text_batches, with_row_id
from quillon.llm.components import components
from quillon.llm.simhash import GrayIndex, lowest, words_of

SHINGLE = 5
SHARE = 0.8
#: 64-bit words of a fingerprint.
WIDE = 4
#: Odds that no sample routes a pair at the bound together.
MISS = 0.002
#: Standard deviations of the differing bits that the bound allows for.
SLACK = 4.0
#: Partners of a text that the first pass verifies, besides the one with the least hash.
NEAREST = 4
#: Texts of one value that are searched as one group.
HOT = 2048
#: Shingles that weigh as much as a text when a cluster is cut into blocks.
WEIGHT = 512
#: Words whose hashes a worker remembers.
CACHE = 1 << 19
_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    """XXH64 of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_HASHES = _WordHashes()


def _mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ by) * _SPREAD[0]
    h = (h ^ (h >> np.uint64(29))) * _SPREAD[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's word shingles; fewer words are one shingle, no words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    of = _HASHES
    w = np.array([of[x] for x in words], np.uint64)
    if len(w) < shingle:
        w = np.concatenate((w, np.full(shingle - len(w), len(w), np.uint64)))
    n = len(w) - shingle + 1
    h = np.zeros(n, np.uint64)
    for k in range(shingle):
        h = _mixed(h ^ w[k : k + n], _SPREAD[2])
    return np.unique(h)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes: a bit is 1 if it is set in over half of them."""
    totals, n = np.zeros(64 * WIDE, np.int64), len(shingles)
    for lo in range(0, n, 255 * 16):
        h = shingles[lo : lo + 255 * 16]
        spread = np.stack([_mixed(h, by) for by in _SPREAD], axis=1)
        ones = np.unpackbits(spread.view(np.uint8), axis=1, bitorder="little").view(np.uint64)  # eight counters a word
        sums = np.add.reduceat(ones, np.arange(0, len(h), 255), axis=0)
        totals += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(totals * 2 > n, bitorder="little").view(np.uint64)


def sampling(texts: int, share: float, miss: float = MISS) -> tuple[int, int, int]:
    """(differing bits allowed, bits of a sample, samples) for so many texts. Sets at a similarity of s have a cosine of
    2s / (1 + s) at least, which is the angle between them and so the odds that a bit differs."""
    odds = math.acos(2 * share / (1 + share)) / math.pi
    n = 64 * WIDE
    width = max(8, math.ceil(math.log2(max(2, texts))) - 6)
    samples = math.ceil(math.log(miss) / math.log1p(-((1 - odds) ** width))) if odds else 1
    return min(n, math.ceil(n * odds + SLACK * math.sqrt(n * odds * (1 - odds)))), width, samples


def _masks(width: int, samples: int) -> list[list[int]]:
    """The sampled bits, as a mask of WIDE signed words for each sample."""
    rng, out = np.random.default_rng(64), []
    for _ in range(samples):
        bits = np.zeros(64 * WIDE, np.uint8)
        bits[rng.choice(64 * WIDE, width, replace=False)] = 1
        out.append(np.packbits(bits, bitorder="little").view(np.int64).tolist())
    return out


def _sketches(text: Column, shingle: int) -> Column:
    """The set's own hash, its size and its fingerprint."""

    @F.pandas_udf("h long, n int, fp array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for texts in batches:
            h, n, fp = [], [], []
            for t in texts:
                s = shingle_set(t, shingle)
                h.append(xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0)
                n.append(len(s))
                fp.append(fingerprint(s).view(np.int64))
            yield pd.DataFrame({"h": np.array(h, np.uint64).view(np.int64), "n": n, "fp": fp})
        _HASHES.clear()  # the worker goes on to other tasks

    return run(text)


def _sets(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts], dtype=object)
        _HASHES.clear()

    return run(text)


def _shared(a: Column, b: Column) -> Column:
    """The number of values that two sets have in common."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int32")

    return run(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of sets (h, shingles) whose Jaccard similarity is at least ``share``."""
    mine, theirs = sets.select(F.col("h").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("h").alias("b"), F.col("shingles").alias("y"))
    both = join_groups(join_groups(pairs, mine, ["a"]), theirs, ["b"])
    both = both.select("a", "b", F.size("x").alias("na"), F.size("y").alias("nb"), _shared(F.col("x"), F.col("y")).alias("n"))
    return both.where(F.col("n") >= F.lit(share) * (F.col("na") + F.col("nb") - F.col("n")) - 1e-9).select("a", "b")


def _by_key(found, rows: int, columns: int):
    """Runs ``found`` on whole groups of rows sorted by the first column, about so many rows at a time. The fifth column
    holds fingerprints, a sixth lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def arrays() -> tuple:
            t = pa.Table.from_batches(held).combine_chunks()
            flat = [t.column(k).to_numpy() for k in range(4)]
            fp = t.column(4).combine_chunks().flatten().to_numpy().reshape(-1, WIDE).view(np.uint64)
            return (*flat, fp, *(t.column(k).combine_chunks() for k in range(5, columns)))

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < rows:
                continue
            key = np.concatenate([b.column(0).to_numpy() for b in held])
            cut = int(np.flatnonzero(key == key[-1])[0])
            if not cut:
                continue
            table = pa.Table.from_batches(held)
            held = table.slice(0, cut).to_batches()
            yield from found(*arrays())
            held = table.slice(cut).to_batches()
            size -= cut
        if held:
            yield from found(*arrays())

    return run


def _allowed(i: np.ndarray, j: np.ndarray, n: np.ndarray, root: np.ndarray, share: float) -> np.ndarray:
    """Whether pairs are of different roots and of sizes that allow the share."""
    return (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]) - 1e-9)


def _search(bits: int, share: float, every: bool):
    """Candidate pairs (a, b, far) of rows (key, h, n, root, fp) sorted by key: of different roots, with sizes that allow the
    share, within ``bits``. Only the nearest and the least partner of each text of a group; with ``every``, one row for a
    text with candidates, (a, b) with the first of those that hang together by them."""

    def found(key: np.ndarray, h: np.ndarray, n: np.ndarray, root: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(key, fp)
        h, n, root = h[index.order], n[index.order], root[index.order]
        nearest, least = np.full(len(h), -1), np.full(len(h), -1)
        least_far = np.zeros(len(h), np.int64)
        nearest_far = np.full(len(h), 1 << 30)
        label = places = np.arange(len(h))
        for i, j, far in index.near(bits):
            ok = _allowed(i, j, n, root, share)
            i, j, far = i[ok], j[ok], far[ok]
            if every:
                if len(i):
                    label = lowest(len(h), np.concatenate((places, i)), np.concatenate((label, j)))
                continue
            for x, y in ((i, j), (j, i)):
                order = np.lexsort((h[y], far))[::-1]  # the last of several assignments stays: the best
                a, b, d = x[order], y[order], far[order]
                better = (d < nearest_far[a]) | (d == nearest_far[a]) & (h[b] < h[nearest[a]])
                nearest[a[better]], nearest_far[a[better]] = b[better], d[better]
                order = np.argsort(h[y])[::-1]
                a, b, d = x[order], y[order], far[order]
                better = (least[a] < 0) | (h[b] < h[least[a]])
                least[a[better]], least_far[a[better]] = b[better], d[better]
        if every:
            at = np.flatnonzero(label != places)
            if len(at):
                yield _pairs(h[at], h[label[at]], np.zeros(len(at)))
            return
        at = np.flatnonzero(nearest >= 0)
        if len(at):
            yield _pairs(np.concatenate((h[at], h[at])), np.concatenate((h[nearest[at]], h[least[at]])), np.concatenate((nearest_far[at], least_far[at])))

    return _by_key(found, 20_000, 5)


def _joining(bits: int, share: float):
    """Links (a, b, far) of rows (key, h, n, root, fp, shingles) sorted by key that join texts of different roots: of the
    pairs within ``bits`` all that no link found before has joined are verified on their sets."""

    def found(key: np.ndarray, h: np.ndarray, n: np.ndarray, root: np.ndarray, fp: np.ndarray, shingles: pa.ListArray) -> Iterator[pa.RecordBatch]:
        index = GrayIndex(key, fp)
        h, n, shingles = h[index.order], n[index.order], shingles.take(pa.array(index.order))
        _, label = np.unique(root[index.order], return_inverse=True)
        values, ids = np.unique(shingles.flatten().to_numpy(), return_inverse=True)
        ends = np.cumsum(n)
        starts, mark = ends - n, np.zeros(len(values), np.int32)

        def shared(i: int, js: np.ndarray) -> np.ndarray:
            """The number of values that a set has in common with each of several."""
            mark[ids[starts[i] : ends[i]]] = 1
            lo, hi = js.min(), js.max() + 1
            if ends[hi - 1] - starts[lo] <= 4 * n[js].sum():
                out = np.add.reduceat(mark[ids[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo])[js - lo]
            else:
                out = np.array([mark[ids[starts[j] : ends[j]]].sum() for j in js])
            mark[ids[starts[i] : ends[i]]] = 0
            return out

        a, b = [], []
        for i, j, _ in index.near(bits):
            ok = _allowed(i, j, n, label, share)
            order = np.argsort(i[ok], kind="stable")
            i, j = i[ok][order], j[ok][order]
            for x, js in zip(*_runs(i, j), strict=True):
                js = js[label[js] != label[x]]
                if not len(js):
                    continue
                m = shared(x, js)
                for y in js[m >= share * (n[x] + n[js] - m) - 1e-9]:
                    if label[x] != label[y]:
                        a.append(h[x])
                        b.append(h[y])
                        label[label == label[y]] = label[x]
        if a:
            yield _pairs(np.array(a), np.array(b), np.zeros(len(a)))

    return _by_key(found, HOT, 6)


def _runs(i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct values of a sorted ``i``, and the values of ``j`` at each."""
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, np.int64)
    return i[first].tolist(), np.split(j, first[1:]) if len(i) else []


def _pairs(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(far.astype(np.int32))], names=["a", "b", "far"])


def _candidates(routed: DataFrame, bits: int, share: float, every: bool) -> DataFrame:
    rows = routed.select("key", "h", "n", "root", "fp").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_search(bits, share, every), "a long, b long, far int")


def _blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(HOT)).cast("long")


def _with_keys(rows: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """Joins with a staged table of keys: it is broadcast unless it is large."""
    return rows.join(F.broadcast(keys), "key", how) if keys.count() <= 1 << 20 else join_groups(rows, keys, ["key"], how)


def near_links(reps: DataFrame, texts: int, sets_of, share: float = SHARE) -> DataFrame:
    """(node, root) for the sets (h, n, fp) that are linked with others. sets_of(hashes) returns
    (h, shingles) for a table of them; ``texts`` is about how many sets there are."""
    bits, width, samples = sampling(texts, share)
    masks = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(w).cast("long").alias(f"w{j}") for j, w in enumerate(m))) for k, m in enumerate(_masks(width, samples))))
    hashed = F.transform(masks, lambda m: F.xxhash64(m["k"], *(F.col("fp")[j].bitwiseAND(m[f"w{j}"]) for j in range(WIDE))))
    keyed = reps.where("n > 0").select("h", "n", "fp", F.explode(hashed).alias("key"))
    hot = staged(keyed.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT), "near-hot")
    is_hot = not hot.isEmpty()
    first = keyed
    if is_hot:
        block = F.when(F.col("m").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("h", "key"), _blocks(F.col("m")))))
        first = _with_keys(keyed, hot, "left").withColumn("key", block)
    near = staged(_candidates(first.withColumn("root", F.col("h")), bits, share, False), "near-first")
    # of each text's partners, at most two of every sample, the nearest and the least
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "b"))), 1, NEAREST).alias("nearest"), F.min("b").alias("least"))
    pairs = best.select("a", F.explode(F.array_union("nearest.b", F.array("least"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = staged(pairs, "near-pairs")
    some = near.select(F.col("a").alias("h")).distinct()
    if is_hot:
        some = some.union(_with_keys(keyed, hot).select("h")).distinct()
    some = staged(some, "near-some")
    discard(near)
    sets = staged(sets_of(some), "near-sets")
    edges = staged(_verified(pairs, sets, share), "near-links")
    discard(pairs)
    roots = components(edges)
    rooted = join_groups(reps.where("n > 0").select("h", "n", "fp"), some, ["h"])
    rooted = join_groups(rooted, roots.withColumnRenamed("node", "h"), ["h"], "left").withColumn("root", F.coalesce("root", "h"))
    rooted = staged(rooted, "near-rooted")
    discard(some)
    rows = rooted.select("h", "n", "fp", "root", F.explode(hashed).alias("key"))  # the texts are joined before they are routed
    if is_hot:
        rows = _block_pairs(rows, hot)
    stars = staged(_candidates(rows, bits, share, True).select("a", "b").distinct(), "near-stars")
    if not stars.isEmpty():
        clusters = components(stars)
        members = clusters.select(F.col("node").alias("h"), F.col("root").alias("key")).union(clusters.select("root", F.col("root").alias("key")).distinct())
        rows = staged(join_groups(rooted, members, ["h"]).select("key", "h", "n", "fp", "root"), "near-clusters")
        weight = 1 + F.col("n") / F.lit(WEIGHT)
        large = staged(rows.groupBy("key").agg(F.sum(weight).alias("m")).where(F.col("m") > HOT), "near-hot")
        met = rows if large.isEmpty() else _block_pairs(rows, large, weight)
        met = join_groups(met, sets, ["h"]).select("key", "h", "n", "root", "fp", "shingles").repartition("key").sortWithinPartitions("key")
        more = staged(met.mapInArrow(_joining(bits, share), "a long, b long, far int").select("a", "b"), "near-links")
        if not more.isEmpty():
            before, roots = roots, components(edges.union(more))
            discard(before)
        for done in (clusters, rows, large, more):
            discard(done)
    for done in (hot, sets, edges, rooted, stars):
        discard(done)
    return roots


def _block_pairs(rows: DataFrame, hot: DataFrame, weight: Column | None = None) -> DataFrame:
    """Of rows (key, h, n, fp, root) those of hot keys under one key for each pair of blocks that meet; a block weighs
    about HOT texts, either all of the key's commonest root or none of it. Blocks of that root don't meet each other."""
    large = _with_keys(rows, hot.select("key"))
    roots = large.groupBy("key", "root").agg(F.sum(F.lit(1) if weight is None else weight).alias("m"))
    most = roots.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("m"), F.count("*").alias("roots"))
    open_blocks = F.when(F.col("roots") == 1, 0).otherwise(F.greatest(_blocks(F.col("m") - F.col("most.m")), F.lit(1))).cast("long")
    most = staged(most.select("key", F.col("most.root").alias("common"), _blocks(F.col("most.m")).alias("bulk"), open_blocks.alias("open")), "near-blocks")
    placed = _with_keys(large, most.where("open > 0"))
    apart = F.col("root") != F.col("common")
    spread = F.xxhash64("h", "key")
    own = F.when(apart, F.col("bulk") + F.pmod(spread, F.greatest("open", F.lit(1)))).otherwise(F.pmod(spread, F.col("bulk")))
    others = F.sequence(F.when(apart, F.lit(0).cast("long")).otherwise(F.col("bulk")), F.col("bulk") + F.col("open") - 1)
    met = placed.withColumn("own", own).withColumn("other", F.explode(others))
    met = met.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return _with_keys(rows, hot.select("key"), "left_anti").select("key", "h", "n", "fp", "root").unionByName(met.select("key", "h", "n", "fp", "root"))


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """The rows of ``df`` that stay: of each group of documents linked by a shingle similarity of at least
    ``share`` the one with the smallest id (null ids last; of repeated rows one). Texts under ``shingle``
    words are one shingle; null and empty texts are alike. All columns, whatever their names, come back
    unchanged; an empty table stays empty. Very long texts are read whole, 4080 shingles at a time."""
    text_batches(df.sparkSession, rows=256)
    docs = with_row_id(df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rid")
    whole = staged(docs.select("id", "rid", _sketches(F.col("text"), shingle).alias("s")).select("id", "rid", "s.*"), "near")
    firsts = whole.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "rid", "n", "fp")).alias("first"))
    firsts = staged(firsts, "near-firsts")
    discard(whole)
    reps = firsts.select("h", "first.n", "first.fp")

    def sets_of(hashes: DataFrame) -> DataFrame:
        rids = hashes.join(firsts, "h").select("h", F.col("first.rid.f").alias("f"), F.col("first.rid.r").alias("r"))
        return docs.select(F.col("rid.f").alias("f"), F.col("rid.r").alias("r"), "text").join(rids, ["f", "r"]).select("h", _sets(F.col("text"), shingle).alias("shingles"))

    roots = near_links(reps, reps.count(), sets_of, share)
    rooted = firsts.join(roots, firsts["h"] == roots["node"], "left").select("h", "first", F.coalesce("root", "h").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("first").alias("keep")).select(F.col("keep.rid").alias("rid"))
    kept = staged(stays, "near-kept")
    discard(firsts)
    discard(roots)
    return docs.join(kept, "rid", "left_semi").select("row.*")
