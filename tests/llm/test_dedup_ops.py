"""SimHash, line dedup, substring dedup and components: brute force and edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quillon.llm import simhash, suffix_dedup
from quillon.llm.components import components
from quillon.llm.line_dedup import line_dedup
from quillon.llm.near_dedup import simhash_dedup
from quillon.session import table


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def roots(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("n", [1, 5, 300])
def test_components(spark, n):
    rng = random.Random(n)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(i, i + 1) for i in range(n // 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(n, pairs)
    assert {x: got.get(x, x) for x in range(n)} == dict(enumerate(want))


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "one", "one two", "One Two\tthree four  five", "é É a b c\x85d", "a a a a a a"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [1, 4, 4096])
def test_links_connect_all_within_two_bits(spark, hot):
    rng = np.random.default_rng(hot)
    centre = rng.integers(0, 1 << 63, 12, np.uint64)
    fps = {0, (1 << 64) - 1}
    for c in centre.tolist():
        for _ in range(25):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    got = [(at[r.a], at[r.b]) for r in simhash.links(df, hot).collect()]
    want = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    assert roots(len(fps), got) == roots(len(fps), want)


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(7)
    fp = (rng.integers(0, 1 << 12, 900, np.uint64) << np.uint64(20)) | rng.integers(0, 4, 900, np.uint64)
    key = rng.integers(0, 5, 900)
    index = simhash.GrayIndex(key, fp)
    got = {tuple(p) for i, j in index.pairs(2, most=1 << 10) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if index.key[i] == index.key[j] and int(index.fp[i] ^ index.fp[j]).bit_count() <= 2}
    assert got == want
    rank = simhash.gray_rank(np.array([x ^ x >> 1 for x in range(64)], np.uint64))
    assert rank.tolist() == list(range(64))


def test_simhash_query(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    out = {r.doc_id: r for r in simhash.op8_simhash(spark, sf).collect()}
    ids = sorted(out)
    fp = [int(out[i].fingerprint, 16) for i in ids]
    want = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert [out[i].component_id for i in ids] == [ids[w] for w in want]
    assert all(int(out[r.doc_id].fingerprint, 16) == brute_fingerprint(r.text) for r in rows[:60])


def test_simhash_dedup_edges(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (8, None), (7, ""), (9, "another text of its own here")]
    df = docs(spark, rows).withColumnsRenamed({"lang": "fp", "source": "rid"})
    out = simhash_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 7, 9]
    assert simhash_dedup(df.limit(0)).count() == 0


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return max(len(a), len(b)) - p - s <= 1


def brute_lines(rows, least=20):
    seen, out = [], []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] if rows[k][0] is not None else 0, k))
    kept = {}
    for k in order:
        lines = []
        for line in (rows[k][1] or "").split("\n"):
            if line:
                gone = line in seen or len(line) >= least and any(len(x) >= least and within_one(line, x) for x in seen)
                seen.append(line)
                if gone:
                    continue
            lines.append(line)
        kept[k] = "\n".join(lines)
    for k in range(len(rows)):
        out.append((rows[k][0], kept[k]))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.choice([20, 21, 40, 64, 65, 66, 67, 90]))) for _ in range(25)]

    def edited(line):
        i = rng.randrange(len(line))
        return rng.choice([line, line, line[:i] + line[i + 1 :], line[:i] + "x" + line[i:], line[:i] + "y" + line[i + 1 :], line[:i] + "yx" + line[i + 1 :]])

    rows = [(i, "\n".join(rng.choice([edited(rng.choice(base)), "short", "shirt", "", "x" * 19, "x" * 20]) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    out = {r.doc_id: r.text for r in line_dedup(docs(spark, rows)).collect()}
    assert out == dict(brute_lines(rows))


def test_line_dedup_edges(spark):
    line = "a line that is long enough to count"
    rows = [(1, None), (2, ""), (4, line), (3, line + "\nok"), (3, line), (None, line), (9, "x" * 60_000), (10, "x" * 60_000)]
    df = docs(spark, rows).withColumnsRenamed({"lang": "n_lines", "source": "h"})
    out = line_dedup(df).collect()
    assert len(out) == len(rows) and sum(line in (r.text or "") for r in out) == 1
    assert {r.doc_id: r.text for r in out if r.doc_id in (1, 2, 4, 9)} == {1: None, 2: "", 4: "", 9: "x" * 60_000}
    assert sum(r.n_removed for r in out) == 4
    assert line_dedup(df.limit(0)).count() == 0


def test_line_hashes_are_independent(spark):
    """The second hash isn't a function of the first: its seed is a constant's hash."""
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit(1), F.lit("a line")).alias("h2"), F.xxhash64(F.lit("a line")).alias("h")).first()
    seed = spark.range(1).select(F.xxhash64(F.lit(1)).alias("s")).first().s
    assert got.h2 == np.int64(np.uint64(xxhash.xxh64_intdigest("a line", seed & (1 << 64) - 1)).view(np.int64)) and got.h != got.h2


def test_variants_of_a_long_line_come_in_pieces():
    import pyarrow as pa

    from quillon.llm.line_dedup import VARIANTS, _variants, deletion_keys

    line = "".join(random.Random(6).choice("abcdef") for _ in range(200_000))
    batch = pa.RecordBatch.from_pydict({"h": pa.array([1], pa.int64()), "h2": pa.array([2], pa.int64()), "line": [line]})
    out = list(_variants(iter([batch])))
    assert max(b.num_rows for b in out) <= 2 * VARIANTS
    placed, gone, whole = deletion_keys(line)
    for role, want in ((0, placed), (1, gone), (2, [whole])):
        got = [k for b in out for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if r == role]
        assert np.array(got, np.int64).tolist() == np.array(want, np.uint64).view(np.int64).tolist()


def brute_spans(texts, length):
    starts = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for p in range(len(d) - length + 1):
            starts[hash(d[p : p + length])] += 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if starts[hash(d[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "hottest", "segment", "resolve"), [(1, 1, 1 << 22, 16_384), (1, 6, 97, 1), (1, 1 << 18, 1 << 22, 16_384), (2048, 1 << 18, 50, 16_384)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot, hottest, segment, resolve):
    """Hot grams by single offsets, by chunks of them and by both, none hot; texts over several segments; many groups."""
    for name, value in (("HOT_GRAM", hot), ("HOTTEST_GRAM", hottest), ("SEGMENT", segment), ("RESOLVE", resolve), ("CHUNK", 16 if resolve == 1 else 64)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [text(n) for n in (100, 130, 150, 400, 800)]
    rows = [None, "", "short", "z" * 900, "ab" * 400, text(70), shared[4], shared[4]]
    for _ in range(60):
        parts = [text(rng.randrange(0, 200)) if rng.random() < 0.5 else rng.choice(shared)[rng.randrange(0, 40) :] for _ in range(4)]
        rows.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, length=120).collect()}
    assert out == dict(enumerate(brute_spans(rows, 120)))


def test_suffix_dedup_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op5_suffix_dedup(spark, sf).collect()}
    assert out == dict(zip(texts, brute_spans(texts.values(), 400), strict=True))


def test_suffix_dedup_edges(spark):
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(500))
    df = docs(spark, [(1, long), (1, long), (None, long[:399]), (4, None)]).withColumnsRenamed({"lang": "f", "source": "spans"})
    out = suffix_dedup.suffix_dedup(df).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 500, 500] and all(r.kept == b"" for r in out if r.n_removed)
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


def test_loser_tree_merges_in_order():
    rng = random.Random(3)
    entries = [(rng.choice([5, 6, 1 << 40, (1 << 40) + 1, 1 << 63]), bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))), bytes(rng.choice(b"ab") for _ in range(3))) for _ in range(400)]
    runs = [sorted(entries[k::7]) for k in range(7)]
    coded = [suffix_dedup.front_code([(*e, n, False) for n, e in enumerate(run)]) for run in runs]
    merged = list(suffix_dedup.LoserTree([suffix_dedup.front_decode(c) for c in coded]))
    texts = [e[0] for _, _, e in merged]
    assert texts == sorted(h.to_bytes(8, "big") + on for h, on, _ in entries)
    for (a, b), (_, shared, _) in zip(zip(texts, texts[1:], strict=False), merged[1:], strict=True):
        assert shared == suffix_dedup.common(a, b, 0)
    assert sorted(runs[w][e[3]] for w, _, e in merged) == sorted(entries)


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(9)
    window = bytes(rng.randrange(256) for _ in range(400))
    offsets = set()
    for k in range(6):
        data = bytes(rng.randrange(256) for _ in range(97 * k)) + window + bytes(rng.randrange(256) for _ in range(50))
        a, least, most, _ = suffix_dedup.anchors(data)
        offsets |= {int(x) - 97 * k for x, lo, hi in zip(a, least, most, strict=True) if lo <= x - 97 * k <= hi}
    assert len(offsets) == 1
