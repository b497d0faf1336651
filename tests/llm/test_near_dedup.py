"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
from test_dedup_ops import docs, roots

import corpus_pipeline
from quillon.llm import common, near_dedup


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(rows):
    """The ids that stay."""
    sets = [shingles(t) for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    label = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    smallest = {}
    for (i, _), g in zip(rows, label, strict=True):
        smallest[g] = min(smallest.get(g, i), i)
    return sorted(set(smallest.values()))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [None, "", "one two", "One two", "one two three"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 150, 700]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [2, 8, 2048])
def test_near_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rows = corpus(hot)
    assert sorted(r.doc_id for r in near_dedup.simhash_dedup(docs(spark, rows)).collect()) == brute_near(rows)


def test_fingerprint_of_a_set():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 255, 256, 4081, 9000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        spread = np.stack([near_dedup._mixed(h, by) for by in near_dedup._SPREAD])
        want = [sum(1 << b for b in range(64) if 2 * int(((w >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) for w in spread]
        assert near_dedup.fingerprint(h).tolist() == want


def test_bound_and_samples_hold_pairs_at_the_share():
    """Sets at a similarity of 0.8: within the bound, and rarely missed by all samples."""
    rng = np.random.default_rng(5)
    bits, width, samples = near_dedup.sampling(10_000, 0.8)
    masks = np.array(near_dedup._masks(width, samples)).view(np.uint64)
    missed = 0
    for _ in range(200):
        h = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = near_dedup.fingerprint(h[:180]), near_dedup.fingerprint(h[20:])
        differ = a ^ b
        missed += int(np.bitwise_count(differ).sum()) > bits or not (((differ & masks) == 0).all(axis=1)).any()
    assert missed <= 4


def test_pipeline_drops_copies_at_a_similarity_of_08(spark, sf):
    """Of 96 shingles two changed words leave 86 of 106 (0.81), four 76 of 116."""
    words = [f"w{i}" for i in range(100)]
    copy, far = list(words), list(words)
    for i in (20, 70):
        copy[i] = "other"
    for i in (20, 40, 60, 80):
        far[i] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(far))]
    out = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), sf)
    assert sorted(r.doc_id for r in out.collect()) == brute_near(rows) == [1, 3]


def test_near_dedup_edges(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (8, None), (7, ""), (9, "another text of its own here")]
    df = docs(spark, rows).withColumnsRenamed({"lang": "h", "source": "rid"})
    out = near_dedup.simhash_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 7, 9]
    assert near_dedup.simhash_dedup(df.limit(0)).count() == 0


def near_copies(n, seed=11):
    """A group of near copies whose similarities spread about the bound, and the ids that brute force keeps."""
    rng = random.Random(seed)
    base, rows = [f"w{k}" for k in range(160)], []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randrange(1, 12)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("hot", [64, 2048])
def test_second_pass_lists_no_pairs(spark, monkeypatch, hot):
    """A group of near copies that don't link makes rows in proportion to its texts, in no table more, and keeps the result."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    rows, made, real = near_copies(300), {}, near_dedup.staged

    def staged(df, tag, by=None):
        made[tag] = max(made.get(tag, 0), (out := real(df, tag, by)).count())
        return out

    monkeypatch.setattr(near_dedup, "staged", staged)
    got = sorted(r.doc_id for r in near_dedup.simhash_dedup(docs(spark, rows)).collect())
    assert got == brute_near(rows) and 1 < len(got) < 300
    assert made["near-pairs"] <= (near_dedup.NEAREST + 1) * len(rows)
    assert made["near-links"] < made["near-pairs"] and made["near-stars"] <= near_dedup.sampling(300, 0.8)[2] * len(rows)


def test_near_dedup_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    source = f"{tmp_path}/docs.parquet"
    docs(spark, near_copies(60)).write.parquet(source)
    out = near_dedup.simhash_dedup(spark.read.parquet(source))
    assert sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "quillon").iterdir()) == ["near-kept"]
    assert 1 < out.count() < 60
