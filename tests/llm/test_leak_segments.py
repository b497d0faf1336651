"""Leaks on one diagonal and of short items against brute force."""

import random

import numpy as np
import pytest

from quillon.llm import decontaminate


def pattern(same):
    """Whether an item is found in a text that equals it at the given places."""
    words = [f"w{i}" for i in range(len(same))]
    return bool(decontaminate.Block([(1, " ".join(words))]).hits(" ".join(w if x else "other" for w, x in zip(words, same, strict=True))))


def test_more_of_an_item_does_not_hide_the_leak():
    run, gap = [True] * 13, [False] * 6
    assert pattern(run + gap * 4)
    assert pattern(run + gap + run + gap + run)
    assert pattern(run + [False, True, True, True, False, True, True] * 6)


def test_inner_segment_against_brute_force():
    rng = np.random.default_rng(6)
    n = 60
    block = decontaminate.Block([(1, " ".join(f"w{i}" for i in range(n)))])
    seen = set()
    for _ in range(300):
        same = rng.random(n) < rng.choice([0.6, 0.7, 0.75, 0.8])
        ids = np.where(same, block.tokens[0], 0).astype(np.int32)
        count = np.concatenate(([0], np.cumsum(same)))
        best = max([int(count[b] - count[a]) for a in range(n) for b in range(a + 1, n + 1) if 5 * (count[b] - count[a]) >= 4 * (b - a)], default=0)
        found = block.inner(ids, 0, 0)
        assert (found["matches"] if found else 0) == (best if best >= 13 else 0)
        if found:
            assert same[found["start"] : found["start"] + found["length"]].sum() == best >= 0.8 * found["length"]
        seen.add(bool(found))
    assert seen == {True, False}


@pytest.mark.parametrize("n", range(4, 17))
def test_short_items(n):
    rng = random.Random(n)
    need = -(-4 * n // 5)
    assert pattern([True] * n)
    for _ in range(60):
        gone = set(rng.sample(range(n), n - need))
        assert pattern([i not in gone for i in range(n)])
        gone = set(rng.sample(range(n), n - need + 1))
        assert not pattern([i not in gone for i in range(n)])


def brute_hits(items, text):
    """Every item with a segment of some alignment that holds enough matches at the share."""
    words, out = decontaminate.tokens(text), set()
    for i, t in items:
        item = decontaminate.tokens(t)
        if len(item) < decontaminate.MIN_ITEM:
            if item and item == words:
                out.add(i)
            continue
        need = decontaminate.needed(len(item))
        for d in range(-len(item) + 1, len(words)):
            same = [0 <= k + d < len(words) and item[k] == words[k + d] for k in range(len(item))]
            count = np.concatenate(([0], np.cumsum(same)))
            a, b = np.triu_indices(len(item) + 1, 1)
            m = count[b] - count[a]
            if ((m >= need) & (5 * m >= 4 * (b - a))).any():
                out.add(i)
                break
    return out


def test_all_alignments_against_brute_force():
    """No hit without a leak by the rule, and at least 0.9 of the leaks found, with substitutions, moved and cut copies."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 3, 5, 9, 14, 22, 40])))) for i in range(40)]
    block = decontaminate.Block(items)
    leaks = hits = 0
    for _ in range(250):
        i, t = rng.choice(items)
        copy = t.split()
        for _ in range(rng.randrange(0, 1 + len(copy) // 5 + 1)):
            copy[rng.randrange(len(copy))] = word()
        cut = rng.randrange(0, 1 + len(copy) // 3)
        text = " ".join([word() for _ in range(rng.randrange(0, 12))] + copy[cut:] + [word() for _ in range(rng.randrange(0, 12))])
        want, got = brute_hits(items, text), {x["item_id"] for x in block.hits(text)}
        assert got <= want
        leaks, hits = leaks + len(want), hits + len(got)
    assert leaks > 100 and hits >= 0.9 * leaks


def test_repeated_words_cost_little():
    """One word 2000 times in an item and 8000 times in a text: every diagonal once."""
    import time

    block = decontaminate.Block([(1, "word " * 2000), (2, "on and on " * 300)])
    began = time.time()
    found = {x["item_id"]: x for x in block.hits("word " * 8000)}
    assert set(found) == {1} and found[1]["matches"] == found[1]["length"] == 2000
    assert {x["item_id"] for x in block.hits("and on on " * 2000)} == {2}
    assert time.time() - began < 30


@pytest.mark.parametrize("marks", [0, 1 << 28])
def test_diagonals_by_marks_and_by_sorting(monkeypatch, marks):
    monkeypatch.setattr(decontaminate, "HITS", 64)
    monkeypatch.setattr(decontaminate, "MARKS", marks)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("ab") for _ in range(30))) for i in range(5)]
    block = decontaminate.Block(items)
    text = " ".join(rng.choice("ab") for _ in range(200))
    ids = np.array([block.vocabulary[w] for w in text.split()], np.int32)
    span = len(ids) + block.longest + 1
    want = set()
    for mask, h, item, at in block.seeds:
        start, own = decontaminate.seed_hashes(ids, mask)
        want |= {int(k) * span + int(s - p) + block.longest for s, x in zip(start, own, strict=True) for k, p in zip(item[h == x], at[h == x], strict=True)}
    assert block.diagonals(ids, span).tolist() == sorted(want)


def test_blocks_one_after_the_other(spark, monkeypatch):
    """Several blocks by items or characters find what one block finds, whatever the rows."""
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20))) for i in range(7)] + [(7, "two words")]
    rows = [(k, items[k % 7][1] + " " + items[(k * 3) % 7][1], "x") for k in range(20)] + [(None, None, "x"), (5, "", "y"), (5, "Two words!", "y"), (5, "Two words!", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def result():
        return sorted(map(repr, decontaminate.find_leaks(df, bench).collect()))

    one = result()
    for name, value in (("BLOCK_ITEMS", 3), ("BLOCK_CHARS", 200)):
        with monkeypatch.context() as m:
            m.setattr(decontaminate, name, value)
            assert result() == one
