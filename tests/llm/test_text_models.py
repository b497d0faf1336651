"""Language identification, toxicity and byte-pair encoding."""

import collections
import hashlib
import itertools
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import language_id, toxicity
from quillon.llm.bpe import Bpe, default_tokenizer, encode_decode, op9_bpe
from quillon.session import table


def test_language_held_out(spark, sf):
    out = language_id.op6_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == table(spark, sf, "documents").count() and held
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "bonjour le monde"), (4, "bonjour le monde"), (None, "hello the world"), (6, "the world " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS language", "1 AS score")
    model = language_id.train(spark.createDataFrame([("bonjour le monde entier", "fr"), ("hello the whole world", "en"), (None, "en"), ("ignored", None)], "text string, lang string"), "text", "lang")
    out = language_id.predict(df, model).collect()
    assert [r.language.lang for r in out] == ["und", "und", "und", "fr", "fr", "en", "en"]
    assert all(r.language.score == 0 for r in out[:3])
    nothing = language_id.train(df.limit(0), "text", "text")
    assert nothing is None and {r.language.lang for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.train(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "text string, lang string"), "text", "lang")


def test_language_score_is_the_posterior():
    model = (["a", "b"], np.log(np.full((1 << language_id.BUCKET_BITS, 2), [0.25, 0.75])), np.log([0.5, 0.5]))
    grams = language_id.gram_buckets("xy")
    joint = model[2] + model[1][grams].sum(axis=0)
    assert len(grams) == 4 + 3 + 2  # with a space on either side
    assert joint[1] > joint[0]


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    out = toxicity.op10_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    good = [r for r in held if r.toxic == 0]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    assert sum(r.predicted for r in good) / len(good) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_words_have_one_space_on_either_side():
    """A text that starts with another character and ends with a letter has no stray gram."""
    assert sorted(language_id.gram_buckets("- ab")) == sorted(language_id.gram_buckets("ab")) == sorted(language_id.gram_buckets("ab!"))


@pytest.mark.parametrize("grams", [1, 1 << 19])
def test_language_query_against_plain_counting(spark, sf, monkeypatch, grams):
    monkeypatch.setattr(language_id, "BATCH_GRAMS", grams)
    monkeypatch.setattr(language_id, "BATCH_CELLS", 1000 if grams == 1 else 1 << 21)
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").collect()
    counts, priors = {}, collections.Counter()
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            priors[r.lang] += 1
            counts.setdefault(r.lang, collections.Counter()).update(language_id.gram_buckets(r.text).tolist())
    cells = 1 << language_id.BUCKET_BITS
    out = {r.doc_id: r for r in language_id.op6_language_id(spark, sf).collect()}
    for r in docs:
        found = collections.Counter(language_id.gram_buckets(r.text).tolist())
        if not found:
            assert out[r.doc_id].lang_pred == "und" and out[r.doc_id].score == 0
            continue
        joint = {
            lang: math.log(priors[lang] / sum(priors.values())) + sum(n * math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * cells)) for b, n in found.items())
            for lang, c in counts.items()
        }
        best = max(sorted(joint), key=joint.get)
        assert out[r.doc_id].lang_pred == best
        assert math.isclose(out[r.doc_id].score, 1 / sum(math.exp(min(700, j - joint[best])) for j in joint.values()), rel_tol=1e-6)


def tiny_chain():
    docs = [([(2, [0])], 8, 1), ([(0, [0])], 5, 1), ([(3, [1])], 9, 1)] * 12 + [([], 7, 0), ([], 30, 0), ([(4, [2])], 9, 0)] * 20
    return toxicity.fit(docs, {"=idiot": 0, "lowe": 1, "=okay": 2})


def test_toxicity_spans_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "You are an IDIOT, loweisch too"), (3, "You are an IDIOT, loweisch too"), (None, "all is okay here"), (6, "fine " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxicity", "2 AS score")
    out = toxicity.toxicity(df, tiny_chain()).collect()
    assert [r.toxicity.score >= 0.5 for r in out] == [False, False, True, True, False, False]
    assert [rows[2][1][s.start : s.end] for s in out[2].toxicity.spans] == ["IDIOT", "loweisch"]
    assert toxicity.toxicity(df.limit(0), tiny_chain()).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.toxicity.score < 0.5 for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect())


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, start, move = rng.normal(size=5), rng.normal(size=2), rng.normal(size=(2, 2))
    paths = {}
    for s in itertools.product((0, 1), repeat=5):
        paths[s] = np.exp(start[s[0]] + sum(move[a, b] for a, b in zip(s, s[1:], strict=False)) + sum(x for x, y in zip(e, s, strict=True) if y))
    z = sum(paths.values())
    padded = np.zeros((7, 2))
    padded[:5, 0] = e
    padded[:1, 1] = e[:1]
    toxic, expected, log_z = toxicity.forward_backward(padded, np.array([5, 1]), start, move)
    assert np.isclose(log_z[0], np.log(z))
    assert np.allclose(toxic[:5, 0], [sum(p for s, p in paths.items() if s[t]) / z for t in range(5)])
    assert np.allclose(expected, [[sum(p * sum((x, y) == (a, b) for x, y in zip(s, s[1:], strict=False)) for s, p in paths.items()) / z for b in (0, 1)] for a in (0, 1)])
    chain = toxicity.Chain({}, np.zeros(0), np.zeros(8), start, move, (1.0, 0.0))
    many = [list(e), [], list(e[:1]), *([list(e)] * 40)]
    got = chain.marginals(many)
    assert [len(p) for p in got] == [len(c) for c in many]
    assert np.allclose(got[0], toxic[:5, 0]) and np.allclose(got[-1], toxic[:5, 0]) and np.allclose(got[2], toxic[:1, 1])
    assert np.isclose(toxicity.odds(got[0]), np.log(1 / np.prod(1 - toxic[:5, 0]) - 1))


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    library.no_padding()
    library.no_truncation()
    return Bpe(default_tokenizer()), library


def same(pair, text):
    packed, shown = pair[0].encode(text)
    want = pair[1].encode(text, add_special_tokens=False)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want.ids
    assert shown == pair[1].decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "It's don't we'll", "a<|endoftext|>B<|startoftext|>", "<|nope|>", "ΑΣ Σ ΣΑΣ", "İ ſ Å", "½ ² 123 ١٢", "é é", "🎉👨‍👩‍👧", "東京 tokyo", "x" * 5000, "\x1c\x00\x7f", "a b　c", "\U0001e900Ɤ"])
def test_bpe_cases(pair, text):
    same(pair, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(pair, text):
    same(pair, text)


def test_bpe_cuts_join_to_the_word(pair):
    for word in ("hello", "qĠx", "zzqqxx", "ñandú"):
        symbols = "".join(pair[0].symbols[b] for b in word.encode())
        assert "".join(pair[0].cuts(symbols)) == symbols


def test_bpe_query_against_library(spark, sf, pair):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    out = op9_bpe(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        want = pair[1].encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(pair[1].decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark):
    rows = [(1, None), (2, ""), (3, "hello"), (3, "hello"), (None, "hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "array(1) AS other")
    out = encode_decode(df, default_tokenizer()).collect()
    assert [r.ids for r in out[:2]] == [[], []] and out[0].decoded == "" and out[2].ids == out[4].ids != []
    assert encode_decode(df.limit(0), default_tokenizer()).count() == 0


def test_bpe_long_words(pair):
    """Fragments on either side of the bound where merging changes its form, and a very long word."""
    rng = np.random.default_rng(8)
    for n in (99, 100, 101, 102, 350, 30_000):
        for letters in ("ab", "acgt", "etaoinshrdlu"):
            same(pair, "".join(rng.choice(list(letters), n)))
