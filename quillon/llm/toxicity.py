"""Toxicity: a two-state linear-chain conditional random field that tags toxic spans.

Labels mark whole documents, so token labels are derived first: words and word beginnings that
occur almost only in toxic training documents (by a z-score of the log odds) make the feature
vocabulary, and in toxic documents their occurrences are the tokens labelled toxic. The chain runs
over a document's informative words, with every run of other words between them as one gap item.
The field has a weight for each feature and gap length, and transition and start weights; it is
fitted by gradient ascent on the driver from a bounded sample.

Scoring runs where the text is read, a batch of chains at a time. Forward-backward gives every item's
marginal. The marginals aggregate to the odds that not all items are clean, and those, calibrated on the
training documents, to the document's score; marginals of one half and more give the offending
character offsets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import staged, text_batches
from quillon.session import table

#: Most labelled rows that training reads (in expectation: rows are drawn by a hash of the id).
MAX_TRAIN_ROWS = 16_000
#: Most features of the vocabulary; the strongest are taken.
MAX_FEATURES = 4_000
#: Least documents that a feature stands in.
MIN_DOCS = 5
#: Lengths of the word beginnings that are features besides whole words.
PREFIXES = range(3, 9)
WORD = re.compile(r"[^\W_]+")
GAPS = 8
CACHE = 100_000
#: Items of padded chains that one pass of the recursions holds.
CELLS = 1 << 18


def features(word: str) -> list[str]:
    """A word's possible features: itself and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


class Chain:
    """The fitted field: feature weights, gap weights, start weights and transitions (state 1 is toxic)."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, gaps: np.ndarray, start: np.ndarray, move: np.ndarray, scale: tuple[float, float]):
        self.vocabulary, self.weights, self.gaps, self.start, self.move, self.scale = vocabulary, weights, gaps, start, move, scale
        self.caches: list[dict[str, float | None]] = [{}, {}]

    def weight(self, token: str) -> float | None:
        """A word's emission weight for the toxic state; None if it has no known feature."""
        word = token.lower()
        ids = [i for f in features(word) if (i := self.vocabulary.get(f)) is not None]
        out = float(self.weights[ids].sum()) if ids else None
        if len(self.caches[0]) >= CACHE:
            self.caches = [{}, self.caches[0]]
        self.caches[0][token] = out
        return out

    def emissions(self, words: list[str]) -> tuple[list[float], list[int]]:
        """Emission weights of the chain's items, and the index of each item's word (-1: a gap)."""
        young, old = self.caches
        known: list[tuple[int, float]] = []
        for i, w in enumerate(words):
            e = young[w] if w in young else old[w] if w in old else self.weight(w)
            if e is not None:
                known.append((i, e))
                young, old = self.caches
        return self.items(known, len(words))

    def items(self, known: list[tuple[int, float]], n: int) -> tuple[list[float], list[int]]:
        """The chain of informative words (index, weight) among n words."""
        out, at, after = [], [], 0
        for i, e in [*known, (n, 0.0)]:
            if i > after:
                out.append(float(self.gaps[gap(i - after)]))
                at.append(-1)
            if i < n:
                out.append(e)
                at.append(i)
            after = i + 1
        return out, at

    def marginals(self, chains: list[list[float]]) -> list[np.ndarray]:
        """P(item is toxic) of every item of every chain, by forward-backward over chains of like lengths together."""
        out: list[np.ndarray] = [np.empty(0)] * len(chains)
        order = sorted((i for i, c in enumerate(chains) if c), key=lambda i: len(chains[i]))
        lo = 0
        while lo < len(order):
            least, hi = len(chains[order[lo]]), lo + 1
            while hi < len(order) and (k := len(chains[order[hi]])) <= 2 * least + 8 and k * (hi + 1 - lo) <= CELLS:
                hi += 1
            group = order[lo:hi]
            n = np.array([len(chains[i]) for i in group])
            e = np.zeros((int(n.max()), len(group)))
            for c, i in enumerate(group):
                e[: n[c], c] = chains[i]
            a0, a1, b0, b1, z = recursions(e, n, self.start, self.move)
            toxic = np.exp(np.minimum(a1 + b1 - z, 0.0))
            for c, i in enumerate(group):
                out[i] = toxic[: n[c], c]
            lo = hi
        return out

    def score(self, marginals: np.ndarray) -> float:
        """The calibrated probability that a document is toxic, from its items' marginals."""
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.scale[0] * odds(marginals) + self.scale[1]))))


def odds(marginals: np.ndarray) -> float:
    """The log odds that not every item is clean, items taken by their marginals."""
    clean = min(-1e-9, float(np.log1p(-np.minimum(marginals, 1 - 1e-12)).sum()))
    return math.log(-math.expm1(clean)) - clean


def gap(n: int) -> int:
    """The class of a gap of n words: by powers of two."""
    return min(GAPS - 1, n.bit_length() - 1)


def recursions(e: np.ndarray, n: np.ndarray, start: np.ndarray, move: np.ndarray):
    """Forward and backward log sums (a0, a1, b0, b1) [k, d] and log Z [d] of padded chains: e [k, d] holds the
    toxic state's emission weights (the other's are 0), n the items of each chain."""
    k, d = e.shape
    (m00, m01), (m10, m11) = move
    a0, a1, b0, b1 = np.empty_like(e), np.empty_like(e), np.zeros_like(e), np.zeros_like(e)
    a0[0], a1[0] = start[0], start[1] + e[0]
    for t in range(1, k):
        p, q = a0[t - 1], a1[t - 1]
        a0[t] = np.logaddexp(p + m00, q + m10)
        a1[t] = np.logaddexp(p + m01, q + m11) + e[t]
    for t in range(k - 2, -1, -1):
        p, q, more = b0[t + 1], e[t + 1] + b1[t + 1], t < n - 1
        b0[t] = np.where(more, np.logaddexp(p + m00, q + m01), 0.0)
        b1[t] = np.where(more, np.logaddexp(p + m10, q + m11), 0.0)
    last = n - 1, np.arange(d)
    return a0, a1, b0, b1, np.logaddexp(a0[last], a1[last])


def forward_backward(e: np.ndarray, n: np.ndarray, start: np.ndarray, move: np.ndarray):
    """P(toxic) [k, d], expected transitions [2, 2] and log Z [d] of padded chains."""
    k = len(e)
    a0, a1, b0, b1, z = recursions(e, n, start, move)
    inside = np.arange(k)[:, None] < n
    toxic = np.where(inside, np.exp(np.minimum(a1 + b1 - z, 0.0)), 0.0)
    expected = np.zeros((2, 2))
    if k > 1:
        for i, a in enumerate((a0, a1)):
            for j, b in enumerate((b0[1:], e[1:] + b1[1:])):
                expected[i, j] = np.exp(np.minimum((a[:-1] + move[i, j] + b - z)[inside[1:]], 0.0)).sum()
    return toxic, expected, z


def fit(docs: list[tuple[list[tuple[int, list[int]]], int, int]], vocabulary: dict[str, int], rounds: int = 120) -> Chain:
    """Fits the field. docs: (informative words as (index, feature ids), number of words, toxic)."""
    shape = Chain(vocabulary, np.zeros(len(vocabulary)), np.zeros(GAPS), np.zeros(2), np.zeros((2, 2)), (1.0, 0.0))
    chains = [(known, n, y) for known, n, y in docs if n]
    params = {"w": np.zeros(len(vocabulary)), "g": np.full(GAPS, -2.0), "s": np.zeros(2), "m": np.zeros((2, 2))}
    batches = []
    by_length = sorted(chains, key=lambda c: len(c[0]))
    for lo in range(0, len(by_length), 2048):
        part = by_length[lo : lo + 2048]
        layout = [shape.items([(i, 0.0) for i, _ in known], n)[1] for known, n, _ in part]
        n = np.array([len(x) for x in layout])
        k = int(n.max())
        item, feat, gap_item, gap_class, truth = [], [], [], [], np.zeros((k, len(part)))
        for r, ((known, words, y), at) in enumerate(zip(part, layout, strict=True)):
            ids, last = dict(known), -1
            for c, i in enumerate(at):
                if i < 0:
                    following = at[c + 1] if c + 1 < len(at) else words
                    gap_item.append(c * len(part) + r)
                    gap_class.append(gap(following - last - 1))
                else:
                    item += [c * len(part) + r] * len(ids[i])
                    feat += ids[i]
                    truth[c, r] = y
                    last = i
        batches.append((n, *(np.array(x, np.int64) for x in (item, feat, gap_item, gap_class)), truth))
    moment = {p: (np.zeros_like(v), np.zeros_like(v)) for p, v in params.items()}
    for step in range(1, rounds + 1):
        grad = {p: -1e-2 * v for p, v in params.items()}
        for n, item, feat, gap_item, gap_class, truth in batches:
            e = np.bincount(item, params["w"][feat], truth.size).astype(float)
            e[gap_item] += params["g"][gap_class]
            toxic, expected, _ = forward_backward(e.reshape(truth.shape), n, params["s"], params["m"])
            rest = (truth - toxic).reshape(-1)
            grad["w"] += np.bincount(feat, rest[item], len(grad["w"]))
            grad["g"] += np.bincount(gap_class, rest[gap_item], GAPS)
            grad["s"][1] += (truth[0] - toxic[0]).sum()
            states = truth.astype(int)
            inside = np.arange(1, len(truth))[:, None] < n
            seen = np.bincount((states[:-1] * 2 + states[1:])[inside], minlength=4).reshape(2, 2)
            grad["m"] += seen - expected
        for p, g in grad.items():
            m, v = moment[p]
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * g * g
            params[p] += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    chain = Chain(vocabulary, params["w"], params["g"], params["s"], params["m"], (1.0, 0.0))
    emissions = [chain.items([(i, float(chain.weights[ids].sum())) for i, ids in known], n)[0] for known, n, _ in docs]
    found = [odds(p) for p in chain.marginals(emissions)]
    chain.scale = logistic(np.clip(found, -30, 30), np.array([y for _, _, y in docs], float))
    return chain


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic regression (ridge on the slope), by Newton steps."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1.0, 1e-3])
        w = w + np.linalg.solve(hess, design.T @ (y - p) - np.array([1.0, 1e-3]) * w)
    return float(max(w[0], 1e-3)), float(w[1])


def vocabulary_of(sample: DataFrame, max_features: int = MAX_FEATURES) -> list[str]:
    """The features that mark toxic documents, strongest first: counts of documents that a word
    stands in, by label, summed for each of the word's features."""
    words = (
        sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
        .groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    )
    listed = F.array(F.concat(F.lit("="), "word"), *(F.when(F.length("word") > k, F.substring("word", 1, k)) for k in PREFIXES))
    totals = sample.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, good = float(totals["bad"] or 0), float((totals["n"] or 0) - (totals["bad"] or 0))
    if not bad or not good:
        return []
    odds = F.log((F.col("bad") + 0.5) / bad) - F.log((F.col("good") + 0.5) / good)
    z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    rows = (
        words.select(F.explode(listed).alias("f"), "bad", "good").where("f is not null").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= MIN_DOCS).withColumn("z", z).withColumn("odds", odds)
        .where((F.col("z") > 3.5) & (F.col("odds") > math.log(20.0)) & (F.col("bad") > 2 * F.col("good")))
        .orderBy(F.desc("z"), "f").limit(max_features).collect()
    )
    return [r["f"] for r in rows]


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Chain:
    """Fits the field on documents (doc_id, text) with a label (doc_id, toxic). Rows without a label
    or id are not used; at most about ``max_rows`` labelled rows are drawn by a hash of the id, so the
    broadcast label table is bounded. Without both labels present nothing is ever toxic."""
    text_batches(documents.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    if n > max_rows:
        labels = labels.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(n)) < max_rows)
    sample = staged(documents.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "toxic"), "toxic-train")
    vocabulary = {f: i for i, f in enumerate(vocabulary_of(sample))}
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = held.value
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = WORD.findall(text or "")
                at, ids, sizes = [], [], []
                for i, w in enumerate(words):
                    if got := [j for f in features(w.lower()) if (j := ids_of.get(f)) is not None]:
                        at.append(i)
                        ids += got
                        sizes.append(len(got))
                out.append((at, ids, sizes, len(words), toxic))
            yield pd.DataFrame(out, columns=["at", "ids", "sizes", "n", "toxic"])

    rows = sample.mapInPandas(known, "at array<int>, ids array<int>, sizes array<int>, n int, toxic int").toPandas()
    docs = []
    for at, ids, sizes, n, toxic in rows.itertuples(index=False):
        ends = np.cumsum(sizes) if len(sizes) else []
        docs.append(([(int(i), [int(j) for j in ids[e - s : e]]) for i, s, e in zip(at, sizes, ends, strict=True)], int(n), int(toxic)))
    docs.sort(key=repr)  # the fit doesn't depend on the order that tasks ended in
    return fit(docs, vocabulary)


def offending(text: str | None, at: list[int], marginals: np.ndarray) -> list[dict]:
    """The character spans of the words (at: each item's word, -1: a gap) whose marginal is one half or more."""
    bad = {i: p for i, p in zip(at, marginals.tolist(), strict=True) if i >= 0 and p >= 0.5}
    return [{"start": m.start(), "end": m.end(), "p": bad[i]} for i, m in enumerate(WORD.finditer(text)) if i in bad] if bad else []


def toxicity(df: DataFrame, model: Chain, text_col: str = "text", out: str = "toxicity", spans: bool = True) -> DataFrame:
    """Adds a struct column ``out`` (replaced if it exists) to every row: score and, with ``spans``,
    the offending spans (start, end in characters, p). A null or empty text has no items and gets
    the calibrated score of a clean document. Very long texts are read whole. Rows are independent: repeated rows, null ids and
    columns of any name pass through; an empty table stays empty."""
    text_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>" if spans else "score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = held.value
        for texts in batches:
            laid = [chain.emissions(WORD.findall(text or "")) for text in texts]
            marginals = chain.marginals([e for e, _ in laid])
            scored = pd.DataFrame({"score": [chain.score(p) for p in marginals]})
            if spans:
                scored["spans"] = [offending(text, at, p) for text, (_, at), p in zip(texts, laid, marginals, strict=True)]
            yield scored
        chain.caches = [{}, {}]  # the worker goes on to other tasks

    return df.withColumn(out, run(F.col(text_col)))


def held_out():
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def contract_model(documents: DataFrame, spark: SparkSession, sf_dir: str) -> Chain:
    """The field fitted on the labels outside the held-out fold."""
    return train(documents, table(spark, sf_dir, "labels").where(~held_out()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from rows whose crc32(doc_id as text) mod 5 is not 0, scores all and counts the offending spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, contract_model(docs, spark, sf_dir))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.spans").cast("long").alias("n_spans"),
    )
