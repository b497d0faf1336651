"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of non-letters becomes one space, and the n-grams of one to three
characters are hashed into a fixed number of buckets. Training counts (language, bucket) pairs on the
executors; what reaches the driver is the count matrix, at most languages x buckets cells. Its log
probabilities are broadcast, and a batch is scored as one sparse product: the (text, bucket, count)
cells of its texts against the matrix's rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import text_batches
from quillon.session import table

BUCKET_BITS = 15
#: Most labelled rows that training reads (in expectation: rows are drawn by a hash of the id).
MAX_TRAIN_ROWS = 40_000
#: Most languages; more are refused, so the matrix that is collected and broadcast has a known bound.
MAX_LANGUAGES = 500
#: Texts and n-grams that one product takes together (one text may have more), and cells of the matrix it picks.
BATCH_TEXTS = 64
BATCH_GRAMS = 1 << 19
BATCH_CELLS = 1 << 21
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_buckets(text: str | None) -> np.ndarray:
    """The buckets of a whole text's n-grams; empty if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, np.uint32(32))
    kept = codes[letter | np.concatenate(([False], letter[:-1]))]
    codes = np.concatenate(([np.uint32(32)], kept, np.full(int(letter[-1]), 32, np.uint32))).astype(np.uint32)
    h = codes * _MULTIPLIERS[0]
    two = (h[:-1] ^ (codes[1:] * _MULTIPLIERS[1])) * _MULTIPLIERS[2] + np.uint32(1)
    three = (two[:-1] ^ (codes[2:] * _MULTIPLIERS[0])) * _MULTIPLIERS[1] + np.uint32(2)
    return np.concatenate([x ^ (x >> np.uint32(15)) for x in (h, two, three)]).astype(np.int64) & ((1 << BUCKET_BITS) - 1)


def train(labelled: DataFrame, text_col: str, label_col: str, max_rows: int = MAX_TRAIN_ROWS, id_col: str | None = None):
    """(languages, log matrix [bucket, language], log priors) from rows with a non-null label.

    At most about ``max_rows`` rows are used, drawn by a hash of ``id_col`` (all rows if it is None).
    Without labelled rows the model is None; more than MAX_LANGUAGES labels are an error.
    """
    text_batches(labelled.sparkSession)
    labelled = labelled.where(F.col(label_col).isNotNull())
    if id_col is not None:
        n = labelled.select(label_col).count()
        if n > max_rows:
            labelled = labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("train")), F.lit(n)) < max_rows)

    if labelled.select(F.col(label_col).cast("string").alias("lang")).distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                grams = np.bincount(gram_buckets(text), minlength=1 << BUCKET_BITS)
                sums[lang] = sums[lang] + grams if lang in sums else grams
                docs[lang] = docs.get(lang, 0) + 1
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(total[at], docs[lang])})

    rows = (
        labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
        .mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    if rows.empty:
        return None
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((1 << BUCKET_BITS, len(langs)))
    priors = np.zeros(len(langs))
    for j, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        cells = own[own["bucket"] >= 0]
        counts[cells["bucket"].to_numpy(), j] = cells["n"]
        priors[j] = own.loc[own["bucket"] < 0, "n"].sum()
    counts += 0.5
    return langs, np.log(counts / counts.sum(axis=0)), np.log(priors / priors.sum())


def joints(grams: list[np.ndarray], model) -> np.ndarray:
    """The log joint probabilities [text, language] of texts with at least one n-gram: a sparse matrix of counts, by
    rows, times the log probabilities."""
    _, logs, priors = model
    codes = np.concatenate([g + (i << BUCKET_BITS) for i, g in enumerate(grams)])
    counts = np.bincount(codes, minlength=len(grams) << BUCKET_BITS)
    cells = np.flatnonzero(counts)
    row, bucket, counts = cells >> BUCKET_BITS, cells & ((1 << BUCKET_BITS) - 1), counts[cells]
    out = np.tile(priors, (len(grams), 1))
    step = max(1, BATCH_CELLS // len(priors))
    for lo in range(0, len(cells), step):
        own = row[lo : lo + step]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[first]] += np.add.reduceat(counts[lo : lo + step, None] * logs[bucket[lo : lo + step]], first, axis=0)
    return out


def predict(df: DataFrame, model, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds a struct column ``out`` (lang, score; replaced if it exists) to every row: the likeliest
    learned language and its posterior probability; ``und`` and 0 if the text is null or has no
    letter, or nothing was learned. Ties go to the language that sorts first. Whole texts are scored,
    very long ones too; rows are independent, so repeated rows, null ids and columns of any name pass through."""
    text_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held.value
        for texts in batches:
            done = [("und", 0.0)] * len(texts)
            rows: list[int] = []
            grams: list[np.ndarray] = []
            for i, text in enumerate([*texts, None]):
                found = gram_buckets(text) if model is not None else ()
                full = len(rows) == BATCH_TEXTS or sum(map(len, grams)) + len(found) > BATCH_GRAMS
                if rows and (full or i == len(texts)):
                    for row, joint in zip(rows, joints(grams, model), strict=True):
                        best = int(joint.argmax())
                        done[row] = (model[0][best], float(1 / np.exp(joint - joint[best]).sum()))
                    rows, grams = [], []
                if len(found):
                    rows.append(i)
                    grams.append(found)
            yield pd.DataFrame(done, columns=["lang", "score"])

    return df.withColumn(out, score(F.col(text_col)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from rows whose crc32(doc_id as text) mod 4 is not 2, predicts all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out), "text", "lang", id_col="doc_id")
    return predict(docs.drop("lang"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
