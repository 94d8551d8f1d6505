"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches, text_of

#: Words kept hashed by a task; the store is emptied when it is full.
STORE_ROWS = 100_000


@dataclass(frozen=True)
class Settings:
    """bits: of the hashed feature space. train_rows: labelled documents used, at most (the rest of the labels isn't
    read); the others are the update's usual parameters."""

    bits: int = 18
    train_rows: int = 6000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 8.0


def shape_of(word: str) -> str:
    """Upper-case runs as A, others of letters as a, digits as 9; runs of any other sign as one of it."""
    out = []
    for c in word:
        s = "9" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class _Words(dict):
    """word -> its hash (upper half) and its shape's (lower half)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= STORE_ROWS:
            self.clear()
        self[word] = value = zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(shape_of(word).encode())
        return value


_words = _Words()


def features(text: str, bits: int) -> np.ndarray:
    """Indexes of the text's n-grams, repeats included: words and pairs of words, and the same of words' shapes. A word
    that follows itself is one pair, whatever the word."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    mask, odd = np.uint64((1 << bits) - 1), np.uint64(0x9E3779B97F4A7C15)
    both = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    parts = []
    for salt, h in ((1, both >> np.uint64(32)), (2, both & np.uint64(0xFFFFFFFF))):
        pairs = h[:-1] * odd + h[1:]
        if salt == 1:
            pairs[h[:-1] == h[1:]] = 0
        parts += [h + np.uint64(salt << 40), pairs * odd + np.uint64(salt << 50)]
    mixed = np.concatenate(parts) * odd
    return ((mixed >> np.uint64(40)) & mask).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], s: Settings) -> np.ndarray:
    """FTRL-proximal over the rows in order, epochs times. Returns the weights; the last is the bias."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= s.l1, 0.0, -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    counted = []
    for idx, label in rows:
        unique, times = np.unique(idx, return_counts=True)
        counted.append((np.append(unique, 1 << s.bits), np.append(times * (s.scale / max(1, len(idx))), 1.0), label))
    for _ in range(s.epochs):
        for i, x, label in counted:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of doc_id as text leaves 2 by 4. Null: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray | None:
    """Weights learnt from labelled rows that aren't held out; None without such rows.

    Of labels that disagree about a document the smallest counts, in whatever order they come. The train_rows rows of smallest hash are taken of those that docs holds, so that a rerun takes the same, and labels of other
    documents take no one's place; the bound keeps training one small task. Their ids are broadcast, and only their texts
    leave the scan.
    """
    text_batches(docs.sparkSession)
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("label").alias("label")).join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.train_rows)
    )
    sample = (
        docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(s.train_rows)
    )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(features(t, s.bits), int(y)) for b in batches for t, y in zip(b["text"], b["label"], strict=True)]
        if rows:
            yield pd.DataFrame({"weights": [train(rows, s).tobytes()]})

    found = sample.select("text", "label").coalesce(1).mapInPandas(learn, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], dtype=np.float32) if found else None


def score_of(spark: SparkSession, weights: np.ndarray | None, s: Settings = Settings(), text: str = "text") -> Column:
    """The score, 0 to 1, of each whole text. Null text: as an empty one. Without weights (no labels): 0.5."""
    if weights is None:
        return F.lit(0.5)
    text_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value

        def one(t: str) -> float:
            i = features(t, s.bits)
            x = float(w[-1]) + (float(w[i].sum(dtype=np.float64)) * s.scale / len(i) if len(i) else 0.0)
            return 1 / (1 + np.exp(-min(35.0, max(-35.0, x))))

        return pd.Series([one(t) for t in texts], dtype="float64")

    return score(text_of(text))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, s: Settings = Settings()) -> DataFrame:
    """Scores every document. Returns (doc_id, held_out, score, predicted), a row for each row of docs.

    The score is a sparse dot product of the learnt weights with relative frequencies of hashed n-grams; lang, source
    and doc_id are no inputs. Null or empty text: the bias alone. Null doc_id: not held out. No labels: 0.5. Labels
    without a document, and null labels, are left out. Rows that repeat: each is scored, and a label is used once; of labels that disagree the smallest. Long texts: all
    of their n-grams count. Empty table: no rows. Extra columns are left out.
    """
    scored = docs.select("doc_id", score_of(docs.sparkSession, fit(docs, labels, s), s).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, s: Settings = Settings()) -> DataFrame:
    """The rows of docs whose text isn't rejected, with the columns of docs, whatever their names. Without a label to learn from
    nothing is rejected: all rows are kept. Null and empty texts are scored by the bias alone; equal rows go or stay together; an
    empty table gives no rows."""
    weights = fit(docs, labels, s)
    if weights is None:
        return docs
    scored = docs.withColumn("__quality_score", score_of(docs.sparkSession, weights, s))
    return scored.where(F.col("__quality_score") >= threshold).drop("__quality_score")
