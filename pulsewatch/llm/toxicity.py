"""Toxicity scores: FTRL-proximal logistic regression over hashed n-grams.

Features of a text are its distinct words, word pairs, and skip-grams (pairs
with one or two words between), hashed to 2^bits coordinates.  Learning keeps a rate per
coordinate and the L1 term leaves most weights exactly zero, so what is
broadcast is a short list (at most 2^bits weights).

Learning uses at most ``max_rows`` labelled rows, chosen by a hash of the id,
in ``shards`` groups; the shards' weights are averaged.  Scoring covers all
rows and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, ship, staged, whole_text

WORDS = re.compile(r"\w+").findall
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
TABLE_ENTRIES = 500_000


class WordHashes(dict):
    """Word -> 64-bit hash, kept in a table of bounded size."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 32:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[word] = h
        return h


_hashes = WordHashes()


def features(text: str, bits: int) -> list[np.ndarray]:
    """Coordinates of the words, pairs and skip-grams, repeats included."""
    words = WORDS(text.lower())
    if not words:
        return []
    h = np.array(list(map(_hashes.__getitem__, words)), np.uint64)
    shift = np.uint64(64 - bits)
    out = [(h * MIX[0]) >> shift]
    for gap in (1, 2, 3):
        if len(h) > gap:
            out.append((((h[:-gap] * MIX[1]) ^ (h[gap:] + MIX[2] * np.uint64(gap))) * MIX[0]) >> shift)
    return out


def distinct(text: str, bits: int) -> np.ndarray:
    parts = features(text, bits)
    return np.unique(np.concatenate(parts)).astype(np.int64) if parts else np.zeros(0, np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss; the last coordinate is the bias, which
    has no L1 term."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (sigmoid(w.sum()) - label) * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(labelled: DataFrame, bits: int = 20, max_rows: int = 16_384, shard_rows: int = 4_096, epochs: int = 8,
          alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, positive_weight: float = 5.0) -> dict[int, float]:
    """Non-zero weights by coordinate (2^bits: the bias) from rows (id, text,
    label 0/1).  Rows of the rare label 1 count ``positive_weight`` times; the
    L1 term is strong enough to keep what few rows show at zero.  Rows with a null label are ignored; an id given
    several times counts as often.  No rows: no weights."""
    ship(labelled.sparkSession)
    rows = labelled.where("label IN (0, 1)")
    total = rows.count()
    if total == 0:
        return {}
    if total > max_rows:  # a bounded sample, the same on every run
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * max_rows / total))
    shards = max(1, -(-min(total, max_rows) // shard_rows))

    def extract(batches: Iterator[pd.DataFrame]):
        claim("toxicity", _hashes.clear)
        for pdf in batches:
            yield pd.DataFrame({"shard": pdf["shard"], "pick": pdf["pick"], "label": pdf["label"].astype(int),
                                "at": [distinct(t, bits).astype(np.int32).tobytes() for t in pdf["text"]]})

    picked = rows.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int").alias("shard"),
                         F.xxhash64("id", F.lit(7)).alias("pick"), "label", whole_text().alias("text")) \
        .mapInPandas(extract, "shard int, pick long, label int, at binary")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pick", "label"], kind="stable")
        sets = [np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["at"]]
        labels = pdf["label"].tolist()
        model = Ftrl(bits, alpha, beta, l1, 0.0)
        order = np.random.default_rng(11)
        for _ in range(epochs):
            for i in order.permutation(len(sets)):
                model.learn(sets[i], labels[i], positive_weight if labels[i] else 1.0)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at], "shard": int(pdf["shard"].iloc[0])})

    made = staged(picked.groupBy("shard").applyInPandas(learn, "at long, w double, shard int"), "ftrl")
    learned = made.agg(F.countDistinct("shard")).first()[0] or 1
    return {r["at"]: r["w"] for r in made.groupBy("at").agg((F.sum("w") / F.lit(learned)).alias("w")).collect()}


def score(df: DataFrame, weights: dict[int, float], bits: int = 20, text_col: str = "text",
          out_col: str = "score") -> DataFrame:
    """Add (or replace) ``score`` (0 to 1) of every whole text.

    Null and empty texts get the score of no features; without weights every
    score is 0.  Repeated rows stay repeated; an empty table gives no rows;
    other columns are kept as they are.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((np.array(list(weights), np.int64), np.array(list(weights.values()), np.float64)))

    def scored(texts: pd.Series) -> pd.Series:
        claim("toxicity", _hashes.clear)
        at, w = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = w
        out = []
        for text in texts:
            hits = [part[dense[part] != 0] for part in map(np.ndarray.astype, features(text, bits), repeat(np.int64))]
            total = dense[np.unique(np.concatenate(hits))].sum() if hits else 0.0
            out.append(sigmoid(dense[-1] + total) if len(at) else 0.0)
        return pd.Series(out, dtype="float64")

    return df.withColumn(out_col, F.pandas_udf(scored, T.DoubleType())(whole_text(text_col)))


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that never gives a label to learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> dict[int, float]:
    """Weights from the labelled rows outside the held-out fifth.  Labels of
    an id given twice with different values are both used."""
    known = labels.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("label")) \
        .where("id IS NOT NULL AND label IS NOT NULL").distinct()
    texts = docs.select(F.col(id_col).alias("id"), "text")
    return train(texts.join(known, "id").select("id", "text", "label"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", score_col: str = "score",
             predicted_col: str = "predicted") -> DataFrame:
    """Every row of ``docs`` plus (or with these replaced) score and predicted
    (1 if score >= 0.5)."""
    return score(docs, learn_from(docs, labels, id_col), out_col=score_col) \
        .withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))
