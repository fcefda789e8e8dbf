"""Quality scores learnt from trusted positives and unlabelled text.

A text is described by its shape: shares of letters, digits and signs, word
lengths, how often words, pairs and lines recur.  Each feature is cut at
quantiles of the sample, and the model adds one weight per feature and bin.

Learning needs no negatives.  The share of good texts among the unlabelled
ones (the class prior) is estimated from a first classifier of positives
against unlabelled: above any score the unlabelled hold at least that share of
what the positives hold, and the best-supported smallest ratio is taken.  The
model then minimises the non-negative unbiased risk

    prior E_P[loss(+)] + max(0, E_U[loss(-)] - prior E_P[loss(-)]),

and where a step finds the second term negative it moves to undo that.

Learning uses at most about ``max_rows`` positives and ``max_rows`` unlabelled
texts, distinct ones, chosen by hash.  Scoring covers all rows and whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, whole_text
from .toxicity import held_out

SIGNS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
NO_MODEL = 0.5


def shape(text: str) -> list[float]:
    """Features of a whole text; shares of nothing are zero."""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    share = hist / n
    seen = share[share > 0]
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    w = max(1, len(words))
    distinct = Counter(words)
    letters = hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()
    first = [x[:1] for x in words]
    last = [x[-1:] for x in words]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), float(share[65:91].sum()), float(share[48:58].sum()), float(share[128:].sum()), letters / n,
        float(share[32]), float(share[10]), float(-(seen * np.log(seen)).sum()), float(hist[65:91].sum() / max(1, letters)), float(hist[SIGNS].sum() / n),
        sum(map(len, words)) / w, len(distinct) / w, sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:]))) / w,
        max(distinct.values(), default=0) / w, sum(map(bytes.isupper, words)) / w, sum(map(bytes.isalnum, last)) / w, sum(map(bytes.isalnum, first)) / w,
        sum(map(bytes.isdigit, words)) / w, len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        *share[SIGNS].tolist()]


N_FEATURES = 22 + len(SIGNS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


#: Quantiles that cut a feature, closer at the ends: poor texts lie beyond the good ones.
CUTS = (0.002, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97, 0.99, 0.998)


class Bins:
    """Coordinates of feature rows: per feature its bin between the quantiles
    of the positives and of the unlabelled."""

    def __init__(self, p: np.ndarray, u: np.ndarray):
        self.edges = [np.unique(np.concatenate([np.quantile(x[:, i], CUTS) for x in (p, u)])) for i in range(p.shape[1])]
        self.starts = np.cumsum([0, *[len(e) + 1 for e in self.edges]])

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, i], side="right") + s for i, (e, s) in enumerate(zip(self.edges, self.starts))], axis=1)


class Adam:
    def __init__(self, size: int, rate: float):
        self.w, self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        self.w -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def _logit(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    return w[at].sum(axis=1) + w[-1]


def _pull(size: int, at: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Gradient over the weights of per-row gradients of the logit."""
    g = np.bincount(at.ravel(), np.repeat(per_row, at.shape[1]), minlength=size)
    g[-1] = per_row.sum()
    return g


def _batches(rng: np.random.Generator, n: int, parts: int) -> list[np.ndarray]:
    return np.array_split(rng.permutation(n), parts)


def separate(p: np.ndarray, u: np.ndarray, size: int, steps: int, l2: float, rate: float = 0.05, batch: int = 1024) -> np.ndarray:
    """Logistic weights that tell positives from unlabelled, both sides alike."""
    model, rng = Adam(size, rate), np.random.default_rng(7)
    parts = max(1, max(len(p), len(u)) // batch)
    for _ in range(-(-steps // parts)):
        for i, j in zip(_batches(rng, len(p), parts), _batches(rng, len(u), parts)):
            if len(i) and len(j):
                model.step(_pull(size, p[i], (sigmoid(_logit(model.w, p[i])) - 1) / len(i))
                           + _pull(size, u[j], sigmoid(_logit(model.w, u[j])) / len(j)) + l2 * model.w)
    return model.w


def class_prior(p: np.ndarray, u: np.ndarray, sure: float = 0.1) -> float:
    """The largest share of positives that the scores of unlabelled texts
    allow: min over cuts of (share of u above) / (share of p above), the cut
    chosen with a margin for what few rows can show."""
    cuts = np.unique(np.concatenate([p, u]))
    above_p = 1 - np.searchsorted(np.sort(p), cuts, side="left") / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cuts, side="left") / len(u)
    slack = np.sqrt(np.log(4 / sure) / (2 * len(p))) + np.sqrt(np.log(4 / sure) / (2 * len(u)))
    usable = above_p > 0
    ratio = above_u[usable] / above_p[usable]
    best = int(np.argmin(ratio + slack / above_p[usable]))
    return float(np.clip(ratio[best], 0.02, 0.98))


def estimate_prior(p: np.ndarray, u: np.ndarray, size: int, steps: int, l2: float) -> float:
    """Class prior, each half of the rows scored by what the other half taught."""
    found = []
    for side in (0, 1):
        w = separate(p[side::2], u[side::2], size, steps, l2)
        found.append(class_prior(_logit(w, p[1 - side::2]), _logit(w, u[1 - side::2])))
    return float(np.mean(found))


def risk(logit_p: np.ndarray, logit_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk, the second before it is cut at zero."""
    good = prior * np.logaddexp(0, -logit_p).mean()
    return float(good), float(np.logaddexp(0, logit_u).mean() - prior * np.logaddexp(0, logit_p).mean())


def fit(p: np.ndarray, u: np.ndarray, prior: float, size: int, steps: int = 2000, l2: float = 1e-4, rate: float = 0.03, batch: int = 1024) -> np.ndarray:
    """Weights of least non-negative risk, by Adam over batches."""
    model, rng = Adam(size, rate), np.random.default_rng(11)
    parts = max(1, max(len(p), len(u)) // batch)
    for _ in range(-(-steps // parts)):
        for i, j in zip(_batches(rng, len(p), parts), _batches(rng, len(u), parts)):
            if not len(i) or not len(j):
                continue
            zp, zu = _logit(model.w, p[i]), _logit(model.w, u[j])
            _, rest = risk(zp, zu, prior)
            g_rest = _pull(size, u[j], sigmoid(zu) / len(j)) - _pull(size, p[i], prior * sigmoid(zp) / len(i))
            g = -g_rest if rest < 0 else g_rest + _pull(size, p[i], prior * (sigmoid(zp) - 1) / len(i))
            model.step(g + l2 * model.w)
    return model.w


def train(docs: DataFrame, positive_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 16_384,
          steps: int = 2000) -> dict | None:
    """Model from ``docs`` (all of them unlabelled) and the ids known to be good.

    ``positive_ids`` (id) beyond ``max_rows`` are sampled by hash, so the ids
    that are broadcast are bounded.  Repeated texts count once on each side.
    Without positives or texts there is no model (None)."""
    spark = docs.sparkSession
    ship(spark)
    total, known = docs.count(), positive_ids.count()
    if total == 0 or known == 0:
        return None

    def kept(h, n):
        return F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / n))

    ids = positive_ids.select(F.col("id").alias("_id"), F.lit(True).alias("_good")).where(kept(F.xxhash64("_id", F.lit(3)), known))
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text")).withColumn("hash", F.xxhash64("text")) \
        .join(F.broadcast(ids), "_id", "left") \
        .select("text", "hash", F.coalesce("_good", F.lit(False)).alias("good"), kept(F.xxhash64("hash", F.lit(5)), total).alias("plain")).where("good OR plain")

    def extract(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield pd.DataFrame({"hash": pdf["hash"], "good": pdf["good"], "plain": pdf["plain"],
                                "x": [np.array(shape(t), np.float32).tobytes() for t in pdf["text"]]})

    sample = rows.mapInPandas(extract, "hash long, good boolean, plain boolean, x binary") \
        .groupBy("hash").agg(F.max("good").alias("good"), F.max("plain").alias("plain"), F.first("x").alias("x"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hash")
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1).astype(np.float64)
        good, plain = pdf["good"].to_numpy(bool), pdf["plain"].to_numpy(bool)
        if good.sum() < 4 or plain.sum() < 4:
            return pd.DataFrame({"prior": [], "edges": [], "starts": [], "w": []})
        bins = Bins(x[good], x[plain])
        at = bins(x)
        size = int(bins.starts[-1]) + 1
        prior = estimate_prior(at[good], at[plain], size, steps // 8, 1e-2)
        w = fit(at[good], at[plain], prior, size, steps)
        return pd.DataFrame({"prior": [prior], "edges": [[e.tolist() for e in bins.edges]], "starts": [bins.starts.tolist()], "w": [w.tolist()]})

    made = sample.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(learn, "prior double, edges array<array<double>>, starts array<long>, w array<double>").collect()
    return made[0].asDict() if made else None


def score(df: DataFrame, model: dict | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add (or replace) the score (0 to 1) of every whole text.

    Null and empty texts get the score of a text without features; without a
    model every score is 0.5.  Repeated rows stay repeated, an empty table gives
    no rows, other columns are kept as they are."""
    if model is None:
        return df.withColumn(out_col, F.lit(NO_MODEL))
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(([np.array(e) for e in model["edges"]], np.array(model["starts"]), np.array(model["w"])))

    def scored(texts: pd.Series) -> pd.Series:
        edges, starts, w = shared.value
        bins = Bins.__new__(Bins)
        bins.edges, bins.starts = edges, starts
        if not len(texts):
            return pd.Series([], dtype="float64")
        x = np.array([shape(t) for t in texts], np.float32).astype(np.float64)
        return pd.Series(sigmoid(_logit(w, bins(x))))

    return df.withColumn(out_col, F.pandas_udf(scored, T.DoubleType())(whole_text(text_col)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", score_col: str = "score", predicted_col: str = "predicted",
            least: float = 0.3, max_rows: int = 16_384) -> DataFrame:
    """Every row of ``docs`` plus (or with these replaced) score and predicted
    (1 if score >= ``least``).

    The ids labelled 1, and never otherwise, are the positives; neither ids nor
    texts of the held-out fifth are learnt from."""
    known = labels.where(~held_out(id_col)).where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()) \
        .groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("id")
    model = train(docs.where(~held_out(id_col)), known, id_col, max_rows=max_rows)
    return score(docs, model, out_col=score_col).withColumn(predicted_col, (F.col(score_col) >= least).cast("int"))
