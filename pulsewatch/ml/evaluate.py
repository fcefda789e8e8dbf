"""Model evaluation as aggregations.

Nothing here collects predictions: every report is a small aggregate built
in one pass over the scored rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S

EPS = float(np.finfo(np.float64).eps)


def regression_report(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """RMSE and MAPE (|e| / max(|y|, eps)) (K4)."""
    e = F.col(pred).cast("double") - F.col(label).cast("double")
    ape = F.abs(e) / F.greatest(F.abs(F.col(label).cast("double")), F.lit(EPS))
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(ape).alias("mape"))


def threshold_grid(lo: float = S.FAILURE_THRESHOLD_GRID_LO, hi: float = S.FAILURE_THRESHOLD_GRID_HI,
                   n: int = S.FAILURE_THRESHOLD_GRID_N) -> list[float]:
    """Evenly spaced thresholds, the same doubles as numpy.linspace."""
    return [float(x) for x in np.linspace(lo, hi, n)]


def _fbeta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.when((p + r) > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


def threshold_sweep(df: DataFrame, label: str = "y", score: str = "p", beta: float = S.FAILURE_F_BETA,
                    grid: list[float] | None = None) -> DataFrame:
    """Confusion counts and F-beta for each threshold; first best marked (K6).

    Each row is reduced to ``k`` = number of thresholds its score reaches, so
    one aggregation gives a (k, label) table of at most 2 x (n + 1) rows; the
    per-threshold counts are suffix sums over that tiny table (no cross join
    of data with the grid).  Thresholds with no positive prediction are
    skipped for the choice, as in the product.
    """
    grid = sorted(grid or threshold_grid())
    s = F.col(score).cast("double")
    k = sum((s >= F.lit(t)).cast("int") for t in grid)
    hist = df.select(k.alias("k"), F.col(label).cast("int").alias("y")) \
        .groupBy("k").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    spark = df.sparkSession
    thr = spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "i int, threshold double")
    tot = hist.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # predicted positive at threshold i  <=>  k >= i
    joined = thr.join(hist, hist["k"] >= thr["i"], "left").groupBy("i", "threshold").agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    out = joined.crossJoin(tot).select(
        "threshold",
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        (F.col("P") - F.col("tp")).cast("long").alias("fn"),
        (F.col("N") - F.col("fp")).cast("long").alias("tn"), "i")
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = out.withColumn("precision", prec).withColumn("recall", rec) \
        .withColumn("fbeta", _fbeta(F.col("precision"), F.col("recall"), beta))
    w = Window.orderBy(F.col("fbeta").desc(), F.col("i").asc())   # <= n rows: one partition is fine
    cand = out.filter((F.col("tp") + F.col("fp")) > 0)
    best = cand.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("i", F.lit(True).alias("is_best"))
    return out.join(best, "i", "left").withColumn("is_best", F.coalesce("is_best", F.lit(False))).drop("i")


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """One row ``threshold``: the best of a sweep, or ``default`` when no score
    reaches any threshold (K6)."""
    return sweep.agg(F.coalesce(F.max(F.when(F.col("is_best"), F.col("threshold"))), F.lit(default)).alias("threshold"))


def classification_report(df: DataFrame, label: str = "y", pred: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and counts of a binary prediction (K7)."""
    y, yh = F.col(label).cast("int"), F.col(pred).cast("int")
    c = df.agg(F.sum(y * yh).alias("tp"), F.sum((1 - y) * yh).alias("fp"),
               F.sum(y * (1 - yh)).alias("fn"), F.sum((1 - y) * (1 - yh)).alias("tn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return c.withColumn("precision", p).withColumn("recall", r) \
        .withColumn("f1", _fbeta(F.col("precision"), F.col("recall"), 1.0))


def rank_auc(df: DataFrame, label: str = "y", score: str = "p", buckets: int = 256) -> DataFrame:
    """Exact ROC-AUC with tied scores counted one half (K7).

    AUC = (sum over positives of negatives scored lower + half the tied
    negatives) / (P * N).  Scores are first reduced to distinct values with
    (pos, neg) counts (partial aggregation absorbs a hot score); the number of
    negatives below each distinct score comes from per-bucket offsets (a
    ``buckets``-row table) plus a running sum inside each bucket, so no window
    spans the whole table.  Buckets are quantiles of the score distribution.
    """
    s = F.col(score).cast("double")
    d = df.select(s.alias("s"), F.col(label).cast("int").alias("y")).groupBy("s").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    cuts = d.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 10000).alias("cuts"))
    d = d.crossJoin(F.broadcast(cuts))  # one-row side holding bucket edges
    d = d.withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    per_b = d.groupBy("b").agg(F.sum("neg").alias("bneg"))
    wb = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)     # <= buckets rows
    offs = per_b.select("b", F.coalesce(F.sum("bneg").over(wb), F.lit(0)).alias("off"))
    wi = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(offs, "b").withColumn("below", F.col("off") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
    agg = d.agg(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("u"),
                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # undefined (null) unless both classes are present
    return agg.select((F.col("u") / F.nullif(F.col("P") * F.col("N"), F.lit(0))).alias("roc_auc"),
                      F.col("P").cast("long").alias("positives"), F.col("N").cast("long").alias("negatives"))


def macro_report(df: DataFrame, label: str = "y", pred: str = "yhat", classes=S.LEVELS) -> DataFrame:
    """Per-class precision / recall / F1 / support and macro averages.

    One ``groupBy(y, yhat)`` confusion table (at most k x k rows); a class
    with no prediction or no support scores 0, like ``zero_division=0``.  The
    averages are over the classes that occur as a label or a prediction.
    """
    spark = df.sparkSession
    conf = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    cls = spark.createDataFrame([(c,) for c in classes], "cls string")
    per = cls.join(conf, (conf["y"] == cls["cls"]) | (conf["yhat"] == cls["cls"]), "left").groupBy("cls").agg(
        F.coalesce(F.sum(F.when((F.col("y") == F.col("cls")) & (F.col("yhat") == F.col("cls")), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("yhat") == F.col("cls"), F.col("n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when(F.col("y") == F.col("cls"), F.col("n"))), F.lit(0)).alias("support"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("precision", p).withColumn("recall", r) \
        .withColumn("f1", _fbeta(F.col("precision"), F.col("recall"), 1.0))
    total = conf.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n"))).alias("correct"))
    macro = per.where(F.col("predicted") + F.col("support") > 0).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                    F.avg("f1").alias("f1"), F.sum("support").alias("support")).crossJoin(total).select(
        F.lit("macro").alias("cls"), F.lit(None).cast("long").alias("tp"), F.lit(None).cast("long").alias("predicted"),
        "support", "precision", "recall", "f1", (F.col("correct") / F.col("total")).alias("accuracy"))
    per = per.select("cls", F.col("tp").cast("long"), F.col("predicted").cast("long"),
                     F.col("support").cast("long"), "precision", "recall", "f1",
                     F.lit(None).cast("double").alias("accuracy"))
    return per.unionByName(macro.select("cls", "tp", "predicted", F.col("support").cast("long"),
                                        "precision", "recall", "f1", "accuracy"))
