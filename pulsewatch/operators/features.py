"""Feature frame, targets, failure labels, splits.

All per-service row frames go through ``operators.sequence`` so that no
window partition holds more than one chunk of one service.  Every window of
one call shares one spec, hence one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import exprs as X
from . import metrics as M
from . import quality as QY
from . import sequence as SQ

LAG_NAMES = ("rpm_lag_1h", "rpm_lag_6h", "rpm_lag_24h")


def _dbl(c: str) -> Column:
    return F.col(c).cast("double")


def as_numeric(metrics: DataFrame) -> DataFrame:
    """Metric columns as doubles, resources imputed (B10), cyclical time (C3);
    one SQL projection."""
    res = [f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" if c in metrics.columns else f"0.0D AS {c}"
           for c in ("cpu_usage_pct", "memory_usage_pct")]
    numbers = ("rpm", "request_count", "response_time_mean", "response_time_p95", "response_time_p99", "error_rate")
    return metrics.select("service_id", "window_start", *[F.col(c).cast("double").alias(c) for c in numbers],
                          *[F.expr(r) for r in res], *X.cyclical("window_start"))


def build_features(metrics: DataFrame, lags=S.FEATURE_LAGS, rolling: int = S.FEATURE_ROLLING,
                   dense: bool = False, window_size: str | None = None,
                   chunk_rows: int | None = SQ.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Metric rows -> 15 feature columns in fixed order (K1: B10 + C3 + G2 + G3).

    Lags are in rows per service (``dense=True`` first fills silent windows,
    making rows equal to clock steps).  Rolling mean over ``rolling`` rows,
    minimum one row.  Keeps service_id, window_start and the raw metric
    columns needed for targets and labels.
    """
    if dense:
        ws = window_size or "1m"
        metrics = M.fill_gaps(metrics, ws).drop("is_gap")
    base = as_numeric(metrics)
    seq = SQ.sequenced(base, before=max(max(lags), rolling - 1), chunk_rows=chunk_rows)
    w = SQ.halo_window()
    out = seq.select(
        "*",
        *[F.lag("rpm", n).over(w).alias(name) for n, name in zip(lags, LAG_NAMES)],
        F.avg("rpm").over(w.rowsBetween(-(rolling - 1), 0)).alias("rpm_rolling_15m"),
    )
    return SQ.finish(out).select("service_id", "window_start", "rpm", *S.FEATURE_COLUMNS)


def horizon_targets(df: DataFrame, horizons=S.TRAFFIC_HORIZONS, col: str = "rpm",
                    chunk_rows: int | None = SQ.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``target_<h>`` = ``col`` h rows ahead per service."""
    seq = SQ.sequenced(df, before=0, after=max(horizons), chunk_rows=chunk_rows)
    w = SQ.halo_window()
    out = seq.select("*", *[F.lead(col, h).over(w).alias(f"target_{h}") for h in horizons])
    return SQ.finish(out)


def failure_labels(df: DataFrame, run: int = S.FAILURE_RUN, lookahead: int = S.FAILURE_LOOKAHEAD,
                   p99_ms: float = S.ALERT_P99_MS, error_rate: float = S.ALERT_ERROR_RATE,
                   chunk_rows: int | None = SQ.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """G5 + G6: ``streak_start`` when this and the next ``run - 1`` rows all breach
    (a run cut by the end of data does not count); ``failure_target`` = 1 when a
    streak starts in the next 1..``lookahead`` rows (own row excluded)."""
    bad = ((F.col("response_time_p99") > p99_ms) | (F.col("error_rate") > error_rate))
    seq = SQ.sequenced(df.withColumn("_bad", F.coalesce(bad, F.lit(False)).cast("int")),
                       before=0, after=run - 1 + lookahead, chunk_rows=chunk_rows)
    w = SQ.halo_window()
    ahead = w.rowsBetween(0, run - 1)
    s = seq.withColumn("streak_start", ((F.min("_bad").over(ahead) == 1)
                                        & (F.count(F.lit(1)).over(ahead) == run)).cast("int"))
    s = s.withColumn("failure_target",
                     F.coalesce(F.max("streak_start").over(w.rowsBetween(1, lookahead)), F.lit(0)).cast("int"))
    return SQ.finish(s).drop("_bad")


def latest_features(features: DataFrame, min_rows: int = S.FEATURE_MIN_ROWS,
                    history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Last feature row per service -> (ready rows, rejected services).

    A service is rejected when it has fewer than ``min_rows`` history rows or
    its last row has a null feature (D9: rejected services fall back to the
    heuristics instead of failing).
    """
    cols = [c for c in features.columns if c != "service_id"]
    last = features.groupBy("service_id").agg(
        F.max_by(F.struct(*cols), F.col("window_start")).alias("_r"),
        F.count(F.lit(1)).alias("history_rows")).select("service_id", "history_rows", "_r.*")
    complete = F.lit(True)
    for c in S.FEATURE_COLUMNS:
        complete = complete & F.col(c).isNotNull()
    ok = (F.col("history_rows") >= min_rows) & complete
    ready = last.filter(ok)
    rejected = last.filter(~ok).select(
        "service_id", "history_rows",
        F.when(F.col("history_rows") < min_rows, F.lit("insufficient-history"))
        .otherwise(F.lit("null-features")).alias("reason"))
    return ready, rejected


def join_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join ground-truth labels on (service, window); missing -> false."""
    lab = labels.select("service_id", "window_start", "is_anomaly")
    return df.join(lab, ["service_id", "window_start"], "left") \
        .withColumn("is_anomaly", F.coalesce(F.col("is_anomaly"), F.lit(False)))


def chrono_cut(df: DataFrame, test_frac: float = 0.2, ts: str = "window_start") -> DataFrame:
    """The cut timestamp of a chronological split, as a one-row frame.

    Counts per timestamp (one row per distinct window, small), running sum,
    first timestamp whose preceding count reaches ``int(n * (1 - test_frac))``.
    No global row sort of the data itself.
    """
    per_ts = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    tot = per_ts.agg(F.sum("_n").alias("_total"))
    cum = per_ts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))) \
        .crossJoin(F.broadcast(tot))  # one-row side
    cut_pos = F.floor(F.col("_total") * (1.0 - test_frac))
    return cum.filter(F.col("_before") + F.col("_n") > cut_pos).agg(
        F.min(ts).alias("cut_ts"), F.first("_total").alias("total_rows"))


def chrono_split(df: DataFrame, test_frac: float = 0.2, ts: str = "window_start") -> tuple[DataFrame, DataFrame]:
    cut = F.broadcast(chrono_cut(df, test_frac, ts).select("cut_ts"))  # one-row side
    tagged = df.crossJoin(cut)
    train = tagged.filter(F.col(ts) < F.col("cut_ts")).drop("cut_ts")
    test = tagged.filter(F.col(ts) >= F.col("cut_ts")).drop("cut_ts")
    return train, test
