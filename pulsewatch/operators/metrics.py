"""Window metrics, latest rows, history reads.

Scale notes
-----------
* ``aggregate_windows`` first counts the raw logs by (service, smallest common
  window, latency, error flag), a hash aggregate combined map-side; the counts
  alone are expanded to the window sizes.  Histograms add up exactly, so one
  pass over the logs serves all sizes, and a hot (service, window) arrives as
  at most its distinct latencies.
* Exact percentiles use Spark's ``percentile`` (linear interpolation, the same
  as ``percentile_cont``) weighted by those counts.  ``exact=False`` switches
  to ``percentile_approx`` (fixed-size sketch) over the raw rows.
* Latest-per-service is a ``max_by`` over a struct: Spark plans it as a sort
  aggregate, partial before the shuffle, so one row per service and task moves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import exprs as X


def _window_pairs_sql(ts: str, sizes) -> str:
    us = f"unix_micros({ts})"
    pairs = [f"named_struct('window_size', '{s}', 'window_start', "
             f"timestamp_micros({us} - pmod({us}, {S.WINDOW_MINUTES[s] * 60_000_000}L)))" for s in sizes]
    return f"inline(array({', '.join(pairs)}))"


COUNTS = "service_id string, base_start timestamp, rt int, err int, k long"
_COLUMNS = ("service_id", "CAST(response_time_ms AS INT) AS rt", "CAST(coalesce(status_code, 0) >= 400 AS INT) AS err")


def window_counts(api_logs: DataFrame, minutes: int = 1) -> DataFrame:
    """The exact latency histogram of every (service, window of ``minutes``):
    rows (service_id, base_start, rt, err, k), k logs with that latency and
    error flag.  Histograms of parts of the logs add up: their rows together are
    the histogram of the whole."""
    us, base = "unix_micros(request_timestamp)", minutes * 60_000_000
    return api_logs.selectExpr(*_COLUMNS, f"timestamp_micros({us} - pmod({us}, {base}L)) AS base_start") \
        .groupBy("service_id", "base_start", "rt", "err").agg(F.expr("count(1)").alias("k"))


def windows_from_counts(counts: DataFrame, sizes=S.WINDOW_SIZES, computed_at: Column | None = None) -> DataFrame:
    """Metric rows of ``sizes`` from histograms of windows that divide them
    (F1-F3): no raw log is read again, and percentiles are exact."""
    agg = counts.selectExpr("service_id", "rt", "err", "k", _window_pairs_sql("base_start", sizes)) \
        .groupBy("service_id", "window_size", "window_start").agg(
            F.expr("sum(k)").alias("n"), F.expr("sum(rt * k)").alias("rt_sum"),
            F.expr("sum(CASE WHEN rt IS NOT NULL THEN k ELSE 0 END)").alias("rt_n"), F.expr("sum(err * k)").alias("n_err"),
            F.expr("percentile(rt, array(0.95D, 0.99D), k)").alias("pct"))
    return _metric_rows(agg, sizes, computed_at)


def aggregate_windows(api_logs: DataFrame, sizes=S.WINDOW_SIZES, exact: bool = True,
                      computed_at: Column | None = None) -> DataFrame:
    """api_logs -> metrics rows for each window size in ``sizes``.

    Half-open ``[start, start + size)`` UTC windows; silent services emit no row.
    Projections are SQL expressions (one JVM round trip per column).
    """
    if exact:
        # one hash aggregate over the raw logs, to counts per smallest common
        # window, latency and error flag; only those are expanded to the sizes
        return windows_from_counts(window_counts(api_logs, math.gcd(*[S.WINDOW_MINUTES[s] for s in sizes])), sizes, computed_at)
    agg = api_logs.selectExpr(*_COLUMNS, _window_pairs_sql("request_timestamp", sizes)) \
        .groupBy("service_id", "window_size", "window_start").agg(
            F.expr("count(1)").alias("n"), F.expr("sum(rt)").alias("rt_sum"), F.expr("count(rt)").alias("rt_n"), F.expr("sum(err)").alias("n_err"),
            F.expr("CAST(percentile_approx(rt, array(0.95D, 0.99D), 10000) AS ARRAY<DOUBLE>)").alias("pct"))
    return _metric_rows(agg, sizes, computed_at)


def _metric_rows(agg: DataFrame, sizes, computed_at: Column | None) -> DataFrame:
    minutes = "CASE window_size " + " ".join(f"WHEN '{s}' THEN {S.WINDOW_MINUTES[s]}" for s in sizes) + " ELSE 1 END"
    out = agg.selectExpr(
        "service_id",
        "window_start",
        f"window_start + make_dt_interval(0, 0, {minutes}, 0) AS window_end",
        "window_size",
        "CAST(n AS INT) AS request_count",
        f"{X.half_up_sql('n', minutes, 2, 10)} AS rpm",
        f"{X.half_up_sql('rt_sum', 'rt_n', 2, 10)} AS response_time_mean",
        "CAST(round(pct[0], 2) AS DECIMAL(10,2)) AS response_time_p95",
        "CAST(round(pct[1], 2) AS DECIMAL(10,2)) AS response_time_p99",
        f"{X.half_up_sql('n_err', 'n', 4, 5)} AS error_rate",
        f"{X.half_up_sql('n - n_err', 'n', 4, 5)} AS success_rate",
        "CAST(NULL AS DECIMAL(5,2)) AS cpu_usage_pct",
        "CAST(NULL AS DECIMAL(5,2)) AS memory_usage_pct",
    )
    return out.withColumn("computed_at", computed_at if computed_at is not None else F.current_timestamp())


def window_metrics(api_logs: DataFrame, size: str = "1m", exact: bool = True) -> DataFrame:
    return aggregate_windows(api_logs, sizes=(size,), exact=exact)


def in_range(df: DataFrame, since=None, until=None, col: str = "window_start") -> DataFrame:
    """Half-open ``[since, until)``."""
    if since is not None:
        df = df.filter(F.col(col) >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.filter(F.col(col) < F.lit(until).cast("timestamp"))
    return df


def latest_per_service(metrics: DataFrame, window_size: str = "1m",
                       service_id: str | None = None) -> DataFrame:
    """Latest row per service of one window size (G1, P7, L6); a hash aggregate
    with ``max_by`` (partial aggregation, no full sort)."""
    df = metrics.filter(F.col("window_size") == window_size)
    if service_id is not None:
        df = df.filter(F.col("service_id") == service_id)
    cols = [c for c in df.columns if c != "service_id"]
    latest = df.groupBy("service_id").agg(
        F.max_by(F.struct(*cols), F.col("window_start")).alias("_r"))
    return latest.select("service_id", "_r.*")


def history(metrics: DataFrame, service_id: str, since, until, window_size: str = "1m") -> DataFrame:
    """One service's rows in ``[since, until)`` ordered by window start (H1)."""
    df = metrics.filter((F.col("service_id") == service_id) & (F.col("window_size") == window_size))
    return in_range(df, since, until).orderBy("window_start")


def recent(metrics: DataFrame, now: Column | None = None, hours: int = S.HISTORY_HOURS,
           window_size: str = "1m") -> DataFrame:
    """Rows from ``date_trunc('minute', now) - hours`` on (H4).  ``now`` defaults
    to the newest window start in the data (replayable)."""
    df = metrics.filter(F.col("window_size") == window_size)
    if now is None:
        top = df.agg(F.max("window_start").alias("_now"))
        df = df.crossJoin(F.broadcast(top))  # one-row side
        now = F.col("_now")
    start = F.date_trunc("minute", now) - F.make_dt_interval(hours=F.lit(hours))
    return df.filter(F.col("window_start") >= start).drop("_now")


def history_counts(metrics: DataFrame) -> DataFrame:
    """Rows per (service, window size) (F8)."""
    return metrics.groupBy("service_id", "window_size").agg(F.count(F.lit(1)).alias("history_rows"))


def load_summary(metrics: DataFrame) -> DataFrame:
    """Row count and distinct services."""
    return metrics.agg(F.count(F.lit(1)).alias("rows"),
                       F.countDistinct("service_id").alias("services"))


def fill_gaps(metrics: DataFrame, window_size: str = "1m") -> DataFrame:
    """Add zero-traffic rows for silent windows between a service's first and
    last window (F9, opt-in).  The minute grid is generated per service span
    by ``sequence`` (one row per grid step, distributed by service)."""
    step = S.WINDOW_MINUTES[window_size]
    df = metrics.filter(F.col("window_size") == window_size)
    spans = df.groupBy("service_id").agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi"))
    # cut each span into calendar months and spread the (service, month)
    # pieces over tasks before generating the grid, so no single task
    # generates a long history (window sizes divide a month evenly)
    months = spans.select("service_id", "lo", "hi", F.explode(F.sequence(
        F.date_trunc("month", "lo"), F.date_trunc("month", "hi"), F.expr("INTERVAL 1 MONTH"))).alias("_m"))
    n_pieces = max(1, df.sparkSession.sparkContext.defaultParallelism)
    pieces = months.repartition(n_pieces, "service_id", "_m").select(
        "service_id",
        F.greatest("lo", "_m").alias("_a"),
        F.least("hi", F.col("_m") + F.expr("INTERVAL 1 MONTH") - F.make_dt_interval(mins=F.lit(step))).alias("_b"))
    grid = pieces.select("service_id", F.explode(F.sequence("_a", "_b", F.make_dt_interval(mins=F.lit(step))))
                         .alias("window_start"))
    filled = grid.join(df, ["service_id", "window_start"], "left")
    return filled.select(
        "service_id", "window_start",
        F.coalesce("window_end", F.col("window_start") + F.make_dt_interval(mins=F.lit(step))).alias("window_end"),
        F.lit(window_size).alias("window_size"),
        F.coalesce("request_count", F.lit(0)).alias("request_count"),
        F.coalesce("rpm", F.lit(0).cast("decimal(10,2)")).alias("rpm"),
        "response_time_mean", "response_time_p95", "response_time_p99",
        F.coalesce("error_rate", F.lit(0).cast("decimal(5,4)")).alias("error_rate"),
        "success_rate", "cpu_usage_pct", "memory_usage_pct",
        F.col("request_count").isNull().alias("is_gap"),
    )


def snapshot(df: DataFrame) -> DataFrame:
    """Inference snapshot projection: window_start -> timestamp, numerics as
    double with 0 defaults (C16)."""
    return df.select(
        "service_id",
        F.col("window_start").alias("timestamp"),
        F.coalesce(F.col("request_count"), F.lit(0)).alias("request_count"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
          for c in ("response_time_mean", "response_time_p95", "response_time_p99", "error_rate")],
        F.col("cpu_usage_pct").cast("double").alias("cpu_usage_pct"),
        F.col("memory_usage_pct").cast("double").alias("memory_usage_pct"),
    )
