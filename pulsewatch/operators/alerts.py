"""Alert lifecycle and alert contexts (J4 batch, E2-E4, H2, I1, I2, G7, K11-K13).

Lifecycle rule (evaluated once per window, per service):
  * latency fires when p99 > 2000 ms, else error rate when > 0.10;
    severity is critical above twice the threshold, else high;
  * an alert opens unless one is already open for (service, trigger);
  * every open alert of a service that does not breach in the window (or has
    no row in it) closes.
Replayed in batch this is gaps-and-islands: an *island* is a maximal run of
consecutive breaching windows of a service; inside it each trigger opens at
most once (at its first firing window) and everything closes one step after
the island ends; an island that reaches the last evaluated window stays open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import exprs as X
from ..ml import heuristics as H
from ..sources import io as IO
from . import sequence as SQ


def trigger_of(p99: Column, err: Column, p99_ms=S.ALERT_P99_MS, error_rate=S.ALERT_ERROR_RATE) -> Column:
    """Latency first, else error rate, else null (C14: null metric reads as 0)."""
    p, e = F.coalesce(p99.cast("double"), F.lit(0.0)), F.coalesce(err.cast("double"), F.lit(0.0))
    return F.when(p > p99_ms, F.lit("latency")).when(e > error_rate, F.lit("error_rate"))


def severity_of(trigger: Column, p99: Column, err: Column, p99_ms=S.ALERT_P99_MS,
                error_rate=S.ALERT_ERROR_RATE) -> Column:
    p, e = p99.cast("double"), err.cast("double")
    return (F.when(trigger == "latency", F.when(p > 2 * p99_ms, "critical").otherwise("high"))
            .when(trigger == "error_rate", F.when(e > 2 * error_rate, "critical").otherwise("high")))


def alert_id(service: Column, trigger: Column, opened_at: Column) -> Column:
    return IO.event_id("alert", [service, trigger, opened_at.cast("string")])


def alert_lifecycle(metrics: DataFrame, window_size: str = "1m", p99_ms: float = S.ALERT_P99_MS,
                    error_rate: float = S.ALERT_ERROR_RATE, until: Column | None = None) -> DataFrame:
    """Replay the per-window open/close rule over a metrics table.

    ``until`` is the last evaluated window start (default: the newest window in
    the data); alerts still breaching then have ``closed_at`` null.
    Island numbering uses the bucketed row index (no per-service window); one
    aggregation by island.
    """
    step_us = S.WINDOW_MINUTES[window_size] * 60_000_000
    m = metrics.filter(F.col("window_size") == window_size)
    if until is None:
        last = m.agg(F.max("window_start").alias("_until"))
        until_df = last
    else:
        until_df = m.sparkSession.range(1).select(until.alias("_until"))
    trig = trigger_of(F.col("response_time_p99"), F.col("error_rate"), p99_ms, error_rate)
    bad = m.select("service_id", "window_start", "response_time_p99", "error_rate",
                   trig.alias("trigger")).filter(F.col("trigger").isNotNull())
    # global per-service position among breaching rows, from (service, day)
    # buckets + offsets: no window ever holds a whole service
    bad = SQ.row_index(bad, "service_id", "window_start")
    bad = bad.withColumn("_island", F.unix_micros("window_start") - F.col("_idx") * F.lit(step_us)).drop("_idx")

    def first_fire(t: str):
        on = F.col("trigger") == t
        return F.min_by(F.when(on, F.struct("window_start", "response_time_p99", "error_rate")),
                        F.when(on, F.col("window_start"))).alias(t)

    islands = bad.groupBy("service_id", "_island").agg(
        F.max("window_start").alias("_end"), first_fire("latency"), first_fire("error_rate"))
    opened = islands.select(
        "service_id", "_end",
        F.inline(F.array(
            F.struct(F.lit("latency").alias("triggering_metric"), F.col("latency").alias("o")),
            F.struct(F.lit("error_rate").alias("triggering_metric"), F.col("error_rate").alias("o")))),
    ).filter(F.col("o").isNotNull())
    # one-row side: the last evaluated window
    opened = opened.crossJoin(F.broadcast(until_df))
    step = F.make_dt_interval(mins=F.lit(S.WINDOW_MINUTES[window_size]))
    t = F.col("triggering_metric")
    return opened.select(
        alert_id(F.col("service_id"), t, F.col("o.window_start")).alias("id"),
        "service_id",
        "triggering_metric",
        severity_of(t, F.col("o.response_time_p99"), F.col("o.error_rate"), p99_ms, error_rate).alias("severity"),
        F.lit(None).cast("string").alias("priority"),
        X.alert_message(t, F.col("o.response_time_p99"), F.col("o.error_rate"), p99_ms, error_rate).alias("message"),
        F.col("o.window_start").alias("opened_at"),
        F.when(F.col("_end") < F.col("_until"), F.col("_end") + step).alias("closed_at"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("string").alias("metadata"),
    )


def alert_step(open_alerts: DataFrame, window_rows: DataFrame, p99_ms: float = S.ALERT_P99_MS,
               error_rate: float = S.ALERT_ERROR_RATE) -> tuple[DataFrame, DataFrame]:
    """One evaluation of the rule for the rows of one closed window.

    Returns (alerts to open, alerts to close).  E4: open only when no open
    alert exists for (service, trigger) -- a ``left_anti`` join.  E3: close
    every open alert whose service is not in the breaching set -- another
    ``left_anti`` join (written directly, not as a null-aware NOT IN).
    """
    trig = trigger_of(F.col("response_time_p99"), F.col("error_rate"), p99_ms, error_rate)
    fired = window_rows.withColumn("triggering_metric", trig).filter(F.col("triggering_metric").isNotNull())
    still_open = open_alerts.filter(F.col("closed_at").isNull())
    new = fired.join(still_open.select("service_id", "triggering_metric"),
                     ["service_id", "triggering_metric"], "left_anti")
    t = F.col("triggering_metric")
    to_open = new.select(
        alert_id(F.col("service_id"), t, F.col("window_start")).alias("id"),
        "service_id", "triggering_metric",
        severity_of(t, F.col("response_time_p99"), F.col("error_rate"), p99_ms, error_rate).alias("severity"),
        F.lit(None).cast("string").alias("priority"),
        X.alert_message(t, F.col("response_time_p99"), F.col("error_rate"), p99_ms, error_rate).alias("message"),
        F.col("window_start").alias("opened_at"),
        F.lit(None).cast("timestamp").alias("closed_at"),
        F.lit(None).cast("string").alias("resolved_by"),
        F.lit(None).cast("string").alias("metadata"),
    )
    breaching = fired.select("service_id").distinct()
    to_close = still_open.join(breaching, "service_id", "left_anti")
    return to_open, to_close


def open_alerts(alerts: DataFrame, limit: int = S.OPEN_ALERTS_DEFAULT_LIMIT) -> DataFrame:
    """Open alerts newest first, limit clamped to 1..200.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its
    own top ``limit`` and only those reach the final merge.
    """
    n = max(1, min(S.OPEN_ALERTS_MAX_LIMIT, int(limit)))
    return alerts.filter(F.col("closed_at").isNull()) \
        .orderBy(F.col("opened_at").desc(), F.col("service_id"), F.col("triggering_metric"), F.col("id")) \
        .limit(n)


# ---- alert contexts for prioritisation ---------------------------------------------

def stable_pct(*cols: Column) -> Column:
    """0..99 from SHA-256 of the key: repartition-safe sampling."""
    h = F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(100))


TRIGGER_ORDER = {"latency": 0, "error_rate": 1, "availability": 2}


def alert_candidates(metrics: DataFrame, services: DataFrame | None = None,
                     sample_pct: int = S.AVAILABILITY_SAMPLE_PCT) -> DataFrame:
    """Candidate alert contexts from metric rows.

    Latency candidates (p99 > 2000), error-rate candidates (> 0.10) and a
    stable 5 % hash sample of latency candidates relabelled availability,
    unioned (a row can appear in several).  One scan, one ``inline``.
    """
    base = metrics
    if services is not None:
        names = services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"))
        base = base.join(names, "service_id", "left")
    if "service_name" not in base.columns:
        base = base.withColumn("service_name", F.lit(None).cast("string"))
    base = base.withColumn("service_name", F.coalesce(F.col("service_name"), F.lit("unknown")))
    p99 = F.col("response_time_p99").cast("double")
    err = F.col("error_rate").cast("double")
    lat = p99 > S.ALERT_P99_MS
    avail = lat & (stable_pct(F.col("service_id"), F.col("window_start")) < sample_pct)
    kinds = F.filter(F.array(
        F.when(lat, F.lit("latency")),
        F.when(err > S.ALERT_ERROR_RATE, F.lit("error_rate")),
        F.when(avail, F.lit("availability"))), lambda x: x.isNotNull())
    out = base.select("*", F.explode(kinds).alias("triggering_metric"))
    order = F.when(F.col("triggering_metric") == "latency", 0) \
        .when(F.col("triggering_metric") == "error_rate", 1).otherwise(2)
    return out.withColumn("trigger_order", order) \
        .withColumn("hour_of_day", F.hour("window_start")) \
        .withColumn("current_health_score", H.quick_health(out)) \
        .withColumn("failure_prediction_active", X.is_severe()) \
        .withColumn("service_is_payment_or_auth", X.is_payment_or_auth(F.col("service_name")))


def alert_frequency(df: DataFrame, hours: int = 24, ts: str = "window_start",
                    order: str = "trigger_order") -> DataFrame:
    """Alerts of the same service in the left-open window ``(t - hours, t]``
    before this one, ties counted in row order (G7).

    RANGE frames include all peers, so later peers are subtracted: both
    windows cluster by service, so they share one shuffle.
    """
    span = hours * 3600 * 1_000_000 - 1
    # Time chunks of ``hours`` with a one-chunk halo: rows of chunk c are
    # copied into chunk c + 1 as context, so every frame (t - hours, t] lies
    # inside one (service, chunk) partition; a busy service spreads over its
    # chunks instead of one task.  Copies are dropped after the window.
    chunk = F.floor(F.unix_micros(ts) / F.lit(hours * 3600 * 1_000_000)).cast("long")
    x = df.select("*", F.inline(F.array(F.struct(chunk.alias("_chunk"), F.lit(False).alias("_ctx")),
                                        F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_ctx")))))
    part = ["service_id", "_chunk"]
    w_range = Window.partitionBy(*part).orderBy(F.unix_micros(ts)).rangeBetween(-span, 0)
    w_peer = Window.partitionBy(*part, ts)
    w_peer_ord = Window.partitionBy(*part, ts).orderBy(order)
    later_peers = F.count(F.lit(1)).over(w_peer) - F.row_number().over(w_peer_ord)
    freq = F.count(F.lit(1)).over(w_range) - later_peers - 1
    out = x.withColumn("alert_frequency_24h", F.greatest(freq, F.lit(0)).cast("int"))
    return out.filter(~F.col("_ctx")).drop("_chunk", "_ctx")


def label_priority(df: DataFrame) -> DataFrame:
    """Heuristic ground-truth priority (K13) and one-hot trigger."""
    out = H.heuristic_priority(df).drop("rationale")
    return out.select("*", *X.one_hot("triggering_metric", S.TRIGGERS))
