"""Row-wise scores that need no model.

All are single projections of built-in expressions: they run inside the scan
stage, with no shuffle, and are checked against SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import exprs as X


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def health_score(df: DataFrame, stability: Column | None = None) -> DataFrame:
    """Composite health 0..100 with components.

    .30 error + .30 latency (p99 / 5000) + .20 traffic (default .5) + .20
    resource; without cpu and memory the first three are renormalised by .8
    and the resource component is 0.
    """
    W = S.HEALTH_WEIGHTS
    err_c = F.greatest(F.lit(0.0), 1.0 - F.coalesce(_d("error_rate"), F.lit(0.0)))
    lat_c = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0),
                                                 F.coalesce(_d("response_time_p99"), F.lit(0.0)) / S.HEALTH_LATENCY_CEIL_MS))
    traffic = stability if stability is not None else (
        F.col("traffic_stability") if "traffic_stability" in df.columns else F.lit(None).cast("double"))
    tr_c = F.coalesce(traffic.cast("double"), F.lit(S.HEALTH_TRAFFIC_DEFAULT))
    cpu = _d("cpu_usage_pct") if "cpu_usage_pct" in df.columns else F.lit(None).cast("double")
    mem = _d("memory_usage_pct") if "memory_usage_pct" in df.columns else F.lit(None).cast("double")
    no_res = cpu.isNull() & mem.isNull()
    res_c = F.when(no_res, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.greatest(F.coalesce(cpu, F.lit(0.0)) / 100.0,
                                                F.coalesce(mem, F.lit(0.0)) / 100.0)))
    three = W["error"] * err_c + W["latency"] * lat_c + W["traffic"] * tr_c
    weighted = F.when(no_res, three / (W["error"] + W["latency"] + W["traffic"])) \
        .otherwise(three + W["resource"] * res_c)
    out = df.withColumn("_e", err_c).withColumn("_l", lat_c).withColumn("_t", tr_c) \
        .withColumn("_r", res_c).withColumn("health_score", 100.0 * weighted)
    return out.withColumn("health_status", X.health_status(F.col("health_score"))) \
        .withColumn("components", F.struct(F.col("_e").alias("error"), F.col("_l").alias("latency"),
                                           F.col("_t").alias("traffic"), F.col("_r").alias("resource"))) \
        .drop("_e", "_l", "_t", "_r")


def traffic_stability(metrics: DataFrame, rows: int = 60) -> DataFrame:
    """Optional stability ``1 - min(1, stddev/mean)`` of rpm over the last
    ``rows`` rows per service (D7); chunked per service (``operators.sequence``)."""
    from ..operators import sequence as SQ
    seq = SQ.sequenced(metrics, before=rows - 1)
    w = SQ.halo_window().rowsBetween(-(rows - 1), 0)
    m = F.avg(_d("rpm")).over(w)
    sd = F.stddev_samp(_d("rpm")).over(w)
    return SQ.finish(seq.withColumn("traffic_stability",
                                    F.when(m > 0, 1.0 - F.least(F.lit(1.0), F.coalesce(sd, F.lit(0.0)) / m))))


def quick_health(df: DataFrame) -> Column:
    """``100 (.6 err_ok + .4 lat_ok)`` used in alert contexts."""
    we, wl = S.QUICK_HEALTH_WEIGHTS
    err_ok = F.greatest(F.lit(0.0), 1.0 - F.coalesce(_d("error_rate"), F.lit(0.0)))
    lat_ok = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), F.coalesce(_d("response_time_p99"), F.lit(0.0)) / 5000.0))
    return 100.0 * (we * err_ok + wl * lat_ok)


def heuristic_anomaly(df: DataFrame, contamination: float = S.ANOMALY_CONTAMINATION_DEFAULT) -> DataFrame:
    """``min(1, max(p99/5000, error_rate))``, anomalous at >= 1 - contamination."""
    score = F.least(F.lit(1.0), F.greatest(_d("response_time_p99") / 5000.0, _d("error_rate")))
    return df.withColumn("anomaly_score", score) \
        .withColumn("is_anomaly", F.col("anomaly_score") >= (1.0 - contamination)) \
        .withColumn("contamination", F.lit(float(contamination)))


def normalised_anomaly(raw: Column, floor: Column, ceil: Column | float = 0.0) -> Column:
    """Map an isolation score (higher = normal) into 0..1, 1 = most anomalous."""
    ceil_c = ceil if isinstance(ceil, Column) else F.lit(float(ceil))
    return F.when(ceil_c <= floor, F.lit(0.5)).otherwise(
        X.clamp(1.0 - (raw - floor) / (ceil_c - floor)))


def heuristic_failure(metrics: DataFrame, recent_rows: int = S.FAILURE_RECENT_ROWS,
                      threshold: float = 0.5) -> DataFrame:
    """Per service: ``min(1, .5 mean(err) + .5 share(p99 > 2000))`` over its last
    ``recent_rows`` rows (K18, F7), with risk tier (K21).

    ``row_number <= n`` over a per-service descending window: Spark plans a
    WindowGroupLimit, so each task keeps only n rows per service before the
    shuffle; only n rows per service ever reach the final window.
    """
    w = Window.partitionBy("service_id").orderBy(F.col("window_start").desc())
    last = metrics.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= recent_rows)
    agg = last.groupBy("service_id").agg(
        F.avg(_d("error_rate")).alias("mean_error_rate"),
        F.avg((_d("response_time_p99") > S.ALERT_P99_MS).cast("double")).alias("p99_breach_share"),
        F.count(F.lit(1)).alias("history_rows"),
        F.max("window_start").alias("as_of"),
    )
    p = F.least(F.lit(1.0), 0.5 * F.col("mean_error_rate") + 0.5 * F.col("p99_breach_share"))
    return agg.withColumn("failure_probability", p) \
        .withColumn("risk_level", X.risk_level(F.col("failure_probability"), threshold))


def naive_forecast(latest: DataFrame) -> DataFrame:
    """Last request count, floored at 0."""
    return latest.withColumn("predicted_rpm",
                             F.greatest(F.lit(0.0), F.col("request_count").cast("double")))


def base_priority(trigger: Column, health: Column, freq: Column) -> Column:
    return (F.when(trigger == "availability", "high")
            .when(health.isNotNull() & (health < S.ALERT_HEALTH_HIGH_BELOW), "high")
            .when(freq >= S.ALERT_FREQUENCY_MEDIUM, "medium")
            .otherwise("low"))


def heuristic_priority(df: DataFrame) -> DataFrame:
    """Priority + rationale without a model (K20); same rule as the label."""
    base = base_priority(F.col("triggering_metric"), F.col("current_health_score"),
                         F.col("alert_frequency_24h"))
    fail = F.coalesce(F.col("failure_prediction_active"), F.lit(False))
    pay = F.coalesce(F.col("service_is_payment_or_auth"), F.lit(False))
    return df.withColumn("_base", base).withColumn(
        "priority", F.when(fail, "critical").when(pay, X.escalate(F.col("_base"))).otherwise(F.col("_base"))
    ).withColumn(
        "rationale",
        F.when(fail, F.lit(S.RATIONALE_FAILURE))
        .when(pay, F.concat(F.col("_base"), F.lit(S.RATIONALE_ESCALATED)))
        .otherwise(F.lit(S.RATIONALE_BASE)),
    ).drop("_base")


def rolling_failure_probability(df: DataFrame, rows: int = S.FAILURE_RECENT_ROWS,
                                chunk_rows: int | None = None) -> DataFrame:
    """K18 evaluated at every row: the heuristic over the ``rows`` rows ending
    at this one (``failure_probability``), for back-testing the heuristic."""
    from ..operators import sequence as SQ
    seq = SQ.sequenced(df, before=rows - 1, chunk_rows=chunk_rows if chunk_rows else SQ.DEFAULT_CHUNK_ROWS)
    w = SQ.halo_window().rowsBetween(-(rows - 1), 0)
    p = F.least(F.lit(1.0), 0.5 * F.avg(_d("error_rate")).over(w)
                + 0.5 * F.avg((_d("response_time_p99") > S.ALERT_P99_MS).cast("double")).over(w))
    return SQ.finish(seq.withColumn("failure_probability", F.round(p, 9)))
