"""Dashboard read models (L1-L6), as-of prediction lookup (E9), episode
labelling (E10).  Each tile is one plan over all services (the product calls
the scorer once per service over HTTP; here it is a join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import exprs as X
from ..ml import heuristics as H
from . import alerts as AL
from . import metrics as M


def _history_in(metrics: DataFrame, hours: int, window_size: str) -> DataFrame:
    """Rows per service within ``hours`` before each service's newest window."""
    m = metrics.filter(F.col("window_size") == window_size)
    newest = m.agg(F.max("window_start").alias("_now"))
    start = F.date_trunc("minute", F.col("_now")) - F.make_dt_interval(hours=F.lit(hours))
    recent = m.crossJoin(F.broadcast(newest)).filter(F.col("window_start") >= start)  # one-row side
    return recent.groupBy("service_id").agg(F.count(F.lit(1)).alias("history_rows_26h"))


def health_tile(metrics: DataFrame, window_size: str = "1m") -> DataFrame:
    """L1: latest metrics + composite health per service."""
    return H.health_score(M.latest_per_service(metrics, window_size))


def latency_tile(metrics: DataFrame, window_size: str = "1m") -> DataFrame:
    """L3: mean / p95 / p99 of the latest window per service."""
    return M.latest_per_service(metrics, window_size).select(
        "service_id", "window_start", F.col("response_time_mean").alias("mean"),
        F.col("response_time_p95").alias("p95"), F.col("response_time_p99").alias("p99"))


def traffic_tile(metrics: DataFrame, horizon: int = 60, window_size: str = "1m",
                 min_history: int = S.TRAFFIC_MIN_HISTORY, hours: int = S.HISTORY_HOURS,
                 forecasts: DataFrame | None = None) -> DataFrame:
    """L2: latest rpm + forecast (model rows if given, else naive), gated on
    ``min_history`` rows in the last ``hours``; delta and direction (C19)."""
    latest = M.latest_per_service(metrics, window_size)
    hist = _history_in(metrics, hours, window_size)
    t = latest.join(hist, "service_id", "left").fillna(0, ["history_rows_26h"])
    if forecasts is not None:
        t = t.join(forecasts.select("service_id", F.col("predicted_rpm").alias("_model")), "service_id", "left")
        fc = F.coalesce(F.col("_model"), F.greatest(F.lit(0.0), F.col("request_count").cast("double")))
    else:
        fc = F.greatest(F.lit(0.0), F.col("request_count").cast("double"))
    ok = F.col("history_rows_26h") >= min_history
    t = t.withColumn("forecast_rpm", F.when(ok, fc)) \
        .withColumn("forecast_status", F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient-history"))) \
        .withColumn("horizon_minutes", F.lit(horizon)) \
        .withColumn("delta", F.col("forecast_rpm") - F.col("rpm").cast("double"))
    return t.withColumn("direction", X.direction(F.col("delta")))


def stored_answers(probes: DataFrame, predictions: DataFrame, module: str, max_age_minutes: int = S.PREDICTION_MAX_AGE_MIN) -> DataFrame:
    """(service_id, answer, source, stale): per probe (service_id, at) the newest
    stored prediction of ``module`` generated in ``(at - max_age, at]``.  It is
    stale when it was generated before ``at``.  Services without one have no row.

    One row a service on the probe side, so each prediction meets one probe and
    the newest is a partial aggregate."""
    oldest = F.col("at") - F.make_dt_interval(mins=F.lit(max_age_minutes))
    p = predictions.filter(F.col("module") == module).select("service_id", "generated_at", "model_version", "value")
    near = p.join(probes.select("service_id", "at"), "service_id").filter((F.col("generated_at") <= F.col("at")) & (F.col("generated_at") > oldest))
    best = near.groupBy("service_id", "at").agg(F.max(F.struct("generated_at", "model_version", "value")).alias("b"))
    return best.select("service_id", F.col("b.value").alias("answer"), F.col("b.model_version").alias("source"), (F.col("b.generated_at") < F.col("at")).alias("stale"))


def predictions_tile(metrics: DataFrame, window_size: str = "1m",
                     min_history: int = S.FAILURE_MIN_HISTORY, hours: int = S.HISTORY_HOURS,
                     predictions: DataFrame | None = None, max_age_minutes: int = S.PREDICTION_MAX_AGE_MIN) -> DataFrame:
    """Anomaly of the latest window + failure risk over recent history.

    With ``predictions`` (stored rows, A10) the newest answer of each module at
    the end of the latest window is shown, with its model version and whether it
    is stale; the heuristics answer for the rest."""
    latest = H.heuristic_anomaly(M.latest_per_service(metrics, window_size))
    fail = H.heuristic_failure(metrics.filter(F.col("window_size") == window_size))
    hist = _history_in(metrics, hours, window_size)
    t = latest.join(hist, "service_id", "left").fillna(0, ["history_rows_26h"]) \
        .join(fail.select("service_id", "failure_probability", "risk_level"), "service_id", "left")
    ok = F.col("history_rows_26h") >= min_history
    t = t.withColumn("failure_probability", F.when(ok, F.col("failure_probability"))) \
        .withColumn("risk_level", F.when(ok, F.col("risk_level"))) \
        .withColumn("failure_status", F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient-history")))
    if predictions is None:
        return t
    probes = t.select("service_id", F.col("window_end").alias("at"))
    answers = {"anomaly": {"anomaly_score": "double", "is_anomaly": "boolean"}, "failure": {"failure_probability": "double", "risk_level": "string"}}
    for module, fields in answers.items():
        found = stored_answers(probes, predictions, module, max_age_minutes).select(
            "service_id", *[F.get_json_object("answer", f"$.{f}").cast(k).alias(f"_{f}") for f, k in fields.items()],
            F.col("source").alias(f"{module}_source"), F.col("stale").alias(f"{module}_stale"))
        t = t.join(found, "service_id", "left")
        use = F.col(f"{module}_source").isNotNull() & (ok if module == "failure" else F.lit(True))
        for f in fields:
            t = t.withColumn(f, F.when(use, F.col(f"_{f}")).otherwise(F.col(f))).drop(f"_{f}")
        t = t.withColumn(f"{module}_source", F.when(use, F.col(f"{module}_source")).otherwise(F.lit(S.HEURISTIC_MODEL_VERSION))) \
            .withColumn(f"{module}_stale", F.coalesce(F.when(use, F.col(f"{module}_stale")), F.lit(False)))
    return t


def alerts_tile(alerts: DataFrame, metrics: DataFrame, services: DataFrame, window_size: str = "1m",
                limit: int = S.OPEN_ALERTS_DEFAULT_LIMIT, reference_context: bool = False,
                predictions: DataFrame | None = None) -> DataFrame:
    """Open alerts (newest first) with a priority.

    With ``predictions`` (stored rows of module ``alerts``) an alert takes the
    priority predicted for its service, metric and opening time, the newest model
    version's if there are several; ``priority_source`` tells which answered.
    The heuristic answers for the rest.

    Context: hour of opening, alerts of the service opened in the 24 h
    before, health of the service's latest window, failure flag = critical
    severity, payment/auth from the service name.  ``reference_context=True``
    uses the product's placeholder values instead (frequency 0, health 60,
    no payment flag).
    """
    op = AL.open_alerts(alerts, limit)
    if reference_context:
        ctx = op.select("*", F.hour("opened_at").alias("hour_of_day"),
                        F.lit(0).alias("alert_frequency_24h"), F.lit(60.0).alias("current_health_score"),
                        (F.col("severity") == "critical").alias("failure_prediction_active"),
                        F.lit(False).alias("service_is_payment_or_auth"))
        return _with_predicted(H.heuristic_priority(ctx), predictions)
    order = F.when(F.col("triggering_metric") == "latency", 0).otherwise(1)
    freq = AL.alert_frequency(alerts.withColumn("trigger_order", order), ts="opened_at") \
        .select("id", "alert_frequency_24h")
    health = H.health_score(M.latest_per_service(metrics, window_size)) \
        .select("service_id", F.col("health_score").alias("current_health_score"))
    names = services.select(F.col("id").alias("service_id"), F.col("name").alias("service_name"))
    ctx = op.join(freq, "id", "left").join(health, "service_id", "left").join(names, "service_id", "left") \
        .withColumn("hour_of_day", F.hour("opened_at")) \
        .withColumn("failure_prediction_active", F.col("severity") == "critical") \
        .withColumn("service_is_payment_or_auth", X.is_payment_or_auth(F.col("service_name")))
    return _with_predicted(H.heuristic_priority(ctx), predictions)


def _with_predicted(alerts: DataFrame, predictions: DataFrame | None) -> DataFrame:
    if predictions is None:
        return alerts
    keys = ["service_id", "triggering_metric", "opened_at"]
    found = predictions.filter(F.col("module") == "alerts").select(
        "service_id", F.get_json_object("value", "$.triggering_metric").alias("triggering_metric"), F.col("generated_at").alias("opened_at"),
        F.struct("model_version", F.get_json_object("value", "$.priority").alias("priority"), "confidence").alias("_p")) \
        .groupBy(*keys).agg(F.max("_p").alias("_p"))
    j = alerts.join(found, keys, "left")
    return j.withColumn("priority", F.coalesce("_p.priority", "priority")).withColumn("confidence", F.col("_p.confidence")) \
        .withColumn("priority_source", F.coalesce("_p.model_version", F.lit(S.HEURISTIC_MODEL_VERSION))).drop("_p")


# ---- E9 as-of lookup --------------------------------------------------------------------

def asof_prediction(probes: DataFrame, predictions: DataFrame, at: str = "at",
                    max_age_minutes: int = S.PREDICTION_MAX_AGE_MIN,
                    keys=("service_id", "module"), probe_id: str = "probe_id") -> DataFrame:
    """Newest prediction with ``generated_at`` in ``(at - max_age, at]`` per probe.

    Range join by time bucket, the small side copied: each prediction goes into
    the bucket of ``max_age`` it falls in and the next one, packed per (keys,
    bucket) -- a few per service and module.  A probe is shuffled once, meets
    one packed row by equality and picks the newest prediction within its
    window with array functions.  Probes with none get ``status = 'no-cache'``,
    found ones are flagged ``stale`` (they are cached answers).
    """
    span = max_age_minutes * 60
    bucket = F.floor(F.unix_seconds("generated_at") / span)
    packed = predictions.select(*keys, F.explode(F.array(bucket, bucket + 1)).alias("_b"),
                                F.struct("generated_at", "model_version", "value").alias("_p")) \
        .groupBy(*keys, "_b").agg(F.collect_list("_p").alias("_preds"))
    p = probes.withColumn("_b", F.floor(F.unix_seconds(F.col(at)) / span))
    j = p.join(packed, [*keys, "_b"], "left")
    oldest = F.col(at) - F.make_dt_interval(mins=F.lit(max_age_minutes))
    best = F.array_max(F.filter("_preds", lambda x: (x["generated_at"] <= F.col(at)) & (x["generated_at"] > oldest)))
    return j.withColumn("_best", best).select(
        *probes.columns,
        F.col("_best.generated_at").alias("generated_at"),
        F.col("_best.model_version").alias("model_version"),
        F.col("_best.value").alias("value"),
        F.when(F.col("_best").isNull(), F.lit("no-cache")).otherwise(F.lit("stale")).alias("status"))


def anomaly_predictions(metrics: DataFrame, model_version: str = S.HEURISTIC_MODEL_VERSION) -> DataFrame:
    """Predictions rows (A10 shape) from the heuristic anomaly score of each window,
    generated when the window closes; ``value`` is JSON (C15)."""
    a = H.heuristic_anomaly(metrics)
    return a.select(
        "service_id", F.lit("anomaly").alias("module"), F.lit(model_version).alias("model_version"),
        F.col("window_end").alias("generated_at"), F.lit(None).cast("int").alias("horizon_minutes"),
        F.to_json(F.struct(F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly",
                           "contamination")).alias("value"),
        F.lit(None).cast("decimal(5,4)").alias("confidence"))


# ---- E10 episodes ---------------------------------------------------------------------------

def label_episodes(metrics: DataFrame, anomalies: DataFrame, failures: DataFrame,
                   window_size: str = "1m") -> DataFrame:
    """Overlay incident episodes ``[start, start + duration)`` onto minute rows.

    Anomaly episodes multiply latency (mean, p95, p99) by their multiplier
    (overlaps multiply); failure episodes raise error rate and p99 to their
    floors and p95 to 0.7 x the p99 floor.  Episodes starting before the
    data are skipped; windows past the data are dropped.  An episode covers
    every window that one of its minutes falls in, each once: it is expanded
    with ``sequence`` from the window of its first minute to that of its last
    (bounded by the episode's duration) and equi-joined, then combined per
    window with partial aggregates (``product``, ``max``) -- no interval
    nested loop.
    """
    size = S.WINDOW_MINUTES[window_size]
    m = metrics.filter(F.col("window_size") == window_size)
    bounds = m.agg(F.min("window_start").alias("_lo"), F.max("window_start").alias("_hi"))

    def minutes(ep: DataFrame) -> DataFrame:
        e = ep.crossJoin(F.broadcast(bounds)).filter(  # one-row side
            (F.col("start") >= F.col("_lo")) & (F.col("start") <= F.col("_hi")))
        last = F.col("start") + F.make_dt_interval(mins=F.col("duration_minutes") - 1)
        return e.withColumn("window_start", F.explode(F.sequence(
            X.floor_time(F.col("start"), size), X.floor_time(last, size), F.make_dt_interval(mins=F.lit(size))))) \
            .filter(F.col("window_start") <= F.col("_hi"))

    an = minutes(anomalies).groupBy("service_id", "window_start").agg(
        F.product("latency_multiplier").alias("_mult"))
    fl = minutes(failures).groupBy("service_id", "window_start").agg(
        F.max("error_rate_floor").alias("_err_floor"), F.max("p99_floor_ms").alias("_p99_floor"))
    j = m.join(an, ["service_id", "window_start"], "left").join(fl, ["service_id", "window_start"], "left")
    mult = F.coalesce(F.col("_mult"), F.lit(1.0))
    mean = F.col("response_time_mean").cast("double") * mult
    p95 = F.col("response_time_p95").cast("double") * mult
    p99 = F.col("response_time_p99").cast("double") * mult
    return j.select(
        "service_id", "window_start",
        F.col("_mult").isNotNull().alias("is_anomaly"),
        F.col("_p99_floor").isNotNull().alias("is_failure_window"),
        mean.alias("response_time_mean"),
        F.when(F.col("_p99_floor").isNotNull(), F.greatest(p95, F.col("_p99_floor") * 0.7)).otherwise(p95)
        .alias("response_time_p95"),
        F.when(F.col("_p99_floor").isNotNull(), F.greatest(p99, F.col("_p99_floor"))).otherwise(p99)
        .alias("response_time_p99"),
        F.when(F.col("_err_floor").isNotNull(),
               F.greatest(F.col("error_rate").cast("double"), F.col("_err_floor")))
        .otherwise(F.col("error_rate").cast("double")).alias("error_rate"),
    )
