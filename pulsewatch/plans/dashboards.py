"""Dashboard tiles, as-of prediction reads, episode labels, label joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..ml import models as ML
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import views as V
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import io as IO
from . import sqlparts as Q
from .alerting import LIFECYCLE_SQL, lifecycle
from .core import HEALTH_SQL_BODY, logs, metrics_of
from .registry import ORACLES, plan

LATEST_1M = """latest AS (SELECT * FROM metrics
           QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) = 1)"""

HIST_26H = f"""hist AS (
  SELECT service_id, count(*) AS history_rows_26h FROM metrics
  WHERE window_start >= date_trunc('minute', (SELECT max(window_start) FROM metrics)) - INTERVAL '{S.HISTORY_HOURS} hours'
  GROUP BY service_id)"""


@plan("tile_latency", sql=f"""
{Q.with_metrics('1m')}, {LATEST_1M}
SELECT service_id, window_start, response_time_mean AS mean, response_time_p95 AS p95, response_time_p99 AS p99
FROM latest""")
def tile_latency(spark, sf_dir):
    """L3: latest mean / p95 / p99 per service."""
    return V.latency_tile(metrics_of(spark, sf_dir, "1m"))


@plan("history_recent", sql=f"""
{Q.with_metrics('1m')}
SELECT service_id, window_start, request_count, rpm, response_time_p99, error_rate FROM metrics
WHERE window_start >= date_trunc('minute', (SELECT max(window_start) FROM metrics)) - INTERVAL '{S.HISTORY_HOURS} hours'""")
def history_recent(spark, sf_dir):
    """Last 26 hours of 1m history, every service."""
    r = M.recent(metrics_of(spark, sf_dir, "1m"))
    return r.select("service_id", "window_start", "request_count", "rpm", "response_time_p99", "error_rate")


@plan("tile_traffic", sql=f"""
{Q.with_metrics('1m')}, {LATEST_1M}, {HIST_26H},
t AS (
  SELECT l.service_id, l.window_start, l.rpm, coalesce(h.history_rows_26h, 0) AS history_rows_26h,
         CASE WHEN coalesce(h.history_rows_26h, 0) >= {S.TRAFFIC_MIN_HISTORY}
              THEN greatest(0.0, CAST(l.request_count AS DOUBLE)) END AS forecast_rpm
  FROM latest l LEFT JOIN hist h ON l.service_id = h.service_id
)
SELECT service_id, window_start, rpm, CAST(history_rows_26h AS BIGINT) AS history_rows_26h, forecast_rpm,
       CASE WHEN forecast_rpm IS NULL THEN 'insufficient-history' ELSE 'ok' END AS forecast_status,
       forecast_rpm - CAST(rpm AS DOUBLE) AS delta,
       CASE WHEN forecast_rpm IS NULL THEN 'none' WHEN forecast_rpm - CAST(rpm AS DOUBLE) > 0 THEN 'up'
            WHEN forecast_rpm - CAST(rpm AS DOUBLE) < 0 THEN 'down' ELSE 'flat' END AS direction
FROM t""")
def tile_traffic(spark, sf_dir):
    """Latest rpm, forecast gated on 24 rows in 26 h, delta and direction."""
    t = V.traffic_tile(metrics_of(spark, sf_dir, "1m"))
    return t.select("service_id", "window_start", "rpm", F.col("history_rows_26h").cast("long").alias("history_rows_26h"),
                    "forecast_rpm", "forecast_status", "delta", "direction")


@plan("tile_predictions", sql=f"""
{Q.with_metrics('1m')}, {LATEST_1M}, {HIST_26H},
last30 AS (SELECT * FROM metrics
           QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) <= {S.FAILURE_RECENT_ROWS}),
f AS (SELECT service_id, least(1.0, 0.5 * avg(CAST(error_rate AS DOUBLE))
                                   + 0.5 * avg(CASE WHEN CAST(response_time_p99 AS DOUBLE) > 2000 THEN 1.0 ELSE 0.0 END)) AS p
      FROM last30 GROUP BY service_id)
SELECT l.service_id, l.window_start,
       round(least(1.0, greatest(CAST(l.response_time_p99 AS DOUBLE) / 5000.0, CAST(l.error_rate AS DOUBLE))), 6) AS anomaly_score,
       least(1.0, greatest(CAST(l.response_time_p99 AS DOUBLE) / 5000.0, CAST(l.error_rate AS DOUBLE))) >= 0.95 AS is_anomaly,
       CASE WHEN coalesce(h.history_rows_26h, 0) >= {S.FAILURE_MIN_HISTORY} THEN round(f.p, 6) END AS failure_probability,
       CASE WHEN coalesce(h.history_rows_26h, 0) >= {S.FAILURE_MIN_HISTORY} THEN
         CASE WHEN f.p >= 0.75 THEN 'critical' WHEN f.p >= 0.5 THEN 'high' WHEN f.p >= 0.3 THEN 'medium' ELSE 'low' END
       END AS risk_level,
       CASE WHEN coalesce(h.history_rows_26h, 0) >= {S.FAILURE_MIN_HISTORY} THEN 'ok' ELSE 'insufficient-history' END AS failure_status
FROM latest l LEFT JOIN hist h ON l.service_id = h.service_id LEFT JOIN f ON l.service_id = f.service_id""")
def tile_predictions(spark, sf_dir):
    """Anomaly of the latest window and gated failure risk."""
    t = V.predictions_tile(metrics_of(spark, sf_dir, "1m"))
    return t.select("service_id", "window_start", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly",
                    F.round("failure_probability", 6).alias("failure_probability"), "risk_level", "failure_status")


PAY = " OR ".join(f"contains(lower(s.name), '{k}')" for k in S.PAYMENT_AUTH_KEYWORDS)


@plan("tile_alerts", sql=f"""
{Q.with_metrics('1h')}, {Q.SERVICES}, {LIFECYCLE_SQL},
open_top AS (SELECT * FROM alerts_out WHERE closed_at IS NULL
             ORDER BY opened_at DESC, service_id, triggering_metric, id LIMIT {S.OPEN_ALERTS_DEFAULT_LIMIT}),
ord AS (SELECT *, CASE WHEN triggering_metric = 'latency' THEN 0 ELSE 1 END AS o FROM alerts_out),
freq AS (SELECT a.id, (SELECT count(*) FROM ord b WHERE b.service_id = a.service_id
                         AND b.opened_at > a.opened_at - INTERVAL '24 hours'
                         AND (b.opened_at < a.opened_at OR (b.opened_at = a.opened_at AND b.o < a.o))) AS f
         FROM ord a),
{LATEST_1M.replace('latest AS', 'latest_h AS')},
hl AS ({HEALTH_SQL_BODY.format(src='latest_h')}),
hs AS (SELECT service_id, 100.0 * ((0.3 * c_error + 0.3 * c_latency + 0.2 * c_traffic) / (0.3 + 0.3 + 0.2)) AS health FROM hl),
ctx AS (
  SELECT o.id, o.service_id, o.triggering_metric, o.severity, o.opened_at, CAST(hour(o.opened_at) AS INTEGER) AS hour_of_day,
         CAST(fr.f AS INTEGER) AS alert_frequency_24h, hs.health AS current_health_score,
         o.severity = 'critical' AS fail, coalesce({PAY}, false) AS pay
  FROM open_top o JOIN freq fr ON o.id = fr.id LEFT JOIN hs ON o.service_id = hs.service_id
  LEFT JOIN services s ON o.service_id = s.id
),
b AS (SELECT *, CASE WHEN current_health_score IS NOT NULL AND current_health_score < 50 THEN 'high'
                     WHEN alert_frequency_24h >= 10 THEN 'medium' ELSE 'low' END AS base FROM ctx)
SELECT id, service_id, triggering_metric, severity, opened_at, hour_of_day, alert_frequency_24h,
       round(current_health_score, 6) AS current_health_score,
       CASE WHEN fail THEN 'critical'
            WHEN pay THEN CASE base WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END
            ELSE base END AS priority
FROM b""")
def tile_alerts(spark, sf_dir):
    """Open alerts with a computed context and heuristic priority."""
    m = metrics_of(spark, sf_dir, "1h")
    t = V.alerts_tile(lifecycle(spark, sf_dir), m, FX.services(spark), window_size="1h")
    return t.select("id", "service_id", "triggering_metric", "severity", "opened_at", "hour_of_day",
                    "alert_frequency_24h", F.round("current_health_score", 6).alias("current_health_score"),
                    "priority")


MODEL_AGE_MINUTES, MODEL_MIN_HISTORY = 120, 10


@plan("tile_predictions_model", sql=f"""
{Q.with_metrics('1h')}, {LATEST_1M}, {HIST_26H},
ranked AS (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) AS rn FROM metrics),
pred AS (SELECT service_id, window_end, CAST(error_rate AS DOUBLE) / 2 AS s FROM ranked
         WHERE service_id IN ('svc-0', 'svc-1') OR (service_id = 'svc-2' AND rn > 1)),
best AS (SELECT l.service_id, p.window_end, p.s FROM latest l JOIN pred p ON p.service_id = l.service_id
           AND p.window_end <= l.window_end AND p.window_end > l.window_end - INTERVAL '{MODEL_AGE_MINUTES} minutes'
         QUALIFY row_number() OVER (PARTITION BY l.service_id ORDER BY p.window_end DESC) = 1),
f AS (SELECT service_id, least(1.0, 0.5 * avg(CAST(error_rate AS DOUBLE)) + 0.5 * avg(CASE WHEN CAST(response_time_p99 AS DOUBLE) > 2000 THEN 1.0 ELSE 0.0 END)) AS p
      FROM ranked WHERE rn <= {S.FAILURE_RECENT_ROWS} GROUP BY service_id),
t AS (SELECT l.*, b.s, b.window_end AS predicted_at, f.p, coalesce(h.history_rows_26h, 0) >= {MODEL_MIN_HISTORY} AS ok,
             least(1.0, greatest(CAST(l.response_time_p99 AS DOUBLE) / 5000.0, CAST(l.error_rate AS DOUBLE))) AS a
      FROM latest l LEFT JOIN hist h ON l.service_id = h.service_id LEFT JOIN f ON l.service_id = f.service_id LEFT JOIN best b ON l.service_id = b.service_id)
SELECT service_id, round(coalesce(s, a), 6) AS anomaly_score, CASE WHEN s IS NOT NULL THEN s > 0.2 ELSE a >= 0.95 END AS is_anomaly,
       CASE WHEN s IS NOT NULL THEN 'model-1' ELSE '{S.HEURISTIC_MODEL_VERSION}' END AS anomaly_source, coalesce(predicted_at < window_end, false) AS anomaly_stale,
       CASE WHEN ok THEN round(coalesce(s / 2, p), 6) END AS failure_probability,
       CASE WHEN NOT ok THEN NULL WHEN s IS NOT NULL THEN 'planted' WHEN p >= 0.75 THEN 'critical' WHEN p >= 0.5 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level,
       CASE WHEN ok AND s IS NOT NULL THEN 'model-1' ELSE '{S.HEURISTIC_MODEL_VERSION}' END AS failure_source
FROM t""")
def tile_predictions_model(spark, sf_dir):
    """The tile over stored predictions: two services with an answer for
    their latest window, one with a stale one, the others without."""
    m = metrics_of(spark, sf_dir, "1h")
    newest = m.groupBy("service_id").agg(F.max("window_start").alias("_last"))
    rows = m.join(newest, "service_id").where(F.col("service_id").isin("svc-0", "svc-1") | ((F.col("service_id") == "svc-2") & (F.col("window_start") < F.col("_last")))) \
        .withColumn("s", F.col("error_rate").cast("double") / 2).withColumn("generated_at", F.col("window_end"))
    stored = ML.prediction_rows(rows, "anomaly", "model-1", F.struct("service_id", F.col("s").alias("anomaly_score"), (F.col("s") > 0.2).alias("is_anomaly"))) \
        .unionByName(ML.prediction_rows(rows, "failure", "model-1", F.struct("service_id", (F.col("s") / 2).alias("failure_probability"), F.lit("planted").alias("risk_level"))))
    path = scratch_path(spark, f"tile-predictions-{uuid.uuid4().hex}")
    IO.write_predictions(stored, path)
    t = V.predictions_tile(m, "1h", min_history=MODEL_MIN_HISTORY, predictions=spark.read.parquet(path), max_age_minutes=MODEL_AGE_MINUTES)
    return t.select("service_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "anomaly_source", "anomaly_stale",
                    F.round("failure_probability", 6).alias("failure_probability"), "risk_level", "failure_source")


@plan("tile_alerts_model", sql=f"""
SELECT id, service_id, triggering_metric, opened_at,
       CASE WHEN hour_of_day % 4 = 0 THEN 'high' WHEN hour_of_day % 2 = 0 THEN 'low' ELSE priority END AS priority,
       CASE WHEN hour_of_day % 4 = 0 THEN 'model-2' WHEN hour_of_day % 2 = 0 THEN 'model-1' ELSE '{S.HEURISTIC_MODEL_VERSION}' END AS priority_source
FROM ({ORACLES["tile_alerts"]}) t""")
def tile_alerts_model(spark, sf_dir):
    """Open alerts with the priority a stored model gave them (two
    versions, the newer counts), the heuristic's for the rest."""
    alerts, m = lifecycle(spark, sf_dir), metrics_of(spark, sf_dir, "1h")
    at = alerts.withColumn("generated_at", F.col("opened_at"))
    value = lambda p: F.struct("service_id", "triggering_metric", F.lit(p).alias("priority"))
    stored = ML.prediction_rows(at.where(F.hour("opened_at") % 2 == 0), "alerts", "model-1", value("low")) \
        .unionByName(ML.prediction_rows(at.where(F.hour("opened_at") % 4 == 0), "alerts", "model-2", value("high")))
    path = scratch_path(spark, f"tile-alerts-{uuid.uuid4().hex}")
    IO.write_predictions(stored, path)
    t = V.alerts_tile(alerts, m, FX.services(spark), window_size="1h", predictions=spark.read.parquet(path))
    return t.select("id", "service_id", "triggering_metric", "opened_at", "priority", "priority_source")


@plan("asof_prediction", sql=f"""
{Q.with_metrics('1m')},
preds AS (SELECT service_id, window_end AS generated_at,
                 round(least(1.0, greatest(CAST(response_time_p99 AS DOUBLE) / 5000.0, CAST(error_rate AS DOUBLE))), 6) AS score
          FROM metrics),
probes AS (SELECT event_id, service_id, request_timestamp AS probe_at FROM api_logs),
j AS (SELECT p.event_id, p.service_id, p.probe_at, q.generated_at, q.score
      FROM probes p ASOF LEFT JOIN preds q ON p.service_id = q.service_id AND p.probe_at >= q.generated_at)
SELECT event_id, service_id, probe_at,
       CASE WHEN generated_at > probe_at - INTERVAL '{S.PREDICTION_MAX_AGE_MIN} minutes' THEN generated_at END AS generated_at,
       CASE WHEN generated_at > probe_at - INTERVAL '{S.PREDICTION_MAX_AGE_MIN} minutes' THEN score END AS anomaly_score,
       CASE WHEN generated_at > probe_at - INTERVAL '{S.PREDICTION_MAX_AGE_MIN} minutes' THEN 'stale' ELSE 'no-cache' END AS status
FROM j""")
def asof_prediction(spark, sf_dir):
    """Newest anomaly prediction within 5 minutes before each request."""
    m = metrics_of(spark, sf_dir, "1m")
    preds = V.anomaly_predictions(m)
    probes = logs(spark, sf_dir).select(F.col("event_id").alias("probe_id"), "service_id",
                                        F.col("request_timestamp").alias("probe_at"), F.lit("anomaly").alias("module"))
    r = V.asof_prediction(probes, preds, at="probe_at")
    return r.select(F.col("probe_id").alias("event_id"), "service_id", "probe_at", "generated_at",
                    F.get_json_object("value", "$.anomaly_score").cast("double").alias("anomaly_score"), "status")


def _episodes_sql(unit: str = "minute") -> str:
    k = Q.K
    series = (f"generate_series(date_trunc('{unit}', start), date_trunc('{unit}', start + (d - 1) * INTERVAL '1 minute'), "
              f"INTERVAL '1 {unit}')")
    return f"""
bounds AS (SELECT min(window_start) AS lo, max(window_start) AS hi FROM metrics),
ae AS (SELECT 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service_id, date_trunc('minute', ts) AS start,
              1 + {k} % {FX.ANOMALY_MAX_MINUTES} AS d, CAST(1 + {k} % {FX.ANOMALY_MULTIPLIERS} AS DOUBLE) AS mult
       FROM events WHERE event_type = 'error' AND {k} % 4 = 0),
fe AS (SELECT 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service_id, date_trunc('minute', ts) AS start,
              1 + {k} % {FX.FAILURE_MAX_MINUTES} AS d
       FROM events WHERE event_type = 'error' AND {k} % 4 = 1),
am AS (SELECT service_id, ws AS window_start, product(mult) AS mult FROM (
         SELECT service_id, mult, unnest({series}) AS ws
         FROM ae, bounds WHERE start >= lo AND start <= hi) x, bounds WHERE ws <= hi GROUP BY service_id, ws),
fm AS (SELECT DISTINCT service_id, ws AS window_start FROM (
         SELECT service_id, unnest({series}) AS ws
         FROM fe, bounds WHERE start >= lo AND start <= hi) x, bounds WHERE ws <= hi)"""


LABELS_SQL = f"""
SELECT m.service_id, m.window_start, am.mult IS NOT NULL AS is_anomaly, fm.service_id IS NOT NULL AS is_failure_window,
       round(CAST(m.response_time_mean AS DOUBLE) * coalesce(am.mult, 1.0), 6) AS response_time_mean,
       round(CASE WHEN fm.service_id IS NOT NULL
                  THEN greatest(CAST(m.response_time_p95 AS DOUBLE) * coalesce(am.mult, 1.0), {FX.FAILURE_P99_FLOOR_MS} * 0.7)
                  ELSE CAST(m.response_time_p95 AS DOUBLE) * coalesce(am.mult, 1.0) END, 6) AS response_time_p95,
       round(CASE WHEN fm.service_id IS NOT NULL
                  THEN greatest(CAST(m.response_time_p99 AS DOUBLE) * coalesce(am.mult, 1.0), {FX.FAILURE_P99_FLOOR_MS})
                  ELSE CAST(m.response_time_p99 AS DOUBLE) * coalesce(am.mult, 1.0) END, 6) AS response_time_p99,
       round(CASE WHEN fm.service_id IS NOT NULL THEN greatest(CAST(m.error_rate AS DOUBLE), {FX.FAILURE_ERROR_RATE_FLOOR})
                  ELSE CAST(m.error_rate AS DOUBLE) END, 6) AS error_rate
FROM metrics m LEFT JOIN am ON m.service_id = am.service_id AND m.window_start = am.window_start
LEFT JOIN fm ON m.service_id = fm.service_id AND m.window_start = fm.window_start"""


def _labels(spark, sf_dir, size):
    ev = FX.read_table(spark, sf_dir, "events")
    lab = V.label_episodes(metrics_of(spark, sf_dir, size), FX.anomaly_episodes(ev), FX.failure_episodes(ev), window_size=size)
    return lab.select("service_id", "window_start", "is_anomaly", "is_failure_window",
                      *[F.round(c, 6).alias(c) for c in ("response_time_mean", "response_time_p95",
                                                          "response_time_p99", "error_rate")])


@plan("episode_labels", sql=f"""
{Q.with_metrics('1m')}, {_episodes_sql()} {LABELS_SQL}""")
def episode_labels(spark, sf_dir):
    """Anomaly / failure episodes overlaid on 1m metric rows (multipliers, floors)."""
    return _labels(spark, sf_dir, "1m")


@plan("episode_labels_1h", sql=f"""
{Q.with_metrics('1h')}, {_episodes_sql('hour')} {LABELS_SQL}""")
def episode_labels_1h(spark, sf_dir):
    """E10 on hours: an episode labels every hour one of its minutes falls in."""
    return _labels(spark, sf_dir, "1h")


@plan("anomaly_label_join", sql=f"""
{Q.with_metrics('1m')}, {_episodes_sql()}
SELECT m.service_id, m.window_start, coalesce(am.mult IS NOT NULL, false) AS is_anomaly,
       least(1.0, greatest(CAST(m.response_time_p99 AS DOUBLE) / 5000.0, CAST(m.error_rate AS DOUBLE))) >= 0.95 AS flagged
FROM metrics m LEFT JOIN am ON m.service_id = am.service_id AND m.window_start = am.window_start""")
def anomaly_label_join(spark, sf_dir):
    """Labels written to CSV and read back, left-joined to metric rows
    (missing -> false), next to the heuristic anomaly flag."""
    ev = FX.read_table(spark, sf_dir, "events")
    m = metrics_of(spark, sf_dir, "1m")
    lab = V.label_episodes(m, FX.anomaly_episodes(ev), FX.failure_episodes(ev)) \
        .filter(F.col("is_anomaly") | F.col("is_failure_window"))
    path = scratch_path(spark, f"labels-{uuid.uuid4().hex}")
    IO.write_labels_csv(lab.select("service_id", "window_start", "is_anomaly", "is_failure_window"), path)
    labels = IO.read_labels(spark, path)
    from ..ml import heuristics as H
    scored = H.heuristic_anomaly(m).select("service_id", "window_start",
                                           F.col("is_anomaly").alias("flagged"))
    return FE.join_labels(scored, labels).select("service_id", "window_start", "is_anomaly", "flagged")


HISTORY_SINCE, HISTORY_UNTIL = "2024-01-01 00:00:00", "2024-02-01 00:00:00"   # the whole month of data


@plan("history_range", sql=f"""
{Q.with_metrics('1h')}
SELECT service_id, window_start, window_end, request_count, response_time_p99, error_rate FROM metrics
WHERE window_start >= TIMESTAMP '{HISTORY_SINCE}' AND window_start < TIMESTAMP '{HISTORY_UNTIL}'""")
def history_range(spark, sf_dir):
    """Each service's hourly history in a half-open range, ordered
    by window start (the per-service read, run for every service)."""
    m = metrics_of(spark, sf_dir, "1h")
    r = M.in_range(m.filter(F.col("window_size") == "1h"), HISTORY_SINCE, HISTORY_UNTIL)
    return r.orderBy("service_id", "window_start").select(
        "service_id", "window_start", "window_end", "request_count", "response_time_p99", "error_rate")
