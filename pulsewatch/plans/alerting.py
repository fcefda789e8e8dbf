"""Alert plans: lifecycle replay, open alerts, contexts, frequency, priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import alerts as AL
from ..sources import fixtures as FX
from . import sqlparts as Q
from .core import metrics_of
from .registry import plan

SIZE = "1h"   # the driver's data is sparse per minute: alerts replay on hourly windows
STEP_US = S.WINDOW_MINUTES[SIZE] * 60_000_000

LIFECYCLE_SQL = f"""
bad AS (
  SELECT service_id, window_start, response_time_p99, error_rate,
         CASE WHEN coalesce(CAST(response_time_p99 AS DOUBLE), 0) > 2000 THEN 'latency'
              WHEN coalesce(CAST(error_rate AS DOUBLE), 0) > 0.10 THEN 'error_rate' END AS trig
  FROM metrics
),
b2 AS (
  SELECT *, epoch_us(window_start)
            - row_number() OVER (PARTITION BY service_id ORDER BY window_start) * {STEP_US} AS isl
  FROM bad WHERE trig IS NOT NULL
),
isl AS (SELECT service_id, isl, max(window_start) AS iend FROM b2 GROUP BY service_id, isl),
firsts AS (
  SELECT * FROM b2
  QUALIFY row_number() OVER (PARTITION BY service_id, isl, trig ORDER BY window_start) = 1
),
u AS (SELECT max(window_start) AS until FROM metrics),
alerts AS (
  SELECT sha256('alert|' || f.service_id || '|' || f.trig || '|' || CAST(f.window_start AS VARCHAR)) AS h,
         f.service_id, f.trig AS triggering_metric,
         CASE WHEN f.trig = 'latency' THEN CASE WHEN CAST(f.response_time_p99 AS DOUBLE) > 4000 THEN 'critical' ELSE 'high' END
              ELSE CASE WHEN CAST(f.error_rate AS DOUBLE) > 0.2 THEN 'critical' ELSE 'high' END END AS severity,
         f.window_start AS opened_at,
         CASE WHEN i.iend < u.until THEN i.iend + INTERVAL '{S.WINDOW_MINUTES[SIZE]} minutes' END AS closed_at
  FROM firsts f JOIN isl i ON f.service_id = i.service_id AND f.isl = i.isl CROSS JOIN u
),
alerts_out AS (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
         || '-' || substr(h, 21, 12) AS id, service_id, triggering_metric, severity, opened_at, closed_at
  FROM alerts
)"""


def lifecycle(spark, sf_dir):
    return AL.alert_lifecycle(metrics_of(spark, sf_dir, SIZE), window_size=SIZE)


@plan("alerts_lifecycle", sql=f"""
{Q.with_metrics(SIZE)}, {LIFECYCLE_SQL}
SELECT * FROM alerts_out""")
def alerts_lifecycle(spark, sf_dir):
    """open/close replay of the alert rule over hourly metrics."""
    return lifecycle(spark, sf_dir).select("id", "service_id", "triggering_metric", "severity",
                                           "opened_at", "closed_at")


@plan("alert_messages", sql=f"""
{Q.with_metrics(SIZE)}, {LIFECYCLE_SQL}
SELECT a.id,
       CASE WHEN f.trig = 'latency'
            THEN 'P99 latency ' || CAST(CAST(floor(f.response_time_p99 + 0.5) AS BIGINT) AS VARCHAR)
                 || ' ms exceeds threshold 2000 ms'
            ELSE 'Error rate ' || printf('%.2f', CAST(f.error_rate AS DOUBLE) * 100) || '% exceeds threshold 10%'
       END AS message
FROM firsts f JOIN alerts_out a
  ON a.service_id = f.service_id AND a.triggering_metric = f.trig AND a.opened_at = f.window_start""")
def alert_messages(spark, sf_dir):
    """Alert text with HALF_UP rounding (java.util.Formatter), checked
    against an exact decimal rounding in SQL."""
    return lifecycle(spark, sf_dir).select("id", "message")


@plan("table_rule_violations", sql=f"""
{Q.with_metrics(SIZE)}, {LIFECYCLE_SQL},
x AS (SELECT CASE WHEN hour(window_start) = 3 THEN '2h' ELSE window_size END AS window_size, 2 * CAST(error_rate AS DOUBLE) AS error_rate FROM metrics)
SELECT 'metrics' AS tbl, 'window_size_valid' AS rule, count(*) FILTER (window_size NOT IN {S.WINDOW_SIZES}) AS violations FROM x
UNION ALL SELECT 'metrics', 'error_rate_unit', count(*) FILTER (error_rate > 1) FROM x
UNION ALL SELECT 'alerts', 'severity_valid', count(*) FILTER (severity = 'high' AND triggering_metric = 'error_rate') FROM alerts_out
UNION ALL SELECT 'alerts', 'closed_after_opened', count(*) FILTER (closed_at IS NOT NULL AND triggering_metric = 'latency') FROM alerts_out
UNION ALL SELECT 'predictions', 'confidence_unit', count(*) FILTER (hour(window_end) = 5) FROM metrics
UNION ALL SELECT 'predictions', 'horizon_positive', count(*) FILTER (hour(window_end) = 6) FROM metrics""")
def table_rule_violations(spark, sf_dir):
    """B2: rules on metric, alert and prediction rows with planted violations."""
    from ..operators import constraints as CN
    from ..operators import views as V
    m = metrics_of(spark, sf_dir, SIZE)
    bad_m = m.withColumn("window_size", F.when(F.hour("window_start") == 3, "2h").otherwise(F.col("window_size"))) \
        .withColumn("error_rate", F.col("error_rate").cast("double") * 2)
    a = lifecycle(spark, sf_dir)
    late = F.col("closed_at").isNotNull() & (F.col("triggering_metric") == "latency")
    bad_a = a.withColumn("severity", F.when((F.col("severity") == "high") & (F.col("triggering_metric") == "error_rate"), "odd").otherwise(F.col("severity"))) \
        .withColumn("closed_at", F.when(late, F.col("opened_at") - F.make_dt_interval(mins=F.lit(1))).otherwise(F.col("closed_at")))
    bad_p = V.anomaly_predictions(m).withColumn("confidence", F.when(F.hour("generated_at") == 5, F.lit(1.5))) \
        .withColumn("horizon_minutes", F.when(F.hour("generated_at") == 6, F.lit(0)))
    parts = [CN.violation_counts(df, CN.TABLES[name]).withColumn("tbl", F.lit(name)) for name, df in (("metrics", bad_m), ("alerts", bad_a), ("predictions", bad_p))]
    shown = F.col("rule").isin("window_size_valid", "error_rate_unit", "severity_valid", "closed_after_opened", "confidence_unit", "horizon_positive")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(shown | (F.col("violations") > 0)).select("tbl", "rule", "violations")


@plan("open_alerts_topk", sql=f"""
{Q.with_metrics(SIZE)}, {LIFECYCLE_SQL}
SELECT * FROM alerts_out WHERE closed_at IS NULL
ORDER BY opened_at DESC, service_id, triggering_metric, id LIMIT {S.OPEN_ALERTS_DEFAULT_LIMIT}""")
def open_alerts_topk(spark, sf_dir):
    """Open alerts, newest first, default limit 50."""
    return AL.open_alerts(lifecycle(spark, sf_dir)).select(
        "id", "service_id", "triggering_metric", "severity", "opened_at", "closed_at")


def candidates(spark, sf_dir):
    return AL.alert_candidates(metrics_of(spark, sf_dir, SIZE), FX.services(spark))


PAY = " OR ".join(f"contains(lower(service_name), '{k}')" for k in S.PAYMENT_AUTH_KEYWORDS)

CANDIDATES_SQL = f"""
base AS (
  SELECT m.*, coalesce(s.name, 'unknown') AS service_name
  FROM metrics m LEFT JOIN services s ON m.service_id = s.id
),
c AS (
  SELECT *, 'latency' AS triggering_metric, 0 AS trigger_order FROM base
  WHERE CAST(response_time_p99 AS DOUBLE) > 2000
  UNION ALL
  SELECT *, 'error_rate', 1 FROM base WHERE CAST(error_rate AS DOUBLE) > 0.10
  UNION ALL
  SELECT *, 'availability', 2 FROM base
  WHERE CAST(response_time_p99 AS DOUBLE) > 2000
    AND ('0x' || substr(sha256(service_id || '|' || CAST(window_start AS VARCHAR)), 1, 8))::BIGINT % 100
        < {S.AVAILABILITY_SAMPLE_PCT}
),
ctx AS (
  SELECT service_id, window_start, triggering_metric, trigger_order, service_name,
         CAST(hour(window_start) AS INTEGER) AS hour_of_day,
         100.0 * (0.6 * greatest(0.0, 1.0 - CAST(error_rate AS DOUBLE))
                  + 0.4 * greatest(0.0, 1.0 - least(1.0, CAST(response_time_p99 AS DOUBLE) / 5000.0)))
           AS current_health_score,
         coalesce(CAST(error_rate AS DOUBLE) > 0.20 AND CAST(response_time_p99 AS DOUBLE) > 3500, false)
           AS failure_prediction_active,
         ({PAY}) AS service_is_payment_or_auth
  FROM c
)"""

FREQ_SQL = """
freq AS (
  SELECT a.*, (SELECT count(*) FROM ctx b
               WHERE b.service_id = a.service_id
                 AND b.window_start > a.window_start - INTERVAL '24 hours'
                 AND (b.window_start < a.window_start
                      OR (b.window_start = a.window_start AND b.trigger_order < a.trigger_order)))
              AS alert_frequency_24h
  FROM ctx a
)"""


@plan("alert_candidates", sql=f"""
{Q.with_metrics(SIZE)}, {Q.SERVICES}, {CANDIDATES_SQL}
SELECT service_id, window_start, triggering_metric, hour_of_day,
       round(current_health_score, 6) AS current_health_score, failure_prediction_active,
       service_is_payment_or_auth
FROM ctx""")
def alert_candidates(spark, sf_dir):
    """Alert contexts synthesised from metric rows."""
    c = candidates(spark, sf_dir)
    return c.select("service_id", "window_start", "triggering_metric", "hour_of_day",
                    F.round("current_health_score", 6).alias("current_health_score"),
                    "failure_prediction_active", "service_is_payment_or_auth")


@plan("alert_frequency_24h", sql=f"""
{Q.with_metrics(SIZE)}, {Q.SERVICES}, {CANDIDATES_SQL}, {FREQ_SQL}
SELECT service_id, window_start, triggering_metric, CAST(alert_frequency_24h AS INTEGER) AS alert_frequency_24h
FROM freq""")
def alert_frequency_24h(spark, sf_dir):
    """Alerts of the service in the preceding left-open 24 h, ties in row order."""
    f = AL.alert_frequency(candidates(spark, sf_dir))
    return f.select("service_id", "window_start", "triggering_metric", "alert_frequency_24h")


LABEL_SQL = f"""
lab AS (
  SELECT *,
         CASE WHEN triggering_metric = 'availability' THEN 'high'
              WHEN current_health_score < 50 THEN 'high'
              WHEN alert_frequency_24h >= 10 THEN 'medium' ELSE 'low' END AS base
  FROM freq
),
prio AS (
  SELECT *,
         CASE WHEN failure_prediction_active THEN 'critical'
              WHEN service_is_payment_or_auth THEN
                CASE base WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END
              ELSE base END AS priority
  FROM lab
)"""


def labelled(spark, sf_dir):
    return AL.label_priority(AL.alert_frequency(candidates(spark, sf_dir)))


@plan("alert_priority_label", sql=f"""
{Q.with_metrics(SIZE)}, {Q.SERVICES}, {CANDIDATES_SQL}, {FREQ_SQL}, {LABEL_SQL}
SELECT service_id, window_start, triggering_metric, priority,
       CAST(triggering_metric = 'latency' AS INTEGER) AS triggering_metric_latency,
       CAST(triggering_metric = 'error_rate' AS INTEGER) AS triggering_metric_error_rate,
       CAST(triggering_metric = 'availability' AS INTEGER) AS triggering_metric_availability
FROM prio""")
def alert_priority_label(spark, sf_dir):
    """Heuristic priority label and one-hot trigger."""
    return labelled(spark, sf_dir).select(
        "service_id", "window_start", "triggering_metric", "priority",
        "triggering_metric_latency", "triggering_metric_error_rate", "triggering_metric_availability")
