"""Serving plans: prediction rows, latest-prediction view, stability, scoring jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..ml import heuristics as H
from ..ml import models as ML
from ..operators import views as V
from ..session import cut_lineage, scratch_path
from ..sources import io as IO
from ..streaming import jobs as J
from . import sqlparts as Q
from .alerting import LIFECYCLE_SQL, lifecycle
from .core import metrics_of
from .registry import plan
from .streams import BATCHES, _deliver, _parts, _source

LATEST = """latest AS (SELECT * FROM metrics
           QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) = 1)"""


@plan("predictions_heuristic", sql=f"""
{Q.with_metrics('1m')}, {LATEST},
last30 AS (SELECT * FROM metrics
           QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) <= {S.FAILURE_RECENT_ROWS}),
f AS (SELECT service_id, least(1.0, 0.5 * avg(CAST(error_rate AS DOUBLE))
                                   + 0.5 * avg(CASE WHEN CAST(response_time_p99 AS DOUBLE) > 2000 THEN 1.0 ELSE 0.0 END)) AS p
      FROM last30 GROUP BY service_id),
h AS (SELECT service_id, window_end,
             100.0 * ((0.3 * greatest(0.0, 1.0 - CAST(error_rate AS DOUBLE))
                       + 0.3 * greatest(0.0, 1.0 - least(1.0, CAST(response_time_p99 AS DOUBLE) / 5000.0))
                       + 0.2 * 0.5) / (0.3 + 0.3 + 0.2)) AS s,
             least(1.0, greatest(CAST(response_time_p99 AS DOUBLE) / 5000.0, CAST(error_rate AS DOUBLE))) AS a,
             greatest(0.0, CAST(request_count AS DOUBLE)) AS r
      FROM latest)
SELECT h.service_id, 'health' AS module, '{S.HEURISTIC_MODEL_VERSION}' AS model_version, h.window_end AS generated_at,
       CAST(NULL AS INTEGER) AS horizon_minutes, round(s, 6) AS headline,
       CASE WHEN s >= 90 THEN 'healthy' WHEN s >= 70 THEN 'warning' WHEN s >= 50 THEN 'degraded' ELSE 'critical' END AS label
FROM h
UNION ALL
SELECT service_id, 'anomaly', '{S.HEURISTIC_MODEL_VERSION}', window_end, NULL, round(a, 6),
       CASE WHEN a >= 0.95 THEN 'true' ELSE 'false' END FROM h
UNION ALL
SELECT h.service_id, 'failure', '{S.HEURISTIC_MODEL_VERSION}', h.window_end, 30, round(f.p, 6),
       CASE WHEN f.p >= 0.75 THEN 'critical' WHEN f.p >= 0.5 THEN 'high' WHEN f.p >= 0.3 THEN 'medium' ELSE 'low' END
FROM h JOIN f ON h.service_id = f.service_id
UNION ALL
SELECT service_id, 'traffic', '{S.HEURISTIC_MODEL_VERSION}', window_end, 60, round(r, 6), NULL FROM h""")
def predictions_heuristic(spark, sf_dir):
    """Heuristic predictions of every module for each service's
    latest window, written as JSON values and read back."""
    p = ML.heuristic_predictions(metrics_of(spark, sf_dir, "1m"))
    head = F.coalesce(F.get_json_object("value", "$.score"), F.get_json_object("value", "$.anomaly_score"),
                      F.get_json_object("value", "$.failure_probability"),
                      F.get_json_object("value", "$.predicted_rpm")).cast("double")
    label = F.coalesce(F.get_json_object("value", "$.status"), F.get_json_object("value", "$.is_anomaly"),
                       F.get_json_object("value", "$.risk_level"))
    return p.select("service_id", "module", "model_version", "generated_at", "horizon_minutes",
                    F.round(head, 6).alias("headline"), label.alias("label"))


@plan("latest_prediction_view", sql=f"""
{Q.with_metrics('1m')}
SELECT service_id, 'anomaly' AS module, window_end AS generated_at,
       round(least(1.0, greatest(CAST(response_time_p99 AS DOUBLE) / 5000.0, CAST(error_rate AS DOUBLE))), 6) AS anomaly_score
FROM metrics
QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_end DESC) = 1""")
def latest_prediction_view(spark, sf_dir):
    """Newest prediction per (service, module), upserted by key over
    out-of-order deliveries."""
    base = scratch_path(spark, f"stream-latest-{uuid.uuid4().hex}")
    rows = V.anomaly_predictions(metrics_of(spark, sf_dir, "1m"))
    rows = cut_lineage(rows.withColumn("batch", F.pmod(F.xxhash64("service_id", "generated_at"), F.lit(BATCHES))))
    stream = _source(rows, f"{base}/in")
    _deliver(_parts(rows), f"{base}/in", lambda: J.start(stream, J.latest_sink(f"{base}/view"), f"{base}/_ckpt", trigger=None))
    return J.read_latest(spark, f"{base}/view").select(
        "service_id", "module", "generated_at", F.get_json_object("value", "$.anomaly_score").cast("double").alias("anomaly_score"))


@plan("traffic_stability", sql=f"""
{Q.with_metrics('1h')},
s AS (SELECT service_id, window_start,
             avg(CAST(rpm AS DOUBLE)) OVER w AS m, stddev_samp(CAST(rpm AS DOUBLE)) OVER w AS sd
      FROM metrics WINDOW w AS (PARTITION BY service_id ORDER BY window_start ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT service_id, window_start,
       round(CASE WHEN m > 0 THEN 1.0 - least(1.0, coalesce(sd, 0.0) / m) END, 6) AS traffic_stability
FROM s""")
def traffic_stability(spark, sf_dir):
    """Traffic stability 1 - min(1, stddev/mean) of rpm over 60 rows."""
    s = H.traffic_stability(metrics_of(spark, sf_dir, "1h"))
    return s.select("service_id", "window_start", F.round("traffic_stability", 6).alias("traffic_stability"))


@plan("tile_alerts_reference", sql=f"""
{Q.with_metrics('1h')}, {LIFECYCLE_SQL}
SELECT id, service_id, triggering_metric, severity,
       CASE WHEN severity = 'critical' THEN 'critical' ELSE 'low' END AS priority,
       CASE WHEN severity = 'critical' THEN '{S.RATIONALE_FAILURE}' ELSE '{S.RATIONALE_BASE}' END AS rationale
FROM (SELECT * FROM alerts_out WHERE closed_at IS NULL
      ORDER BY opened_at DESC, service_id, triggering_metric, id LIMIT {S.OPEN_ALERTS_DEFAULT_LIMIT}) t""")
def tile_alerts_reference(spark, sf_dir):
    """L5 with the product's placeholder context (frequency 0, health 60)."""
    from ..sources import fixtures as FX
    t = V.alerts_tile(lifecycle(spark, sf_dir), metrics_of(spark, sf_dir, "1h"), FX.services(spark),
                      window_size="1h", reference_context=True)
    return t.select("id", "service_id", "triggering_metric", "severity", "priority", "rationale")
