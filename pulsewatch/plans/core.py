"""Ingest mapping, window metrics, latest rows, health (the minimum slice)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..ml import heuristics as H
from ..operators import metrics as M
from ..sources import fixtures as FX
from . import sqlparts as Q
from .registry import plan



def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.api_logs(FX.read_table(spark, sf_dir, "events"))


def metrics_of(spark: SparkSession, sf_dir: str, size: str) -> DataFrame:
    return M.window_metrics(logs(spark, sf_dir), size)


def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.aggregate_windows(logs(spark, sf_dir))


@plan("api_logs_mapped", sql=f"""
WITH {Q.API_LOGS}
SELECT service_id, endpoint, http_method, status_code, response_time_ms, user_id,
       request_timestamp
FROM api_logs""")
def api_logs_mapped(spark, sf_dir):
    """events -> api_logs projection (fixture mapping)."""
    return logs(spark, sf_dir).select("service_id", "endpoint", "http_method", "status_code",
                                      "response_time_ms", "user_id", "request_timestamp")


for _size in S.WINDOW_SIZES:
    def _mk(size):
        @plan(f"metrics_{size}", sql=f"{Q.with_metrics(size)}\nSELECT * FROM metrics")
        def _metrics(spark, sf_dir):
            return metrics_of(spark, sf_dir, size).select(*S.METRIC_COLUMNS)
        _metrics.__doc__ = f"F1/F2: {size} window metrics per service."
        return _metrics
    _mk(_size)


@plan("metrics_all_sizes", sql=f"""
WITH {Q.API_LOGS},
m1 AS ({Q.metrics('1m')}), m5 AS ({Q.metrics('5m')}), m60 AS ({Q.metrics('1h')})
SELECT * FROM m1 UNION ALL SELECT * FROM m5 UNION ALL SELECT * FROM m60""")
def metrics_all_sizes(spark, sf_dir):
    """All three window sizes in one scan and one shuffle."""
    return all_metrics(spark, sf_dir).select(*S.METRIC_COLUMNS)


@plan("latest_per_service", sql=f"""
{Q.with_metrics('1m')}
SELECT * FROM metrics
QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) = 1""")
def latest_per_service(spark, sf_dir):
    """G1: latest 1m row per service."""
    return M.latest_per_service(metrics_of(spark, sf_dir, "1m")).select(*S.METRIC_COLUMNS)


HEALTH_SQL_BODY = """
  SELECT *,
         greatest(0.0, 1.0 - CAST(error_rate AS DOUBLE)) AS c_error,
         greatest(0.0, 1.0 - least(1.0, CAST(response_time_p99 AS DOUBLE) / 5000.0)) AS c_latency,
         CAST(0.5 AS DOUBLE) AS c_traffic,
         CAST(0.0 AS DOUBLE) AS c_resource
  FROM {src}"""

HEALTH_SELECT = """
  round(100.0 * ((0.3 * c_error + 0.3 * c_latency + 0.2 * c_traffic) / (0.3 + 0.3 + 0.2)), 6) AS health_score,
  CASE WHEN 100.0 * ((0.3 * c_error + 0.3 * c_latency + 0.2 * c_traffic) / (0.3 + 0.3 + 0.2)) >= 90 THEN 'healthy'
       WHEN 100.0 * ((0.3 * c_error + 0.3 * c_latency + 0.2 * c_traffic) / (0.3 + 0.3 + 0.2)) >= 70 THEN 'warning'
       WHEN 100.0 * ((0.3 * c_error + 0.3 * c_latency + 0.2 * c_traffic) / (0.3 + 0.3 + 0.2)) >= 50 THEN 'degraded'
       ELSE 'critical' END AS health_status,
  round(c_error, 6) AS c_error, round(c_latency, 6) AS c_latency, c_traffic, c_resource"""


def health_columns(df: DataFrame) -> list:
    return [F.round("health_score", 6).alias("health_score"), "health_status",
            F.round("components.error", 6).alias("c_error"),
            F.round("components.latency", 6).alias("c_latency"),
            F.col("components.traffic").alias("c_traffic"),
            F.col("components.resource").alias("c_resource")]


@plan("health_score", sql=f"""
{Q.with_metrics('1h')},
h AS ({HEALTH_SQL_BODY.format(src='metrics')})
SELECT service_id, window_start, {HEALTH_SELECT}
FROM h""")
def health_score(spark, sf_dir):
    """Composite health for every 1h metric row."""
    h = H.health_score(metrics_of(spark, sf_dir, "1h"))
    return h.select("service_id", "window_start", *health_columns(h))


@plan("tile_health", sql=f"""
{Q.with_metrics('1m')},
latest AS (SELECT * FROM metrics
           QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) = 1),
h AS ({HEALTH_SQL_BODY.format(src='latest')})
SELECT service_id, window_start, request_count, response_time_p99, error_rate, {HEALTH_SELECT}
FROM h""")
def tile_health(spark, sf_dir):
    """L1: latest 1m metrics per service with its health score."""
    h = H.health_score(M.latest_per_service(metrics_of(spark, sf_dir, "1m")))
    return h.select("service_id", "window_start", "request_count", "response_time_p99", "error_rate",
                    *health_columns(h))
