"""Shared SQL text for the DuckDB oracles.

These restate the event -> api_logs mapping and the decimal rules in plain
ANSI/DuckDB SQL, written independently of the Spark plans they check.
"""

from __future__ import annotations

from .. import schemas as S
from ..sources import fixtures as FX


def half_up(num: str, den: str, scale: int, precision: int) -> str:
    p = 10 ** scale
    return (f"CAST(CAST((({num}) * {2 * p} + ({den})) // (2 * ({den})) AS DECIMAL(20,0)) "
            f"* CAST(1 AS DECIMAL(20,{scale})) / {p} AS DECIMAL({precision},{scale}))")


def dec2(x: str) -> str:
    return f"CAST(round({x}, 2) AS DECIMAL(10,2))"


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

API_LOGS = f"""
api_logs AS (
  SELECT event_id,
         'svc-' || CAST(user_id % {FX.N_SERVICES} AS VARCHAR) AS service_id,
         '/' || event_type || '/' || CAST(user_id % {FX.N_ENDPOINTS} AS VARCHAR) AS endpoint,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS http_method,
         CAST(CASE WHEN event_type = 'error' AND {K} % 4 = 0 THEN 500
                   WHEN event_type = 'error' AND {K} % 4 = 1 THEN 404
                   WHEN event_type = 'signup' THEN 201 ELSE 200 END AS SMALLINT) AS status_code,
         CAST(floor(value * 20) AS INTEGER) AS response_time_ms,
         CAST(user_id AS VARCHAR) AS user_id,
         ts AS request_timestamp
  FROM events
)"""


def _services_values() -> str:
    rows = []
    for r in FX.SERVICE_ROWS:
        vals = ", ".join("NULL" if v is None else ("TRUE" if v is True else "FALSE" if v is False
                                                   else "'" + str(v).replace("'", "''") + "'") for v in r)
        rows.append(f"({vals})")
    return ",\n    ".join(rows)


SERVICES = f"""
services AS (
  SELECT * FROM (VALUES
    {_services_values()}
  ) AS t(id, name, base_url, owner, environment, description, capture_telemetry)
)"""


def metrics(size: str, src: str = "api_logs") -> str:
    m = S.WINDOW_MINUTES[size]
    return f"""
  SELECT service_id,
         time_bucket(INTERVAL '{m} minutes', request_timestamp) AS window_start,
         time_bucket(INTERVAL '{m} minutes', request_timestamp) + INTERVAL '{m} minutes' AS window_end,
         '{size}' AS window_size,
         CAST(count(*) AS INTEGER) AS request_count,
         {half_up('count(*)', str(m), 2, 10)} AS rpm,
         {half_up('sum(response_time_ms)', 'count(response_time_ms)', 2, 10)} AS response_time_mean,
         {dec2('quantile_cont(response_time_ms, 0.95)')} AS response_time_p95,
         {dec2('quantile_cont(response_time_ms, 0.99)')} AS response_time_p99,
         {half_up('sum(CASE WHEN coalesce(status_code, 0) >= 400 THEN 1 ELSE 0 END)', 'count(*)', 4, 5)} AS error_rate,
         {half_up('sum(CASE WHEN coalesce(status_code, 0) < 400 THEN 1 ELSE 0 END)', 'count(*)', 4, 5)} AS success_rate,
         CAST(NULL AS DECIMAL(5,2)) AS cpu_usage_pct,
         CAST(NULL AS DECIMAL(5,2)) AS memory_usage_pct
  FROM {src}
  GROUP BY service_id, time_bucket(INTERVAL '{m} minutes', request_timestamp)"""


def with_metrics(size: str) -> str:
    return f"WITH {API_LOGS},\nmetrics AS ({metrics(size)}\n)"
