"""Ingest plans: envelopes, dead-letter split, dedup, validation, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import constraints as CN
from ..operators import quality as QY
from ..sources import fixtures as FX
from ..sources import io as IO
from . import sqlparts as Q
from .core import logs
from .registry import plan

ISO = ("strftime(date_trunc('second', {t}), '%Y-%m-%dT%H:%M') || "
       "CASE WHEN second({t}) = 0 THEN '' ELSE strftime(date_trunc('second', {t}), ':%S') END || 'Z'")


def sql_dedup_key(svc="service_id", ep="endpoint", ts="request_timestamp", st="status_code", uid="user_id"):
    return (f"sha256(coalesce({svc}, 'null') || '|' || coalesce({ep}, '') || '|' || "
            f"({ISO.format(t=ts)}) || '|' || CAST(coalesce({st}, 0) AS VARCHAR) || '|' || coalesce({uid}, ''))")


FEED = f"""
feed AS (
  SELECT event_id, unnest(CASE WHEN event_id % {FX.DUPLICATE_EVERY} = 0 THEN [0, 1] ELSE [0] END) AS delivery,
         CASE WHEN event_id % {FX.UNKNOWN_SERVICE_MOD} = {FX.UNKNOWN_SERVICE_REM}
              THEN '{FX.UNKNOWN_SERVICE_ID}' ELSE service_id END AS service_id,
         CASE WHEN event_id % {FX.MISSING_ENDPOINT_MOD} = {FX.MISSING_ENDPOINT_REM}
              THEN NULL ELSE endpoint END AS endpoint,
         http_method, status_code, response_time_ms, user_id, request_timestamp
  FROM api_logs
)"""

VALID = f"""
valid AS (
  SELECT * FROM feed
  WHERE event_id % {FX.CORRUPT_MOD} <> {FX.CORRUPT_REM} AND endpoint IS NOT NULL
)"""


def envelopes(spark, sf_dir):
    return FX.api_log_envelopes(FX.read_table(spark, sf_dir, "events"))


def parsed_feed(spark, sf_dir):
    return IO.unwrap(envelopes(spark, sf_dir))


@plan("envelope_roundtrip", sql=f"""
WITH {Q.API_LOGS}
SELECT event_id, service_id, endpoint, http_method, CAST(status_code AS INTEGER) AS status_code,
       response_time_ms, user_id, request_timestamp, 'api_log' AS event_type, '1' AS event_version
FROM api_logs""")
def envelope_roundtrip(spark, sf_dir):
    """A2/A3: wrap api_logs into envelope JSON and parse it back."""
    lg = logs(spark, sf_dir)
    payload = F.struct("service_id", "endpoint", "http_method",
                       F.col("status_code").cast("int").alias("status_code"), "response_time_ms",
                       "user_id", F.col("request_timestamp").alias("timestamp"))
    env = IO.wrap(lg.withColumn("payload", payload), "api_log", "gateway-service",
                  natural_key=[F.col("event_id").cast("string")], occurred_at=F.col("request_timestamp"),
                  key=F.col("service_id")).select(F.col("event_id").alias("seq"), "key", "value")
    back = IO.unwrap(env)
    return back.select(F.col("seq").alias("event_id"), F.col("payload.service_id").alias("service_id"),
                       F.col("payload.endpoint").alias("endpoint"),
                       F.col("payload.http_method").alias("http_method"),
                       F.col("payload.status_code").alias("status_code"),
                       F.col("payload.response_time_ms").alias("response_time_ms"),
                       F.col("payload.user_id").alias("user_id"),
                       F.col("payload.timestamp").alias("request_timestamp"),
                       "event_type", "event_version")


@plan("dlq_split", sql=f"""
WITH {Q.API_LOGS}, {FEED}
SELECT event_id, delivery,
       CASE WHEN event_id % {FX.CORRUPT_MOD} = {FX.CORRUPT_REM} THEN 'dlq'
            WHEN endpoint IS NULL THEN 'dlq' ELSE 'ok' END AS route,
       CASE WHEN event_id % {FX.CORRUPT_MOD} = {FX.CORRUPT_REM} THEN 'malformed envelope'
            WHEN endpoint IS NULL THEN 'payload missing required fields' END AS error
FROM feed""")
def dlq_split(spark, sf_dir):
    """Every delivery routed to the table or the dead-letter queue."""
    tagged = QY.tag_route(parsed_feed(spark, sf_dir))
    return tagged.select(F.col("seq").alias("event_id"), "delivery", "route", "error")


@plan("dedup_key", sql=f"""
WITH {Q.API_LOGS}
SELECT event_id, {sql_dedup_key()} AS dedup_key FROM api_logs""")
def dedup_key(spark, sf_dir):
    """SHA-256 identity key per request."""
    return logs(spark, sf_dir).select("event_id", "dedup_key")


@plan("dedup_ingest", sql=f"""
WITH {Q.API_LOGS}, {FEED}, {VALID},
keyed AS (SELECT *, {sql_dedup_key()} AS dedup_key FROM valid)
SELECT dedup_key, event_id, delivery, service_id, endpoint, CAST(status_code AS SMALLINT) AS status_code,
       response_time_ms, request_timestamp
FROM keyed
QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY event_id, delivery) = 1""")
def dedup_ingest(spark, sf_dir):
    """Parse, route, key, keep the first delivery per dedup key."""
    ok, _ = QY.split_valid(parsed_feed(spark, sf_dir))
    rows = QY.with_dedup_key(QY.payload_rows(ok, keep=(F.col("seq").alias("event_id"), "delivery")))
    first = QY.dedup_first(rows, order=("event_id", "delivery"))
    return first.select("dedup_key", "event_id", "delivery", "service_id", "endpoint", "status_code",
                        "response_time_ms", "request_timestamp")


def _absent(column: str) -> str:
    return f"SELECT '{column}_present' AS rule, count(*) FILTER ({column} IS NULL) AS violations FROM feed"


@plan("domain_violations", sql=f"""
WITH {Q.API_LOGS}, {FEED}
{" UNION ALL ".join(_absent(c) for c in ("service_id", "endpoint", "http_method", "status_code", "response_time_ms", "request_timestamp"))}
UNION ALL SELECT 'http_method_valid', count(*) FILTER (http_method NOT IN {S.HTTP_METHODS}) FROM feed
UNION ALL SELECT 'response_time_nonneg', count(*) FILTER (response_time_ms < 0) FROM feed
UNION ALL SELECT 'endpoint_length', count(*) FILTER (length(endpoint) > 512) FROM feed
UNION ALL SELECT 'user_agent_length', CAST(0 AS BIGINT)""")
def domain_violations(spark, sf_dir):
    """B2: failures per rule of the log table over the delivered payloads."""
    feed = FX.api_log_payloads(FX.read_table(spark, sf_dir, "events"))
    return CN.violation_counts(feed, CN.API_LOGS)


PLANT_MOD = 40
#: Clean rows of each table, made from one log each.
CLEAN = {
    "api_logs": {c: c for c in ("service_id", "endpoint", "http_method", "status_code", "request_timestamp")} | {"response_time_ms": "abs(coalesce(response_time_ms, 0))", "user_agent": "'agent'"},
    "metrics": {"service_id": "service_id", "window_start": "request_timestamp", "window_end": "request_timestamp", "window_size": "'1m'", "request_count": "1",
                "error_rate": "0.5D", "success_rate": "0.5D", "cpu_usage_pct": "CAST(NULL AS DOUBLE)", "memory_usage_pct": "100D"},
    "alerts": {"service_id": "service_id", "triggering_metric": "'availability'", "severity": "'high'", "priority": "CAST(NULL AS STRING)", "message": "endpoint",
               "opened_at": "request_timestamp", "closed_at": "request_timestamp"},
    "predictions": {"service_id": "service_id", "module": "'health'", "model_version": "'v1'", "generated_at": "request_timestamp", "value": "'{}'",
                    "horizon_minutes": "CAST(NULL AS INT)", "confidence": "1D"},
    "model_runs": {"module": "'alerts'", "model_version": "'v1'", "algorithm": "'a'", "trained_at": "request_timestamp", "is_active": "true", "artifact_path": "CAST(NULL AS STRING)"},
    "services": {"name": "service_id", "base_url": "'http://a'", "owner": "CAST(NULL AS STRING)", "environment": "'staging'", "description": "''"},
}


def _breaking(r: CN.Rule, blank: bool):
    """A value that breaks this rule and no other one."""
    if r.kind == "present" or (r.kind == "not_blank" and not blank):
        return F.lit(None)
    return {"not_blank": lambda: F.lit(" \t "), "one_of": lambda: F.lit("bogus"), "at_least": lambda: F.lit(r.limit[0] - 1), "above": lambda: F.lit(r.limit[0]),
            "between": lambda: F.lit(r.limit[1] + 1), "longest": lambda: F.repeat(F.lit("x"), r.limit[0] + 1),
            "not_before": lambda: F.col(r.limit[0]) - F.expr("INTERVAL 1 SECOND")}[r.kind]()


def _plants() -> list[tuple[str, int, CN.Rule, bool]]:
    """(table, place, rule, blank): rule broken in rows with event_id % PLANT_MOD = place;
    columns that may not be blank are planted null and, but for the environment
    (a blank one is unlisted too), blank."""
    out = []
    for t, rules in CN.TABLES.items():
        wanted = [(r, False) for r in rules] + [(r, True) for r in rules if r.kind == "not_blank" and r.column != "environment"]
        out += [(t, i, r, blank) for i, (r, blank) in enumerate(wanted)]
    return out


def _planted_sql() -> str:
    places = {}
    for t, i, r, _ in _plants():
        places.setdefault((t, r.name), []).append(str(i))
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{n}' AS rule, count(*) FILTER (event_id % {PLANT_MOD} IN ({', '.join(at)})) AS violations FROM api_logs"
                              for (t, n), at in places.items())


@plan("constraint_violations", sql=f"WITH {Q.API_LOGS} {_planted_sql()}")
def constraint_violations(spark, sf_dir):
    """B2/M5: every rule of every stored table broken by null, blank, unlisted,
    out-of-range or overlong values planted for it alone."""
    out = None
    for t, columns in CLEAN.items():
        df = logs(spark, sf_dir).selectExpr("event_id", *[f"{sql} AS {c}" for c, sql in columns.items()])
        types = dict(df.dtypes)
        for _, i, r, blank in (x for x in _plants() if x[0] == t):
            hit = F.pmod("event_id", F.lit(PLANT_MOD)) == i
            df = df.withColumn(r.column, F.when(hit, _breaking(r, blank).cast(types[r.column])).otherwise(F.col(r.column)))
        part = CN.violation_counts(df, CN.TABLES[t]).select(F.lit(t).alias("tbl"), "rule", "violations")
        out = part if out is None else out.unionByName(part)
    return out


@plan("orphan_logs", sql=f"""
WITH {Q.API_LOGS}, {FEED}, {Q.SERVICES}
SELECT event_id, delivery, service_id FROM feed
WHERE service_id NOT IN (SELECT id FROM services)""")
def orphan_logs(spark, sf_dir):
    """Delivered rows whose service is not registered."""
    feed = FX.api_log_payloads(FX.read_table(spark, sf_dir, "events"))
    return QY.orphans(feed, FX.services(spark)).select("event_id", "delivery", "service_id")


ROUTES_SQL = "routes AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, b in FX.ROUTE_ROWS) + ") AS t(path_segment, service_id))"


@plan("service_attribution", sql=f"""
WITH {Q.API_LOGS}, {ROUTES_SQL}
SELECT l.event_id, l.endpoint, coalesce(r.service_id, '{S.FALLBACK_SERVICE_ID}') AS attributed_service_id
FROM api_logs l LEFT JOIN routes r ON split_part(l.endpoint, '/', 2) = r.path_segment""")
def service_attribution(spark, sf_dir):
    """First path segment -> service, unmatched -> the fallback service."""
    lg = logs(spark, sf_dir).select("event_id", "endpoint")
    return QY.attribute_service(lg, FX.routes(spark)).select("event_id", "endpoint", "attributed_service_id")


@plan("capture_gate", sql=f"""
WITH {Q.API_LOGS}, {Q.SERVICES}
SELECT service_id, CAST(count(*) AS BIGINT) AS captured_logs
FROM api_logs WHERE service_id IN (SELECT id FROM services WHERE capture_telemetry)
GROUP BY service_id""")
def capture_gate(spark, sf_dir):
    """Logs kept for services that capture telemetry (counted per service)."""
    kept = QY.capture_only(logs(spark, sf_dir), FX.services(spark))
    return kept.groupBy("service_id").agg(F.count(F.lit(1)).alias("captured_logs"))
