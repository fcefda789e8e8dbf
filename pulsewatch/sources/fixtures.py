"""Map the driver's ``events`` table to the product's ``api_logs`` fact.

The mapping is a narrow projection (no shuffle).  The same rules are written
as SQL in ``pulsewatch.plans.sqlparts`` so that DuckDB can check every plan.

FIXED VALUES: the service dimension rows and planting rules below are the
test-data contract of this repository (see FIXTURES.md); the fallback row is
the product's seeded gateway service.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

# ---- FIXED VALUES ------------------------------------------------------------
N_SERVICES = 5
N_ENDPOINTS = 7
SERVICE_ROWS = (
    # id, name, base_url, owner, environment, description, capture_telemetry
    ("svc-0", "checkout-payments", "http://checkout.internal", "commerce", "production", "Checkout and payment capture", True),
    ("svc-1", "auth-service", "http://auth.internal", "platform", "production", "Login and tokens", True),
    ("svc-2", "catalog", "http://catalog.internal", "commerce", "production", "Product catalog", True),
    ("svc-3", "search", "http://search.internal", "discovery", "staging", "Search API", False),
    ("svc-4", "notifications", "http://notify.internal", "platform", "development", "Mail and push", True),
    (S.FALLBACK_SERVICE_ID, "gateway-unresolved", "http://gateway.internal", "platform", "development",
     "Fallback row for api-logs whose path did not map to a registered service.", True),
)
SERVICES_CREATED_AT = dt.datetime(2023, 12, 1, 0, 0, 0)
DUPLICATE_EVERY = 10        # event_id % 10 == 0 is delivered twice
CORRUPT_MOD, CORRUPT_REM = 50, 7
MISSING_ENDPOINT_MOD, MISSING_ENDPOINT_REM = 50, 9
UNKNOWN_SERVICE_MOD, UNKNOWN_SERVICE_REM = 40, 3
UNKNOWN_SERVICE_ID = "svc-unregistered"
ROUTE_ROWS = (
    # first path segment -> service id (unlisted segments fall back)
    ("purchase", "svc-0"),
    ("signup", "svc-1"),
    ("view", "svc-2"),
    ("click", "svc-3"),
)
# -----------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def services(spark: SparkSession) -> DataFrame:
    """The service dimension (bounded: one row per registered service)."""
    rows = [r + (None, SERVICES_CREATED_AT, SERVICES_CREATED_AT) for r in SERVICE_ROWS]
    return spark.createDataFrame(rows, schema=S.SERVICES)


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROUTE_ROWS), "path_segment string, service_id string")


def props_k(props="props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("int")


def service_of_user(user_id="user_id") -> Column:
    return F.concat(F.lit("svc-"), F.pmod(F.col(user_id), F.lit(N_SERVICES)).cast("string"))


def api_logs(events: DataFrame) -> DataFrame:
    """events -> api_logs (one row per request), columns of ``schemas.API_LOGS``
    plus ``event_id`` kept as the ingest order key.  One SQL projection."""
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    ts = "CAST(ts AS TIMESTAMP)"
    iso = (f"concat(date_format(date_trunc('second', {ts}), \"yyyy-MM-dd'T'HH:mm\"), "
           f"CASE WHEN second({ts}) = 0 THEN '' ELSE date_format(date_trunc('second', {ts}), ':ss') END, 'Z')")
    svc = f"concat('svc-', CAST(pmod(user_id, {N_SERVICES}) AS STRING))"
    endpoint = f"concat('/', event_type, '/', CAST(pmod(user_id, {N_ENDPOINTS}) AS STRING))"
    status = (f"CAST(CASE WHEN event_type = 'error' AND pmod({k}, 4) = 0 THEN 500 "
              f"WHEN event_type = 'error' AND pmod({k}, 4) = 1 THEN 404 "
              f"WHEN event_type = 'signup' THEN 201 ELSE 200 END AS SMALLINT)")
    key = (f"sha2(concat_ws('|', {svc}, {endpoint}, {iso}, CAST({status} AS STRING), "
           f"CAST(user_id AS STRING)), 256)")
    return events.selectExpr(
        "event_id",
        f"{svc} AS service_id",
        f"{endpoint} AS endpoint",
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS http_method",
        f"{status} AS status_code",
        "CAST(floor(value * 20) AS INT) AS response_time_ms",
        "CAST(NULL AS STRING) AS user_agent",
        "CAST(NULL AS STRING) AS client_ip",
        "CAST(user_id AS STRING) AS user_id",
        "CAST(NULL AS INT) AS request_bytes",
        "CAST(NULL AS INT) AS response_bytes",
        f"{ts} AS request_timestamp",
        f"{ts} AS ingested_at",
        f"{key} AS dedup_key",
    )


def api_log_payloads(events: DataFrame) -> DataFrame:
    """The wire feed: api-log payload rows with planted defects.

    Duplicated deliveries (event_id % 10 == 0 appears twice), an unknown
    service (event_id % 40 == 3) and a missing endpoint (event_id % 50 == 9).
    Corrupt bytes (event_id % 50 == 7) are planted by ``api_log_envelopes``.
    """
    logs = api_logs(events)
    eid = F.col("event_id")
    logs = logs.withColumn(
        "service_id",
        F.when(F.pmod(eid, F.lit(UNKNOWN_SERVICE_MOD)) == UNKNOWN_SERVICE_REM,
               F.lit(UNKNOWN_SERVICE_ID)).otherwise(F.col("service_id")),
    ).withColumn(
        "endpoint",
        F.when(F.pmod(eid, F.lit(MISSING_ENDPOINT_MOD)) == MISSING_ENDPOINT_REM,
               F.lit(None).cast("string")).otherwise(F.col("endpoint")),
    )
    copies = F.when(F.pmod(eid, F.lit(DUPLICATE_EVERY)) == 0, F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    return logs.withColumn("delivery", F.explode(copies))


def api_log_envelopes(events: DataFrame) -> DataFrame:
    """JSON envelope text per delivery (the bytes a topic would carry)."""
    from . import io as IO  # local import: io depends on fixtures for nothing
    p = api_log_payloads(events)
    payload = F.struct(
        "service_id", "endpoint", "http_method", F.col("status_code").cast("int").alias("status_code"),
        "response_time_ms", "user_agent", "client_ip", "user_id", "request_bytes", "response_bytes",
        F.col("request_timestamp").alias("timestamp"),
    )
    env = IO.wrap(p.withColumn("payload", payload), "api_log", "gateway-service",
                  natural_key=[F.col("event_id").cast("string")],
                  occurred_at=F.col("request_timestamp"), key=F.col("service_id"))
    eid = F.col("event_id")
    # ``seq`` plays the role of the topic offset: it identifies a delivery
    # even when its bytes cannot be parsed.  The envelope text is produced once
    # (``inline`` boundary) before the corruption rule reads it twice.
    env = env.select(F.inline(F.array(F.struct(eid.alias("seq"), F.col("delivery"), F.col("key"),
                                                 F.col("value")))))
    value = F.when(F.pmod(F.col("seq"), F.lit(CORRUPT_MOD)) == CORRUPT_REM,
                   F.substring(F.col("value"), 1, 40)).otherwise(F.col("value"))
    return env.select("seq", "delivery", "key", value.alias("value"))


# ---- FIXED VALUES: incident episodes planted from error events --------------------
# A 500 error opens an anomaly episode, a 404 a failure episode, for the
# request's service, starting at the request's minute.
ANOMALY_MAX_MINUTES, ANOMALY_MULTIPLIERS = 10, 3       # duration 1 + k % 10, multiplier 1 + k % 3
FAILURE_MAX_MINUTES = 5                                # duration 1 + k % 5
FAILURE_ERROR_RATE_FLOOR, FAILURE_P99_FLOOR_MS = 0.25, 2500.0


def anomaly_episodes(events: DataFrame) -> DataFrame:
    k = props_k()
    return events.filter((F.col("event_type") == "error") & (F.pmod(k, F.lit(4)) == 0)).select(
        service_of_user().alias("service_id"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("start"),
        (1 + F.pmod(k, F.lit(ANOMALY_MAX_MINUTES))).cast("int").alias("duration_minutes"),
        (1 + F.pmod(k, F.lit(ANOMALY_MULTIPLIERS))).cast("double").alias("latency_multiplier"))


def failure_episodes(events: DataFrame) -> DataFrame:
    k = props_k()
    return events.filter((F.col("event_type") == "error") & (F.pmod(k, F.lit(4)) == 1)).select(
        service_of_user().alias("service_id"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("start"),
        (1 + F.pmod(k, F.lit(FAILURE_MAX_MINUTES))).cast("int").alias("duration_minutes"),
        F.lit(FAILURE_ERROR_RATE_FLOOR).alias("error_rate_floor"),
        F.lit(FAILURE_P99_FLOOR_MS).alias("p99_floor_ms"))
