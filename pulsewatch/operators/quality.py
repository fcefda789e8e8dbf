"""Validation, dead-letter routing, dedup, attribution (A4, B1-B11); the rules of
the stored tables are in ``constraints``.

Joins against the service dimension are written without hints: Catalyst
broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime), and
falls back to a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import exprs as X
from ..sources.io import CORRUPT_COL

REQUIRED_PAYLOAD = ("service_id", "endpoint", "timestamp", "http_method")


def required_ok(payload: str = "payload") -> Column:
    """B1: payload present and its required fields not null."""
    ok = F.col(payload).isNotNull()
    for f in REQUIRED_PAYLOAD:
        ok = ok & F.col(f"{payload}.{f}").isNotNull()
    return ok


def route_error(payload: str = "payload") -> Column:
    """Why a parsed envelope goes to the dead-letter queue (null when valid)."""
    return (F.when(F.col(CORRUPT_COL).isNotNull(), F.lit("malformed envelope"))
            .when(F.coalesce(F.col("event_version"), F.lit("1")) != "1",
                  F.concat(F.lit("unsupported event_version "), F.col("event_version")))
            .when(~required_ok(payload), F.lit("payload missing required fields")))


def split_valid(parsed: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """A4: (valid rows, DLQ rows ``{original, error, routedAt}``) from one parse.

    Both branches read the same plan; in streaming, call this inside
    ``foreachBatch`` on a persisted batch so the parse runs once.
    """
    tagged = parsed.withColumn("_error", route_error())
    ok = tagged.filter(F.col("_error").isNull()).drop("_error", CORRUPT_COL)
    dlq = tagged.filter(F.col("_error").isNotNull()).select(
        *[c for c in tagged.columns if c not in (CORRUPT_COL, "_error", "payload", "event_id", "event_type",
                                                 "event_version", "occurred_at", "producer", "trace_id",
                                                 value_col)],
        F.col(value_col).alias("original"), F.col("_error").alias("error"),
        F.current_timestamp().alias("routedAt"))
    return ok, dlq


def tag_route(parsed: DataFrame) -> DataFrame:
    """One-pass routing: ``route`` ('ok' / 'dlq') and ``error`` on every row.
    Writing the result partitioned by ``route`` stores both branches in a
    single job from a single parse."""
    err = route_error()
    return parsed.withColumn("error", err) \
        .withColumn("route", F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("dlq")))


def payload_rows(valid: DataFrame, keep: tuple = ()) -> DataFrame:
    """Flatten valid envelopes into api_logs columns."""
    return valid.select(
        *keep,
        F.col("payload.service_id").alias("service_id"),
        F.col("payload.endpoint").alias("endpoint"),
        F.col("payload.http_method").alias("http_method"),
        F.col("payload.status_code").cast("short").alias("status_code"),
        F.col("payload.response_time_ms").alias("response_time_ms"),
        F.col("payload.user_agent").alias("user_agent"),
        F.col("payload.client_ip").alias("client_ip"),
        F.col("payload.user_id").alias("user_id"),
        F.col("payload.request_bytes").alias("request_bytes"),
        F.col("payload.response_bytes").alias("response_bytes"),
        F.col("payload.timestamp").alias("request_timestamp"),
        F.col("payload.dedup_key").alias("client_dedup_key"),
    )


# ---- B3 / B7 referential --------------------------------------------------------------

def orphans(df: DataFrame, services: DataFrame, key: str = "service_id") -> DataFrame:
    """Rows whose service is not registered."""
    return df.join(services.select(F.col("id").alias(key)), key, "left_anti")


def known(df: DataFrame, services: DataFrame, key: str = "service_id") -> DataFrame:
    return df.join(services.select(F.col("id").alias(key)), key, "left_semi")


def capture_only(df: DataFrame, services: DataFrame, key: str = "service_id") -> DataFrame:
    """Keep logs of services that capture telemetry."""
    cap = services.filter(F.col("capture_telemetry")).select(F.col("id").alias(key))
    return df.join(cap, key, "left_semi")


# ---- B4 / B5 dedup ------------------------------------------------------------------------

def with_dedup_key(df: DataFrame, client_key: str = "client_dedup_key") -> DataFrame:
    """The client's non-blank key wins, else the SHA-256 identity hash."""
    computed = X.dedup_key("service_id", "endpoint", "request_timestamp", "status_code", "user_id")
    if client_key in df.columns:
        ck = F.col(client_key)
        key = F.when(ck.isNotNull() & (F.length(F.trim(ck)) > 0), ck).otherwise(computed)
    else:
        key = computed
    return df.withColumn("dedup_key", key)


def dedup_first(df: DataFrame, key: str = "dedup_key", order=("event_id",),
                existing: DataFrame | None = None) -> DataFrame:
    """First row per key by ingest order wins; keys already stored are dropped.

    A hash aggregate with ``min_by``: every map task keeps one row per key
    before the shuffle, so a key delivered millions of times (a replay storm)
    costs one row per task, not a sort of all its copies in one task.
    """
    cols = [c for c in df.columns if c != key]
    order_key = F.struct(*[F.col(c) for c in order])
    first = df.groupBy(key).agg(F.min_by(F.struct(*cols), order_key).alias("_r")).select(key, "_r.*")
    if existing is not None:
        first = first.join(existing.select(key), key, "left_anti")
    return first


# ---- B6 attribution ---------------------------------------------------------------------

def attribute_service(df: DataFrame, routes: DataFrame,
                      fallback_id: str = S.FALLBACK_SERVICE_ID) -> DataFrame:
    """First path segment -> registered route's service; else the fallback."""
    seg = F.get(F.split(F.col("endpoint"), "/"), 1)
    r = routes.select(F.col("path_segment").alias("_seg"), F.col("service_id").alias("_sid"))
    return df.withColumn("_seg", seg).join(r, "_seg", "left") \
        .withColumn("attributed_service_id", F.coalesce(F.col("_sid"), F.lit(fallback_id))) \
        .drop("_seg", "_sid")


# ---- B8-B11 ----------------------------------------------------------------------------------

def parse_user_id(df: DataFrame, col: str = "user_id") -> DataFrame:
    return df.withColumn(col, X.parse_uuid(col))


def default_status(df: DataFrame, col: str = "status_code") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(0).cast("short")))


def impute_resources(df: DataFrame) -> DataFrame:
    """Cpu / memory columns added when absent, nulls -> 0.0."""
    for c in ("cpu_usage_pct", "memory_usage_pct"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
        else:
            df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return df


def drop_incomplete(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.dropna(subset=list(cols))
