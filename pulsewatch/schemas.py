"""Table schemas, enumerations and thresholds.

FIXED VALUES: the literals below must equal the monitored product's contract
(enumerations, thresholds, weights, feature order, keyword list) for results
to match.  They are stated here once, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- FIXED VALUES (contract enumerations) --------------------------------
WINDOW_SIZES = ("1m", "5m", "1h")
WINDOW_MINUTES = {"1m": 1, "5m": 5, "1h": 60}
TRIGGERS = ("latency", "error_rate", "availability")
LEVELS = ("low", "medium", "high", "critical")          # severity and priority
MODULES = ("traffic", "failure", "anomaly", "health", "alerts")
HTTP_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
ENVIRONMENTS = ("production", "staging", "development")
TOPICS = ("api-logs", "api-logs-dlq", "metrics", "alerts", "predictions", "service-health")

# ---- FIXED VALUES (rule thresholds) ---------------------------------------
ALERT_P99_MS = 2000.0            # latency breach: p99 strictly above
ALERT_ERROR_RATE = 0.10          # error breach: error rate strictly above
SEVERE_ERROR_RATE = 0.20         # "failure prediction active" in alert contexts
SEVERE_P99_MS = 3500.0
FAILURE_RUN = 5                  # consecutive bad rows that make a failure episode
FAILURE_LOOKAHEAD = 15           # rows ahead that label a row positive
HEALTH_WEIGHTS = {"error": 0.30, "latency": 0.30, "traffic": 0.20, "resource": 0.20}
HEALTH_LATENCY_CEIL_MS = 5000.0
HEALTH_TRAFFIC_DEFAULT = 0.5
HEALTH_TIERS = ((90.0, "healthy"), (70.0, "warning"), (50.0, "degraded"))
HEALTH_TIER_FLOOR = "critical"
QUICK_HEALTH_WEIGHTS = (0.6, 0.4)   # error, latency in alert contexts
PAYMENT_AUTH_KEYWORDS = ("payment", "pay", "auth", "billing")
ALERT_FREQUENCY_MEDIUM = 10
ALERT_HEALTH_HIGH_BELOW = 50.0
ALERT_HEALTH_DEFAULT = 75.0
AVAILABILITY_SAMPLE_PCT = 5
ANOMALY_CONTAMINATION_DEFAULT = 0.05
CONTAMINATION_GRID = (0.01, 0.02, 0.03, 0.05, 0.07, 0.10)
FAILURE_THRESHOLD_GRID_LO, FAILURE_THRESHOLD_GRID_HI, FAILURE_THRESHOLD_GRID_N = 0.05, 0.6, 12
FAILURE_F_BETA = 1.5
TRAFFIC_HORIZONS = (15, 30, 60, 360)
FEATURE_LAGS = (60, 360, 1440)
FEATURE_ROLLING = 15
FEATURE_MIN_ROWS = 1455           # largest lag + rolling window
PREDICTION_MAX_AGE_MIN = 5
OPEN_ALERTS_DEFAULT_LIMIT, OPEN_ALERTS_MAX_LIMIT = 50, 200
TRAFFIC_MIN_HISTORY, FAILURE_MIN_HISTORY = 24, 30
HISTORY_HOURS = 26
FAILURE_RECENT_ROWS = 30
HEURISTIC_MODEL_VERSION = "stub-0.0.0"
ALERT_MESSAGE_LATENCY = "P99 latency %.0f ms exceeds threshold %.0f ms"
ALERT_MESSAGE_ERROR_RATE = "Error rate %.2f%% exceeds threshold %.0f%%"
RATIONALE_FAILURE = "Coincident failure prediction — auto-critical"
RATIONALE_ESCALATED = " escalated for payment/auth service"
RATIONALE_BASE = "Base heuristic priority"
FALLBACK_SERVICE_ID = "00000000-0000-0000-0000-00000000feed"

# Feature matrix column order (models persist this order).
FEATURE_COLUMNS = (
    "request_count",
    "response_time_mean",
    "response_time_p95",
    "response_time_p99",
    "error_rate",
    "cpu_usage_pct",
    "memory_usage_pct",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "rpm_lag_1h",
    "rpm_lag_6h",
    "rpm_lag_24h",
    "rpm_rolling_15m",
)
ALERT_FEATURES = (
    "triggering_metric_latency",
    "triggering_metric_error_rate",
    "triggering_metric_availability",
    "hour_of_day",
    "alert_frequency_24h",
    "current_health_score",
    "failure_prediction_active",
    "service_is_payment_or_auth",
)
# ---------------------------------------------------------------------------

SERVICES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("base_url", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("capture_telemetry", T.BooleanType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

API_LOGS = T.StructType([
    T.StructField("service_id", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("http_method", T.StringType()),
    T.StructField("status_code", T.ShortType()),
    T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("request_bytes", T.IntegerType()),
    T.StructField("response_bytes", T.IntegerType()),
    T.StructField("request_timestamp", T.TimestampType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("dedup_key", T.StringType()),
])

METRIC_COLUMNS = (
    "service_id", "window_start", "window_end", "window_size", "request_count", "rpm",
    "response_time_mean", "response_time_p95", "response_time_p99", "error_rate",
    "success_rate", "cpu_usage_pct", "memory_usage_pct",
)

METRICS = T.StructType([
    T.StructField("service_id", T.StringType()),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("window_end", T.TimestampType()),
    T.StructField("window_size", T.StringType()),
    T.StructField("request_count", T.IntegerType()),
    T.StructField("rpm", T.DecimalType(10, 2)),
    T.StructField("response_time_mean", T.DecimalType(10, 2)),
    T.StructField("response_time_p95", T.DecimalType(10, 2)),
    T.StructField("response_time_p99", T.DecimalType(10, 2)),
    T.StructField("error_rate", T.DecimalType(5, 4)),
    T.StructField("success_rate", T.DecimalType(5, 4)),
    T.StructField("cpu_usage_pct", T.DecimalType(5, 2)),
    T.StructField("memory_usage_pct", T.DecimalType(5, 2)),
    T.StructField("computed_at", T.TimestampType()),
])

ALERTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("service_id", T.StringType()),
    T.StructField("triggering_metric", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("opened_at", T.TimestampType()),
    T.StructField("closed_at", T.TimestampType()),
    T.StructField("resolved_by", T.StringType()),
    T.StructField("metadata", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("service_id", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("generated_at", T.TimestampType()),
    T.StructField("horizon_minutes", T.IntegerType()),
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DecimalType(5, 4)),
])

MODEL_RUNS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("trained_at", T.TimestampType()),
    T.StructField("training_rows", T.IntegerType()),
    T.StructField("hyperparameters", T.StringType()),
    T.StructField("metrics", T.StringType()),
    T.StructField("artifact_path", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
])

ANOMALY_LABELS = T.StructType([
    T.StructField("service_id", T.StringType()),
    T.StructField("window_start", T.TimestampType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("is_failure_window", T.BooleanType()),
])

# Wire payload of one api-log event (field names as on the topic).
API_LOG_PAYLOAD = T.StructType([
    T.StructField("service_id", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("http_method", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("request_bytes", T.IntegerType()),
    T.StructField("response_bytes", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("dedup_key", T.StringType()),
])


def envelope_schema(payload: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_version", T.StringType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("producer", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("payload", payload),
    ])
