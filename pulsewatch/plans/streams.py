"""Streaming plans: the given tables arrive in several out-of-order
micro-batches.  Every delivery is one ``trigger(availableNow=True)`` run from
the same checkpoint, so each plan also restarts its query between batches;
what the sinks hold afterwards is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import views as V
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as FX
from ..sources import versioned as VT
from ..streaming import jobs as J
from . import sqlparts as Q
from .alerting import LIFECYCLE_SQL, lifecycle
from .core import metrics_of
from .ingest import FEED, VALID, sql_dedup_key
from .registry import plan

BATCHES = 4
LOG_LATENESS_MINUTES = 10
DELAY_MINUTES = 8          # logs arrive up to so many minutes late, by event id
ALERT_LATENESS_MINUTES = 360
ALERT_DELAY_HOURS = 5      # windows arrive up to so many hours late


def _deliver(part, folder: str, run) -> None:
    """Append each batch, ``part`` of its number, to ``folder`` and run the query over it."""
    for b in range(BATCHES):
        part(b).write.mode("append").parquet(folder)
        run().awaitTermination()


def _parts(rows: DataFrame):
    """The rows of a batch by its number, which they bear in ``batch``.  The rows are
    derived anew for each batch: for tables, or rows that are stored."""
    return lambda b: rows.where(F.col("batch") == b).drop("batch")


def _source(rows: DataFrame, folder: str) -> DataFrame:
    """A stream over a folder that holds no delivery yet."""
    empty = rows.drop("batch").limit(0)
    empty.write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(empty.schema).parquet(folder)


def run_metrics(spark: SparkSession, sf_dir: str, size: str) -> str:
    base = scratch_path(spark, f"stream-metrics-{uuid.uuid4().hex}")
    ev = FX.read_table(spark, sf_dir, "events")
    # by the minute of arrival: the month in BATCHES parts, with late rows across each cut
    arrives = F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.pmod(F.col("event_id"), F.lit(DELAY_MINUTES)).cast("int"))
    ev = ev.withColumn("batch", F.least(F.floor((F.dayofmonth(arrives) - 1) / 8), F.lit(BATCHES - 1)))
    stream = _source(ev, f"{base}/in")
    m = J.metrics_stream(FX.api_logs(stream), lateness=f"{LOG_LATENESS_MINUTES} minutes", size=size)
    sink = J.metrics_sink(f"{base}/metrics", f"{base}/events")
    _deliver(_parts(ev), f"{base}/in", lambda: J.start(m, sink, f"{base}/_ckpt", trigger=None))
    return base


CLOSED_SQL = f"""closed AS (
  SELECT * FROM metrics
  WHERE window_end <= (SELECT date_trunc('milliseconds', max(request_timestamp)) FROM api_logs) - INTERVAL '{LOG_LATENESS_MINUTES} minutes')"""


@plan("stream_metrics", sql=f"""
{Q.with_metrics('1m')}, {CLOSED_SQL}
SELECT * FROM closed""")
def stream_metrics(spark, sf_dir):
    """1m windows from the events stream, upserted into the
    partitioned metrics table; windows still open at the last watermark
    (newest log less ten minutes) stay unreported."""
    base = run_metrics(spark, sf_dir, "1m")
    return VT.MetricsTable(spark, f"{base}/metrics").read("1m").select(*S.METRIC_COLUMNS)


@plan("stream_histograms", sql=f"""
WITH {Q.API_LOGS},
m1 AS ({Q.metrics('1m')}), m5 AS ({Q.metrics('5m')}), m60 AS ({Q.metrics('1h')})
SELECT * FROM m1 UNION ALL SELECT * FROM m5 UNION ALL SELECT * FROM m60""")
def stream_histograms(spark, sf_dir):
    """Four out-of-order deliveries leave 1-minute histograms; all three
    window sizes are merged from them, late logs included, raw logs read once."""
    base = scratch_path(spark, f"stream-histograms-{uuid.uuid4().hex}")
    ev = FX.read_table(spark, sf_dir, "events").withColumn("batch", F.pmod("event_id", F.lit(BATCHES)))
    stream = FX.api_logs(_source(ev, f"{base}/in"))
    _deliver(_parts(ev), f"{base}/in", lambda: J.start(stream, J.histograms_sink(f"{base}/counts"), f"{base}/_ckpt", trigger=None))
    return J.windows_of(spark, f"{base}/counts").select(*S.METRIC_COLUMNS)


@plan("stream_metric_events", sql=f"""
{Q.with_metrics('1h')}, {CLOSED_SQL}
SELECT service_id AS key, service_id, window_start, request_count, 'metric' AS event_type, '1' AS event_version,
       'analytics-service' AS producer
FROM closed""")
def stream_metric_events(spark, sf_dir):
    """The outgoing metric events of the streamed hourly windows, parsed back."""
    base = run_metrics(spark, sf_dir, "1h")
    sent = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/events")
    payload = "service_id string, window_start timestamp, request_count int"
    got = sent.select("key", F.from_json("value", f"event_type string, event_version string, producer string, payload struct<{payload}>").alias("e"))
    return got.select("key", "e.payload.*", "e.event_type", "e.event_version", "e.producer")


@plan("stream_alerts", sql=f"""
{Q.with_metrics('1h')}, {LIFECYCLE_SQL},
mark AS (SELECT max(window_start) - INTERVAL '{ALERT_LATENESS_MINUTES} minutes' AS at FROM metrics),
ends AS (SELECT f.service_id, f.trig, f.window_start, i.iend + INTERVAL '1 hour' AS closed_at,
                CASE WHEN f.trig = 'latency'
                     THEN 'P99 latency ' || CAST(CAST(floor(f.response_time_p99 + 0.5) AS BIGINT) AS VARCHAR) || ' ms exceeds threshold 2000 ms'
                     ELSE 'Error rate ' || printf('%.2f', CAST(f.error_rate AS DOUBLE) * 100) || '% exceeds threshold 10%' END AS message
         FROM firsts f JOIN isl i ON f.service_id = i.service_id AND f.isl = i.isl)
SELECT a.id, a.service_id, a.triggering_metric, a.severity, e.message, a.opened_at, CAST(NULL AS TIMESTAMP) AS closed_at, 'open' AS event
FROM alerts_out a JOIN ends e ON a.service_id = e.service_id AND a.triggering_metric = e.trig AND a.opened_at = e.window_start, mark
WHERE a.opened_at <= mark.at
UNION ALL
SELECT a.id, a.service_id, a.triggering_metric, a.severity, e.message, a.opened_at, e.closed_at, 'close'
FROM alerts_out a JOIN ends e ON a.service_id = e.service_id AND a.triggering_metric = e.trig AND a.opened_at = e.window_start, mark
WHERE e.closed_at <= mark.at""")
def stream_alerts(spark, sf_dir):
    """Hourly metric rows, up to five hours out of order, through the
    per-service alert state machine; events up to the last watermark (newest
    window less six hours)."""
    base = scratch_path(spark, f"stream-alerts-{uuid.uuid4().hex}")
    m = metrics_of(spark, sf_dir, "1h").select(*S.METRIC_COLUMNS)
    late = F.pmod(F.xxhash64("service_id", "window_start"), F.lit(ALERT_DELAY_HOURS + 1)).cast("int")
    m = cut_lineage(m.withColumn("batch", F.least(F.floor((F.dayofmonth(F.col("window_start") + F.make_dt_interval(hours=late)) - 1) / 8), F.lit(BATCHES - 1))))
    stream = _source(m, f"{base}/in")
    alerts = J.alerts_stream(stream, window_size="1h", lateness_minutes=ALERT_LATENESS_MINUTES)
    _deliver(_parts(m), f"{base}/in", lambda: J.start(alerts, J.batch_sink(f"{base}/out"), f"{base}/_ckpt", trigger=None))
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/out").select(
        "id", "service_id", "triggering_metric", "severity", "message", "opened_at", "closed_at", "event")


@plan("stream_ingest", sql=f"""
WITH {Q.API_LOGS}, {FEED}, {VALID}, {Q.SERVICES},
keyed AS (SELECT *, {sql_dedup_key()} AS dedup_key FROM valid WHERE service_id IN (SELECT id FROM services)),
firsts AS (SELECT * FROM keyed
           QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY event_id % {BATCHES}, event_id, delivery) = 1)
SELECT dedup_key, service_id, endpoint, CAST(status_code AS SMALLINT) AS status_code, response_time_ms,
       request_timestamp, CAST(request_timestamp AS DATE) AS date
FROM firsts""")
def stream_ingest(spark, sf_dir):
    """Envelope text in out-of-order deliveries -> one parse
    -> dead letters (unknown services too) and first arrivals per key in the
    date-partitioned log table, however late they are."""
    return _ingested(spark, sf_dir)[0]


@plan("stream_dead_letters", sql=f"""
WITH {Q.API_LOGS}, {FEED}, {Q.SERVICES}
SELECT error, count(*) AS n FROM (
  SELECT CASE WHEN event_id % {FX.CORRUPT_MOD} = {FX.CORRUPT_REM} THEN 'malformed envelope'
              WHEN endpoint IS NULL THEN 'payload missing required fields'
              WHEN service_id NOT IN (SELECT id FROM services) THEN 'unknown service' END AS error
  FROM feed) t
WHERE error IS NOT NULL GROUP BY error""")
def stream_dead_letters(spark, sf_dir):
    """Dead letters of the streamed ingest by reason."""
    return _ingested(spark, sf_dir)[1].groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = scratch_path(spark, f"stream-ingest-{uuid.uuid4().hex}")
    ev = FX.read_table(spark, sf_dir, "events")

    def feed(b: int) -> DataFrame:
        """Batch b, chosen before the envelopes are made: each is made once.  seq and delivery stand for the offset."""
        return FX.api_log_envelopes(ev.where(F.pmod("event_id", F.lit(BATCHES)) == b)).select("seq", "delivery", "value")

    raw = _source(feed(0), f"{base}/topic")
    sink = J.ingest_sink(f"{base}/api_logs", f"{base}/dlq", FX.services(spark), arrival=("seq", "delivery"))
    _deliver(feed, f"{base}/topic", lambda: J.start(raw, sink, f"{base}/_ckpt", trigger=None))
    logs = spark.read.parquet(f"{base}/api_logs").select(
        "dedup_key", "service_id", "endpoint", "status_code", "response_time_ms", "request_timestamp", "date")
    return logs, spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/dlq")


@plan("outgoing_events", sql=f"""
{Q.with_metrics('1h')}, {LIFECYCLE_SQL},
sent AS (
  SELECT 'alert' AS event_type, 'analytics-service' AS producer, service_id AS key, id AS subject, severity AS detail FROM alerts_out
  UNION ALL SELECT 'prediction', 'ml-service', service_id, 'anomaly', '{S.HEURISTIC_MODEL_VERSION}' FROM metrics
  UNION ALL SELECT 'service_health', 'ml-service', service_id, service_id, NULL FROM (SELECT DISTINCT service_id FROM metrics))
SELECT event_type, producer, key, subject, detail, count(*) AS n FROM sent GROUP BY ALL""")
def outgoing_events(spark, sf_dir):
    """Alert, prediction and service-health events written beside the
    rows they tell of (a second delivery of a batch replaces its events), read
    back and parsed."""
    base = scratch_path(spark, f"outgoing-{uuid.uuid4().hex}")
    m = metrics_of(spark, sf_dir, "1h")
    rows = {"alert": (lifecycle(spark, sf_dir).withColumn("message", F.lit("m")), J.alert_events),
            "prediction": (V.anomaly_predictions(m), J.prediction_events), "health": (V.health_tile(m, "1h"), J.health_events)}
    out = None
    for name, (df, make) in rows.items():
        write = J.with_events(J.batch_sink(f"{base}/{name}"), f"{base}/{name}-events", make)
        write(df, 0)
        write(df, 0)
        sent = spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/{name}-events")
        out = sent if out is None else out.unionByName(sent)
    payload = "service_id string, alert_id string, severity string, module string, model_version string"
    e = out.select("key", F.from_json("value", f"event_type string, event_version string, producer string, payload struct<{payload}>").alias("e")) \
        .where((F.col("key") == F.col("e.payload.service_id")) & (F.col("e.event_version") == "1"))
    return e.select("e.event_type", "e.producer", "key", F.coalesce("e.payload.alert_id", "e.payload.module", "key").alias("subject"),
                    F.coalesce("e.payload.severity", "e.payload.model_version").alias("detail")) \
        .groupBy("event_type", "producer", "key", "subject", "detail").agg(F.count(F.lit(1)).alias("n"))
