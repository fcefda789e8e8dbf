"""Structured Streaming jobs (J1-J10): the batch operators, run incrementally.

* ``ingest_sink``: one ``foreachBatch`` over the raw topic: parsed once, the
  dead letters and the logs written from it; duplicates are dropped inside
  the batch and against the stored keys.  No event-time watermark stands in
  front of the log table, so a log is stored however late it comes.
* ``metrics_stream``: api_logs -> watermark -> tumbling event-time windows
  (append mode: a window is emitted once, when the watermark passes its end;
  rows later than the watermark are repaired by a batch recompute from the
  stored logs, ``io.repair_windows``).  ``metrics_sink`` upserts them into the
  partitioned metrics table and can write the outgoing metric events.
* ``alerts_stream``: metric windows -> per-service state machine with
  ``applyInPandasWithState``; rows wait in the state until the lateness has
  passed and are taken in time order, an event-time timeout closes the alerts
  of a service that goes silent.
* ``latest_sink``: merges the newest prediction per (service, module) of a
  micro-batch into the stored view by key.

Sinks are idempotent per micro-batch: a replayed batch id rewrites its own
output, meets its own keys or upserts the same rows, so at-least-once delivery
with the checkpoint gives exactly-once tables (J7).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas as S
from ..functions import exprs as X
from ..operators import alerts as AL
from ..operators import constraints as CN
from ..operators import metrics as MX
from ..operators import quality as QY
from ..session import cut_lineage, ship_code
from ..sources import io as IO
from ..sources import versioned as VT


def batch_sink(path: str, partition_by: tuple = ()) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: batch N goes to ``path/batch_id=N`` (overwrite), so a
    retried batch replaces its own files and readers never see duplicates."""
    def write(df: DataFrame, batch_id: int) -> None:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path}/batch_id={batch_id}")
    return write


def ingest_sink(logs_path: str, dlq_path: str, services: DataFrame | None = None, arrival: tuple = ()) -> Callable[[DataFrame, int], None]:
    """A1-A5, B1-B5, B8, B9, J2, J10 as a foreachBatch writer over raw events.

    The batch is parsed once into the checkpoint folder; unreadable events,
    missing fields, (with ``services``) unknown services and rows that break a
    rule of the log table go to the dead letters, the first arrival per dedup
    key to the date-partitioned log table unless its key is stored already.
    A user id that is no UUID is stored as null (the key keeps what was sent).
    ``arrival`` names the columns that order deliveries (partition and offset of
    a topic); without them rows come in the order they are read."""
    def write(raw: DataFrame, batch_id: int) -> None:
        order = F.struct(*arrival) if arrival else F.monotonically_increasing_id()
        tagged = IO.unwrap(raw.withColumn("_arrival", order)).withColumn("_error", QY.route_error())
        if services is not None:
            # the ids of the registry alone, sent to every task: a join dealt out by service
            # would leave the batch, and all that follows, to as many tasks as it has services
            known = F.broadcast(services.select(F.col("id").alias("_sid")).distinct().withColumn("_known", F.lit(True)))
            tagged = tagged.join(known, F.col("payload.service_id") == F.col("_sid"), "left").withColumn(
                "_error", F.coalesce("_error", F.when(F.col("_known").isNull(), F.lit("unknown service")))).drop("_sid", "_known")
        rows = QY.default_status(QY.payload_rows(tagged, keep=("value", "_arrival", "_error")))
        broken = CN.failed_rules(CN.API_LOGS)
        rows = cut_lineage(rows.withColumn("_error", F.coalesce("_error", F.when(F.size(broken) > 0, F.concat(F.lit("violates: "), F.array_join(broken, ","))))))
        batch_sink(dlq_path)(rows.filter(F.col("_error").isNotNull()).select(
            F.col("value").alias("original"), F.col("_error").alias("error"), F.current_timestamp().alias("routedAt")), batch_id)
        kept = QY.parse_user_id(QY.with_dedup_key(rows.filter(F.col("_error").isNull()).drop("value", "_error")))
        IO.append_api_logs(kept, logs_path, order=("_arrival",), drop=("_arrival",))
    return write


def metrics_stream(api_logs: DataFrame, lateness: str = "10 minutes", size: str = "1m",
                   exact: bool = True) -> DataFrame:
    """Append-mode window metrics; same columns as the batch operator."""
    minutes = S.WINDOW_MINUTES[size]
    logs = api_logs.withWatermark("request_timestamp", lateness)
    pct = F.percentile(F.col("response_time_ms"), F.array(F.lit(0.95), F.lit(0.99))) if exact else \
        F.percentile_approx(F.col("response_time_ms"), F.array(F.lit(0.95), F.lit(0.99)), 10000).cast("array<double>")
    agg = logs.groupBy("service_id", F.window("request_timestamp", f"{minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("response_time_ms").alias("rt_sum"),
        F.count("response_time_ms").alias("rt_n"),
        F.sum(X.is_error("status_code").cast("int")).alias("n_err"), pct.alias("pct"))
    return agg.select(
        "service_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        F.lit(size).alias("window_size"), F.col("n").cast("int").alias("request_count"),
        X.half_up_ratio(F.col("n"), F.lit(minutes), 2, 10).alias("rpm"),
        X.half_up_ratio(F.col("rt_sum"), F.col("rt_n"), 2, 10).alias("response_time_mean"),
        X.dec2(F.col("pct")[0]).alias("response_time_p95"),
        X.dec2(F.col("pct")[1]).alias("response_time_p99"),
        X.half_up_ratio(F.col("n_err"), F.col("n"), 4, 5).alias("error_rate"),
        X.half_up_ratio(F.col("n") - F.col("n_err"), F.col("n"), 4, 5).alias("success_rate"),
        F.lit(None).cast("decimal(5,2)").alias("cpu_usage_pct"),
        F.lit(None).cast("decimal(5,2)").alias("memory_usage_pct"),
        F.current_timestamp().alias("computed_at"))


def histograms_sink(path: str) -> Callable[[DataFrame, int], None]:
    """J1/F2 as a foreachBatch writer over api_logs: each batch adds the exact
    1-minute latency histograms of its logs, by date.  Every window size is
    merged from them, and a late log only adds to its minute, so nothing is
    repaired from raw logs."""
    def write(logs: DataFrame, batch_id: int) -> None:
        counts = MX.window_counts(logs).withColumn("date", F.to_date("base_start"))
        batch_sink(path, ("date",))(counts, batch_id)
    return write


def windows_of(spark, path: str, sizes=S.WINDOW_SIZES, since=None, until=None) -> DataFrame:
    """Metric rows of the windows that start in ``[since, until)``, merged from
    the stored histograms; the dates of that range alone are read."""
    step = F.expr(f"INTERVAL {max(S.WINDOW_MINUTES[s] for s in sizes)} MINUTES")
    counts = spark.read.schema(f"{MX.COUNTS}, batch_id long, date date").option("basePath", path).parquet(path)
    if since is not None:
        at = F.lit(since).cast("timestamp")
        counts = counts.filter((F.col("date") >= F.to_date(at)) & (F.col("base_start") >= at))
    if until is not None:
        at = F.lit(until).cast("timestamp")
        counts = counts.filter((F.col("date") <= F.to_date(at + step)) & (F.col("base_start") < at + step))
    rows = MX.windows_from_counts(counts, sizes)
    if since is not None:  # windows that began before have only a part of their minutes here
        rows = rows.filter(F.col("window_start") >= F.lit(since).cast("timestamp"))
    return rows if until is None else rows.filter(F.col("window_start") < F.lit(until).cast("timestamp"))


def metric_events(metrics: DataFrame) -> DataFrame:
    """Metric rows as envelope JSON keyed by service id."""
    payload = F.struct(*[F.col(c) for c in S.METRIC_COLUMNS])
    return IO.wrap(metrics.withColumn("payload", payload), "metric", "analytics-service",
                   natural_key=[F.col("service_id"), F.col("window_size"), F.col("window_start").cast("string")],
                   occurred_at=F.col("window_end"), key=F.col("service_id")).select("key", "value")


def alert_events(alerts: DataFrame) -> DataFrame:
    """A3: alert rows as envelope JSON keyed by service id."""
    payload = F.struct(F.col("id").alias("alert_id"), "service_id", "triggering_metric", "severity", "message", "opened_at", "closed_at")
    return IO.wrap(alerts.withColumn("payload", payload), "alert", "analytics-service",
                   natural_key=[F.col("id"), F.coalesce(F.col("closed_at").cast("string"), F.lit("open"))],
                   occurred_at=F.coalesce("closed_at", "opened_at"), key=F.col("service_id")).select("key", "value")


def prediction_events(predictions: DataFrame) -> DataFrame:
    """A3: prediction rows as envelope JSON keyed by service id."""
    payload = F.struct("service_id", "module", "model_version", "generated_at", "horizon_minutes", "value", "confidence")
    return IO.wrap(predictions.withColumn("payload", payload), "prediction", "ml-service",
                   natural_key=[F.col("service_id"), F.col("module"), F.col("generated_at").cast("string"),
                                F.coalesce(F.col("horizon_minutes").cast("string"), F.lit(""))],
                   occurred_at=F.col("generated_at"), key=F.col("service_id")).select("key", "value")


def with_events(sink: Callable[[DataFrame, int], None], events_path: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that stores a batch by ``sink`` and then
    writes the outgoing events ``make`` forms of it (alert, prediction or health
    envelopes), per batch id, so a replayed batch replaces its own events."""
    def write(df: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(df)
        sink(rows, batch_id)
        batch_sink(events_path)(make(rows), batch_id)
    return write


def metrics_sink(path: str, events_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """Upsert the emitted windows into the merge-on-read metrics table
    (a batch writes its own rows, no month is rewritten); with ``events_path``
    also write their outgoing events."""
    def write(df: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(df)
        if not rows.isEmpty():
            VT.MetricsTable(rows.sparkSession, path).upsert(rows)
        if events_path is not None:
            batch_sink(events_path)(metric_events(rows), batch_id)
    return write


# ---- J4 alert state machine ---------------------------------------------------------------

ALERT_EVENT_SCHEMA = T.StructType([
    T.StructField("service_id", T.StringType()),
    T.StructField("triggering_metric", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("opened_at", T.TimestampType()),
    T.StructField("closed_at", T.TimestampType()),
    T.StructField("event", T.StringType()),
    T.StructField("p99", T.DoubleType()),          # of the window that opened the alert
    T.StructField("err", T.DoubleType()),
])
# newest window evaluated and seen (epoch us), the open alert per trigger
# ({trigger: [opened_us, severity, p99, err]}) and the rows that wait
# ({us: [p99, err]}), both as JSON: at most lateness / step rows a service
ALERT_STATE_SCHEMA = T.StructType([
    T.StructField("last_us", T.LongType()),
    T.StructField("seen_us", T.LongType()),
    T.StructField("open", T.StringType()),
    T.StructField("waiting", T.StringType()),
])


def _number(x) -> float:
    return float(x) if x is not None and x == x else 0.0


def evaluate_windows(sid: str, rows: list, last: int | None, opened: dict, upto: int, step_us: int,
                     p99_ms: float, error_rate: float) -> tuple[list, int | None]:
    """The open / close rule over ``rows`` (us, p99, err) in time order, then
    over the silence up to ``upto``.  ``opened`` is changed in place; returns
    (events, newest window evaluated)."""
    out = []

    def ts(us: int) -> pd.Timestamp:
        return pd.Timestamp(us, unit="us")

    def close_all(at_us: int) -> None:
        for trig in sorted(opened):
            o, sev, p, e = opened[trig]
            out.append((sid, trig, sev, ts(o), ts(at_us), "close", p, e))
        opened.clear()

    for us, p, e in rows:
        if last is not None and us > last + step_us:
            close_all(last + step_us)                 # a silent window closes everything
        trig = "latency" if p > p99_ms else ("error_rate" if e > error_rate else None)
        if trig is None:
            close_all(us)
        elif trig not in opened:
            high = 2 * (p99_ms if trig == "latency" else error_rate)
            sev = "critical" if (p if trig == "latency" else e) > high else "high"
            opened[trig] = [us, sev, p, e]
            out.append((sid, trig, sev, ts(us), None, "open", p, e))
        last = us
    if opened and last is not None and upto >= last + step_us:
        close_all(last + step_us)
    return out, last


def _alert_fn(step_us: int, lateness_us: int, p99_ms: float, error_rate: float):
    def fn(key, pdfs, state: GroupState):
        if state.exists:
            last, seen, opened, waiting = state.get
            opened, waiting = json.loads(opened), {int(k): v for k, v in json.loads(waiting).items()}
        else:
            last, seen, opened, waiting = None, None, {}, {}
        for pdf in pdfs or []:
            for ws, p99, err in zip(pdf["window_start"], pdf["response_time_p99"], pdf["error_rate"]):
                us = int(pd.Timestamp(ws).value // 1000)
                seen = us if seen is None else max(seen, us)
                if last is None or us > last:         # else evaluated before: a replay
                    waiting.setdefault(us, [_number(p99), _number(err)])
        mark = state.getCurrentWatermarkMs() * 1000
        upto = max(mark, seen - lateness_us) if seen is not None else mark
        ready = sorted(us for us in waiting if us <= upto)
        out, last = evaluate_windows(key[0], [(us, *waiting.pop(us)) for us in ready], last, opened, upto, step_us, p99_ms, error_rate)
        if last is None and not waiting:
            state.remove()
        else:
            state.update((last, seen, json.dumps(opened), json.dumps(waiting)))
            due = [*([min(waiting)] if waiting else []), *([last + step_us] if opened else [])]
            if due:                                   # called again once the watermark reaches it
                state.setTimeoutTimestamp(max(min(due) // 1000 - 1, state.getCurrentWatermarkMs()))
        return iter([pd.DataFrame(out, columns=ALERT_EVENT_SCHEMA.fieldNames())] if out else [])
    return fn


def alerts_stream(metrics: DataFrame, window_size: str = "1m", p99_ms: float = S.ALERT_P99_MS,
                  error_rate: float = S.ALERT_ERROR_RATE, lateness_minutes: int = 10) -> DataFrame:
    """Open / close events per service from a stream of closed windows.

    Rows may come in any order within ``lateness_minutes``: they wait in the
    service's state until the watermark (or the service's own newest row less
    the lateness) has passed them and are evaluated in time order.  The
    event-time timeout wakes a service whose waiting rows or silent window
    have become due (the "no row" rule).
    """
    ship_code(metrics.sparkSession)
    step_us = S.WINDOW_MINUTES[window_size] * 60_000_000
    m = metrics.filter(F.col("window_size") == window_size).select(
        "service_id", "window_start", F.col("response_time_p99").cast("double").alias("response_time_p99"),
        F.col("error_rate").cast("double").alias("error_rate")).withWatermark("window_start", f"{lateness_minutes} minutes")
    events = m.groupBy("service_id").applyInPandasWithState(
        _alert_fn(step_us, lateness_minutes * 60_000_000, p99_ms, error_rate), ALERT_EVENT_SCHEMA, ALERT_STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
    t = F.col("triggering_metric")
    return events.select(
        AL.alert_id(F.col("service_id"), t, F.col("opened_at")).alias("id"), "service_id", "triggering_metric", "severity",
        X.alert_message(t, F.col("p99").cast("decimal(10,2)"), F.col("err").cast("decimal(5,4)"), p99_ms, error_rate).alias("message"),
        "opened_at", "closed_at", "event")


# ---- J9 latest view ---------------------------------------------------------------------------

LATEST_KEY = ("service_id", "module")


def newest(predictions: DataFrame) -> DataFrame:
    """Newest prediction per (service, module); ties to the larger version, then value."""
    return predictions.groupBy(*LATEST_KEY).agg(
        F.max(F.struct("generated_at", "model_version", "value")).alias("latest")).select(*LATEST_KEY, "latest.*")


def latest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Keyed upsert of a micro-batch into the view: batch N writes version N,
    the newest rows of the last version before it and of the batch.  Versions
    before that one are removed, so the view is stored twice at most."""
    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = newest(df)
        if IO.table_exists(spark, path):
            kept = spark.read.parquet(path).filter(F.col("version") < batch_id)
            last = kept.agg(F.max("version")).first()[0]
            if last is not None:
                rows = newest(rows.unionByName(kept.filter(F.col("version") == last).select(rows.columns)))
        rows.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        if IO.table_exists(spark, path):
            older = [v for v in IO.folder_numbers(spark, path, "version") if v < batch_id]
            for v in sorted(older)[:-1]:   # a replay of this batch reads the newest of them
                IO.remove_folder(spark, f"{path}/version={v}")
    return write


def read_latest(spark, path: str) -> DataFrame:
    """The view's newest version."""
    view = spark.read.parquet(path)
    last = view.agg(F.max("version")).first()[0]
    return view.filter(F.col("version") == last).drop("version")


class state_partitions:
    """Context manager: start streaming queries with ``n`` state partitions
    (default: the cluster's default parallelism).  The number of state
    partitions is fixed in the checkpoint when a query first starts, so it is
    sized to the cluster here instead of the batch default of 200; the
    session value is restored afterwards."""

    def __init__(self, spark, n: int | None = None):
        self.spark = spark
        self.n = n or max(1, spark.sparkContext.defaultParallelism)

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))
        return self

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.shuffle.partitions", self.old)
        return False


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = "1 minute",
          mode: str = "append"):
    """Run a job on the product's cadence (``processingTime`` trigger,
    default one minute) or drain what is available (``trigger=None``), with
    its checkpoint in shared storage and an idempotent per-batch sink."""
    w = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)
    with state_partitions(df.sparkSession):
        return w.start()


def health_events(health: DataFrame) -> DataFrame:
    """Health scores as ``service-health`` envelopes keyed by service id."""
    payload = F.struct("service_id", F.col("window_start").alias("timestamp"),
                       F.col("health_score").alias("score"), F.col("health_status").alias("status"), "components")
    return IO.wrap(health.withColumn("payload", payload), "service_health", "ml-service",
                   natural_key=[F.col("service_id"), F.col("window_start").cast("string")],
                   occurred_at=F.col("window_start"), key=F.col("service_id")).select("key", "value")
