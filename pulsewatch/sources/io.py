"""Sources and sinks.

Tables are parquet directories; ``api_logs`` is partitioned by request date,
``metrics`` by (window_size, month), so that the time-range and window-size
predicates of every read prune partitions before any file is opened.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

CORRUPT_COL = "_corrupt_record"


# ---- A1 stream source ----------------------------------------------------------

def read_api_log_events(spark: SparkSession, source: str = "kafka", path: str | None = None,
                        options: dict | None = None, streaming: bool = True) -> DataFrame:
    """Raw event bytes as a ``value`` STRING column (plus ``key`` when present).

    ``source='kafka'`` reads the ``api-logs`` topic from the earliest offset
    (needs the Kafka connector on the classpath); ``'text'`` / ``'json'`` read
    newline-delimited envelopes from files, which is what tests use.
    """
    opts = {"startingOffsets": "earliest", "subscribe": "api-logs"} if source == "kafka" else {}
    opts.update(options or {})
    reader = spark.readStream if streaming else spark.read
    if source == "kafka":
        df = reader.format("kafka").options(**opts).load()
        return df.select(F.col("key").cast("string").alias("key"),
                         F.col("value").cast("string").alias("value"),
                         "topic", "partition", "offset", "timestamp")
    if source in ("text", "json"):
        df = reader.options(**opts).format("text").load(path)
        return df.select(F.lit(None).cast("string").alias("key"), F.col("value"))
    raise ValueError(f"unknown source {source!r}")


# ---- A2 / A3 envelope ----------------------------------------------------------

def unwrap(df: DataFrame, payload_schema: T.StructType = S.API_LOG_PAYLOAD,
           value_col: str = "value") -> DataFrame:
    """Parse envelope JSON; unreadable text or wrong types land in ``_corrupt_record``."""
    schema = S.envelope_schema(payload_schema).add(CORRUPT_COL, T.StringType())
    parsed = F.from_json(F.col(value_col), schema,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL})
    # ``inline`` expands the parsed struct in one Generate node: without it the
    # optimizer inlines the parse into every extracted field (one JSON parse
    # per field per row).
    return df.select("*", F.inline(F.array(parsed)))


def event_id(event_type: str, natural_key: list[Column]) -> Column:
    """Deterministic event id: name-based UUID text from type + natural key (D3)."""
    h = F.sha2(F.concat_ws("|", F.lit(event_type), *natural_key), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def wrap(df: DataFrame, event_type: str, producer: str, natural_key: list[Column],
         occurred_at: Column, key: Column, payload_col: str = "payload") -> DataFrame:
    """Add ``key`` and ``value`` (envelope JSON, version "1", nulls dropped) columns."""
    env = F.struct(
        event_id(event_type, natural_key).alias("event_id"),
        F.lit(event_type).alias("event_type"),
        F.lit("1").alias("event_version"),
        occurred_at.alias("occurred_at"),
        F.lit(producer).alias("producer"),
        F.col(payload_col).alias("payload"),
    )
    return df.withColumn("key", key.cast("string")).withColumn(
        "value", F.to_json(env, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}))


# ---- A5 api_logs sink -------------------------------------------------------------

MAX_RECORDS_PER_FILE = 5_000_000


def write_api_logs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by request date.  Rows are rebalanced by date first: AQE packs
    the few rows of late days into one task and splits a day that is too large for
    one, so a batch writes about one file per date it touches and no task holds a
    hot day.  Files are capped and sorted by (service, time); a file spans the time
    of its batch only, so its min/max stats prune service and time predicates."""
    (df.withColumn("date", F.to_date("request_timestamp"))
       .hint("rebalance", "date")
       .sortWithinPartitions("date", "service_id", "request_timestamp")
       .write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
       .partitionBy("date").parquet(path))


def read_api_logs(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter((F.col("date") >= F.to_date(F.lit(since))) & (F.col("request_timestamp") >= F.lit(since)))
    if until is not None:
        df = df.filter((F.col("date") <= F.to_date(F.lit(until))) & (F.col("request_timestamp") < F.lit(until)))
    return df.drop("date")


SPANS, HOUR = 64, 3_600_000_000


def time_spans(batch: DataFrame) -> list[tuple[int, int]]:
    """Disjoint spans of time (microseconds, the end left out) that hold every
    request second of ``batch``: hours in a row make one span, and with more than
    SPANS of them those with the smallest gaps are joined, so a live batch with a
    few late logs has a few short spans and a backfill has one.  What comes to the
    driver is two numbers per hour of the calendar that the batch touches."""
    at = F.unix_micros(F.date_trunc("second", "request_timestamp"))
    hours = batch.filter(F.col("request_timestamp").isNotNull()).groupBy(F.floor(at / HOUR).alias("hour")) \
        .agg(F.min(at).alias("first"), (F.max(at) + 1_000_000).alias("last")).orderBy("first").collect()
    gaps = sorted(((b["first"] - a["last"], i + 1) for i, (a, b) in enumerate(zip(hours, hours[1:]))), reverse=True)
    cuts = sorted(i for gap, i in gaps[:SPANS - 1] if gap > HOUR)
    starts, ends = [0, *cuts], [*cuts, len(hours)]
    return [(hours[i]["first"], hours[j - 1]["last"]) for i, j in zip(starts, ends)] if hours else []


def stored_keys(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """(date, dedup_key) of the stored logs that rows of ``batch`` (with ``date``)
    could repeat: those of its dates (a static partition filter) within its spans
    of time, which the parquet reader holds against the stats of files and pages.
    So a batch reads keys in proportion to the time it covers, not whole days."""
    days = [r[0] for r in batch.select("date").distinct().collect()]
    inside = F.lit(False)
    for first, last in time_spans(batch):
        inside = inside | ((F.col("request_timestamp") >= F.timestamp_micros(F.lit(first))) & (F.col("request_timestamp") < F.timestamp_micros(F.lit(last))))
    return spark.read.parquet(path).filter(F.col("date").isin(days) & inside).select("date", "dedup_key")


# ---- A6 / A7 metrics scan -------------------------------------------------------

def _month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write metrics partitioned by (window_size, month); dynamic overwrite
    replaces only the partitions present in ``df``."""
    (df.withColumn("month", _month(F.col("window_start")))
       .sortWithinPartitions("window_size", "month", "service_id", "window_start")
       .write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
       .partitionBy("window_size", "month").parquet(path))


def load_metrics(spark: SparkSession, path: str, window_size: str = "1m",
                 since=None, until=None, service_id: str | None = None) -> DataFrame:
    """Metric rows of one window size in ``[since, until)``; 13 columns, numerics
    coerced with bad values -> null.  Window size and month prune partitions;
    the time range and service id are pushed to the parquet reader."""
    df = spark.read.parquet(path).filter(F.col("window_size") == window_size)
    if since is not None:
        s = F.lit(since).cast("timestamp")
        df = df.filter((F.col("month") >= _month(s)) & (F.col("window_start") >= s))
    if until is not None:
        u = F.lit(until).cast("timestamp")
        df = df.filter((F.col("month") <= _month(u)) & (F.col("window_start") < u))
    if service_id is not None:
        df = df.filter(F.col("service_id") == service_id)
    return coerce_metrics(df)


def coerce_metrics(df: DataFrame) -> DataFrame:
    """Project the 13 metric columns with the stored types; unparseable -> null."""
    cols = []
    types = {f.name: f.dataType for f in S.METRICS.fields}
    for c in S.METRIC_COLUMNS:
        if c in df.columns:
            cols.append(F.expr(f"try_cast(`{c}` as {types[c].simpleString()})").alias(c))
        else:
            cols.append(F.lit(None).cast(types[c]).alias(c))
    return df.select(*cols)


# ---- A8 CSV ------------------------------------------------------------------------

CSV_TS = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def write_metrics_csv(df: DataFrame, path: str) -> None:
    df.select(*S.METRIC_COLUMNS).write.mode("overwrite").option("header", True) \
        .option("timestampFormat", CSV_TS).csv(path)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([f for f in S.METRICS.fields if f.name in S.METRIC_COLUMNS])
    return spark.read.schema(schema).option("header", True).option("timestampFormat", CSV_TS).csv(path)


def write_labels_csv(df: DataFrame, path: str) -> None:
    df.select(*S.ANOMALY_LABELS.fieldNames()).write.mode("overwrite").option("header", True) \
        .option("timestampFormat", CSV_TS).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ANOMALY_LABELS).option("header", True) \
        .option("timestampFormat", CSV_TS).csv(path)


# ---- A9 / F4 keyed writes -----------------------------------------------------------

METRIC_KEY = ("service_id", "window_size", "window_start")


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on its file system (any Hadoop URI)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def folder_numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders ``name=n`` in ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [int(n.split("=", 1)[1]) for n in names if n.startswith(f"{name}=")]


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    if not table_exists(spark, path):
        return None
    return spark.read.parquet(path)


def _touched(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``existing`` in the (window_size, month) partitions ``df`` touches:
    a static partition filter from their list (sizes x months of the batch, a
    bounded few), so no other partition is read."""
    parts = df.select("window_size", _month(F.col("window_start")).alias("month")).distinct().collect()
    keep = F.lit(False)
    for size in sorted({p["window_size"] for p in parts if p["window_size"] is not None}):
        months = sorted({p["month"] for p in parts if p["window_size"] == size and p["month"] is not None})
        keep = keep | ((F.col("window_size") == size) & F.col("month").isin(months))
    return existing.filter(keep)


def load_metrics_if_absent(df: DataFrame, path: str) -> DataFrame:
    """Insert-if-absent (A9): staged rows deduplicated on the key, rows whose key
    already exists are dropped (existing row kept).  Returns the rows written."""
    spark = df.sparkSession
    # first staged row per key: a hash aggregate (partial per task), so many
    # copies of one key never meet unreduced in one task
    cols = [c for c in df.columns if c not in METRIC_KEY]
    staged = df.groupBy(*METRIC_KEY).agg(
        F.min_by(F.struct(*cols), F.coalesce(F.col("computed_at"), F.lit("9999-12-31").cast("timestamp")))
        .alias("_r")).select(*METRIC_KEY, "_r.*")
    existing = _existing(spark, path)
    if existing is not None:
        staged = staged.join(_touched(staged, existing).select(*METRIC_KEY), list(METRIC_KEY), "left_anti")
    staged = staged.select(*[f.name for f in S.METRICS.fields])
    staged.withColumn("month", _month(F.col("window_start"))) \
        .write.mode("append").partitionBy("window_size", "month").parquet(path)
    return staged


def upsert_metrics(df: DataFrame, path: str) -> None:
    """Idempotent upsert on (service, size, start) (F4): affected partitions are
    rewritten with the union of old and new rows, newest ``computed_at`` wins."""
    spark = df.sparkSession
    new = df.select(*[f.name for f in S.METRICS.fields]).withColumn("_src", F.lit(1))
    existing = _existing(spark, path)
    if existing is None:
        write_metrics(new.drop("_src"), path, mode="overwrite")
        return
    old = _touched(new, existing).drop("month").select(*[f.name for f in S.METRICS.fields]) \
        .withColumn("_src", F.lit(0))
    w = Window.partitionBy(*METRIC_KEY).orderBy(F.col("computed_at").desc_nulls_last(), F.col("_src").desc())
    merged = new.unionByName(old).withColumn("_rn", F.row_number().over(w)) \
        .filter("_rn = 1").drop("_rn", "_src")
    # The old rows are read from the partitions being replaced: materialise the
    # merge in the shared checkpoint folder first so the overwrite never reads
    # files it is deleting.
    from ..session import cut_lineage
    write_metrics(cut_lineage(merged), path, mode="overwrite")


# ---- A10 predictions ------------------------------------------------------------------

def write_predictions(df: DataFrame, path: str) -> None:
    df.select(*S.PREDICTIONS.fieldNames()).withColumn("date", F.to_date("generated_at")) \
        .write.mode("append").partitionBy("module", "date").parquet(path)


def model_version(now: dt.datetime | None = None) -> str:
    """Version string ``yyyyMMddTHHmmssZ``."""
    now = now or dt.datetime.now(dt.timezone.utc)
    return now.strftime("%Y%m%dT%H%M%SZ")


def repair_windows(api_logs: DataFrame, table, since, until, sizes=S.WINDOW_SIZES) -> DataFrame:
    """Late rows never reach streamed windows; recompute the windows that
    cover ``[since, until)`` from the stored logs and upsert them (F4) into
    ``table``, a ``MetricsTable`` or the path of a plain metrics table.  Logs
    that carry their partition column ``date`` are read from the dates of that
    range only.  Returns the recomputed rows, read back from the checkpoint."""
    from ..operators import metrics as M
    from ..session import cut_lineage
    # widen to whole windows of the largest size so no window is recomputed
    # partially (half-open: a window starting exactly at ``until`` is outside)
    step = max(S.WINDOW_MINUTES[s] for s in sizes) * 60_000_000
    bounds = api_logs.sparkSession.range(1).select(F.unix_micros(F.lit(since).cast("timestamp")).alias("lo"),
                                                   F.unix_micros(F.lit(until).cast("timestamp")).alias("hi")).first()
    lo, hi = bounds["lo"] // step * step, -(-bounds["hi"] // step) * step
    at = F.timestamp_micros
    logs = api_logs.filter((F.col("request_timestamp") >= at(F.lit(lo))) & (F.col("request_timestamp") < at(F.lit(hi))))
    if "date" in api_logs.columns:
        logs = logs.filter((F.col("date") >= F.to_date(at(F.lit(lo)))) & (F.col("date") <= F.to_date(at(F.lit(hi - 1)))))
    fresh = cut_lineage(M.aggregate_windows(logs, sizes=sizes))
    if isinstance(table, str):
        upsert_metrics(fresh, table)
    else:
        table.upsert(fresh)
    return fresh


CLIENT_KEY_BUCKETS = 64


def client_keys_path(path: str) -> str:
    """Where the client-supplied keys of the log table at ``path`` are kept."""
    return path.rstrip("/") + "-client-keys"


def append_api_logs(df: DataFrame, path: str, order=("ingested_at",), drop: tuple = ()) -> DataFrame:
    """A5/B5 batch ingest: keep the first delivery per dedup key by ``order``, drop
    keys the table already holds, append partitioned by date.  Columns of ``drop``
    (that only order) are not stored.  Returns the new rows.

    A computed key contains the request time cut to seconds, so its duplicate
    always falls in the same second: that check reads the keys of the spans of
    time the batch covers (``stored_keys``), and reads them from the log table
    itself, so a load that ended half-way is met when it is replayed.  A
    key that a client supplied (``client_dedup_key``) may come back on any
    date: those keys alone are kept in a table beside the logs, bucketed by
    their hash, and a batch is held against the buckets its own keys fall in.

    The batch is parsed, keyed and reduced once, into the checkpoint folder;
    the dates, the checks and the write all read that.
    """
    from ..operators import quality as QY
    from ..session import cut_lineage
    spark = df.sparkSession
    staged = cut_lineage(QY.dedup_first(df, order=order).drop(*drop).withColumn("date", F.to_date("request_timestamp")))
    supplied = F.col("client_dedup_key").isNotNull() & (F.length(F.trim("client_dedup_key")) > 0) \
        if "client_dedup_key" in staged.columns else F.lit(False)
    bucket = F.pmod(F.xxhash64("dedup_key"), F.lit(CLIENT_KEY_BUCKETS)).cast("int").alias("bucket")
    fresh = staged
    if table_exists(spark, path):
        fresh = fresh.join(stored_keys(spark, path, staged), ["date", "dedup_key"], "left_anti")
    keys_path = client_keys_path(path)
    mine = staged.filter(supplied).select("dedup_key", bucket)
    any_supplied = "client_dedup_key" in staged.columns and not mine.isEmpty()
    if any_supplied and table_exists(spark, keys_path):
        touched = [r[0] for r in mine.select("bucket").distinct().collect()]  # at most CLIENT_KEY_BUCKETS
        known = spark.read.parquet(keys_path).filter(F.col("bucket").isin(touched)).select("dedup_key")
        fresh = fresh.join(known, "dedup_key", "left_anti")
    # read before the tables below change; what met no table is stored already
    fresh = fresh.drop("date") if fresh is staged else cut_lineage(fresh.drop("date"))
    write_api_logs(fresh, path, mode="append")
    if any_supplied:
        fresh.filter(supplied).select("dedup_key", bucket).write.mode("append").partitionBy("bucket").parquet(keys_path)
    return fresh
