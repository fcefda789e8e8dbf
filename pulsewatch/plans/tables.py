"""Table maintenance plans: service feed, cascade, retention, keyed writes, runs."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import maintain as MT
from ..operators import metrics as M
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import io as IO
from ..sources import versioned as VT
from . import sqlparts as Q
from .core import logs, metrics_of
from .ingest import FEED, VALID, sql_dedup_key
from .registry import plan

RETENTION_OWNER, RETENTION_SINCE = "commerce", "2024-01-20 00:00:00"
PASS1_AT, PASS2_AT = dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 2)


def _requests(spark, sf_dir):
    """Create requests derived from traffic: each (service, user parity) seen
    asks for a service named like the user's service, in production (even
    users) or staging (odd users)."""
    ev = FX.read_table(spark, sf_dir, "events")
    seen = ev.select(FX.service_of_user().alias("sid"),
                     F.when(F.pmod("user_id", F.lit(2)) == 0, "production").otherwise("staging").alias("environment"),
                     F.col("event_id")).groupBy("sid", "environment").agg(F.min("event_id").alias("request_seq"))
    dim = FX.services(spark).select(F.col("id").alias("sid"), "name", "base_url", "owner", "description")
    return seen.join(dim, "sid").select(
        F.concat(F.col("sid"), F.lit("-"), F.col("environment")).alias("id"), "name", "base_url", "owner",
        "environment", "description", F.lit(None).cast("boolean").alias("capture_telemetry"),
        F.lit(None).cast("string").alias("created_by"), "request_seq")


REQ_SQL = f"""
seen AS (SELECT 'svc-' || CAST(user_id % 5 AS VARCHAR) AS sid,
                CASE WHEN user_id % 2 = 0 THEN 'production' ELSE 'staging' END AS environment,
                min(event_id) AS request_seq
         FROM events GROUP BY 1, 2),
req AS (SELECT seen.*, s.name FROM seen JOIN services s ON seen.sid = s.id)"""


@plan("service_conflicts", sql=f"""
WITH {Q.SERVICES}, {REQ_SQL}
SELECT request_seq, name, environment,
       CASE WHEN EXISTS (SELECT 1 FROM services s WHERE s.name = req.name AND s.environment = req.environment)
            THEN 'conflict: name and environment exist' ELSE 'accepted' END AS outcome
FROM req""")
def service_conflicts(spark, sf_dir):
    """M2/M5: create requests split into accepted rows and conflicts."""
    accepted, conflicts = MT.create_services(FX.services(spark), _requests(spark, sf_dir))
    req = _requests(spark, sf_dir).select("id", "request_seq")
    a = accepted.join(req, "id").select("request_seq", "name", "environment", F.lit("accepted").alias("outcome"))
    c = conflicts.select("request_seq", "name", "environment", F.col("reason").alias("outcome"))
    return a.unionByName(c)


@plan("service_patch", sql=f"""
WITH {Q.API_LOGS}, {Q.SERVICES},
p AS (SELECT service_id AS id, max(request_timestamp) AS last_seen FROM api_logs GROUP BY service_id)
SELECT s.id, s.name, s.owner, coalesce('last request ' || strftime(p.last_seen, '%Y-%m-%d %H:%M:%S'), s.description) AS description,
       s.capture_telemetry, CASE WHEN p.id IS NOT NULL THEN p.last_seen ELSE TIMESTAMP '{FX.SERVICES_CREATED_AT}' END AS updated_at
FROM services s LEFT JOIN p ON s.id = p.id""")
def service_patch(spark, sf_dir):
    """M3: a patch feed from traffic (description = last request time); null
    fields keep their value, ``updated_at`` moves on patched rows."""
    last = logs(spark, sf_dir).groupBy("service_id").agg(F.max("request_timestamp").alias("last_seen"))
    patches = last.select(F.col("service_id").alias("id"),
                          F.concat(F.lit("last request "), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))
                          .alias("description"),
                          F.lit(None).cast("string").alias("owner"), "last_seen")
    # ``now`` of each patch is the service's last request (replayable)
    patched = FX.services(spark).join(patches.select("id", F.col("last_seen").alias("_now")), "id", "left")
    out = MT.patch_services(patched, patches.drop("last_seen"),
                            now=F.coalesce(F.col("_now"), F.col("updated_at")))
    return out.select("id", "name", "owner", "description", "capture_telemetry", "updated_at")


def _delete_ids(spark, sf_dir):
    """Delete requests: services that do not capture telemetry, plus every
    unregistered service id seen on the feed."""
    feed = FX.api_log_payloads(FX.read_table(spark, sf_dir, "events"))
    unknown = feed.select(F.col("service_id").alias("id")).distinct() \
        .join(FX.services(spark).select("id"), "id", "left_anti")
    off = FX.services(spark).filter(~F.col("capture_telemetry")).select("id")
    return off.unionByName(unknown)


@plan("service_delete_cascade", sql=f"""
WITH {Q.API_LOGS}, {Q.SERVICES}
SELECT service_id, count(*) AS remaining_logs FROM api_logs
WHERE service_id NOT IN (SELECT id FROM services WHERE NOT capture_telemetry)
GROUP BY service_id""")
def service_delete_cascade(spark, sf_dir):
    """M4: delete services; their logs are removed with them (remaining per service)."""
    ids = _delete_ids(spark, sf_dir)
    kept, _ = MT.delete_services(FX.services(spark), ids)
    deleted = FX.services(spark).join(kept.select("id"), "id", "left_anti")
    rest = MT.cascade(logs(spark, sf_dir), deleted)
    return rest.groupBy("service_id").agg(F.count(F.lit(1)).alias("remaining_logs"))


@plan("service_delete_unknown", sql=f"""
WITH {Q.API_LOGS}, {FEED}, {Q.SERVICES}
SELECT DISTINCT service_id AS id FROM feed WHERE service_id NOT IN (SELECT id FROM services)""")
def service_delete_unknown(spark, sf_dir):
    """M4: requested ids that matched no service are reported."""
    _, unknown = MT.delete_services(FX.services(spark), _delete_ids(spark, sf_dir))
    return unknown


@plan("retention_delete", sql=f"""
{Q.with_metrics('1h')}, {Q.SERVICES},
tagged AS (SELECT m.service_id,
                  m.window_start >= TIMESTAMP '{RETENTION_SINCE}'
                  AND m.service_id IN (SELECT id FROM services WHERE owner = '{RETENTION_OWNER}') AS gone
           FROM metrics m)
SELECT service_id, CAST(sum(CASE WHEN gone THEN 0 ELSE 1 END) AS BIGINT) AS kept_rows,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS removed_rows
FROM tagged GROUP BY service_id""")
def retention_delete(spark, sf_dir):
    """M7/E5: remove one owner's hourly rows from a date on; counts kept / removed."""
    m = metrics_of(spark, sf_dir, "1h")
    kept, removed = MT.retention_delete(m, FX.services(spark), RETENTION_OWNER, RETENTION_SINCE)
    k = kept.groupBy("service_id").agg(F.count(F.lit(1)).alias("kept_rows"))
    r = removed.groupBy("service_id").agg(F.count(F.lit(1)).alias("removed_rows"))
    return k.join(r, "service_id", "full").select(
        "service_id", F.coalesce("kept_rows", F.lit(0)).alias("kept_rows"),
        F.coalesce("removed_rows", F.lit(0)).alias("removed_rows"))


def _passes(spark, sf_dir):
    """Pass 1 sees the logs without error requests (late arrivals), pass 2 all logs."""
    lg = logs(spark, sf_dir)
    early = lg.filter(F.col("status_code") < 400)
    p1 = M.aggregate_windows(early, sizes=("1h",), computed_at=F.lit(PASS1_AT).cast("timestamp"))
    p2 = M.aggregate_windows(lg, sizes=("1h",), computed_at=F.lit(PASS2_AT).cast("timestamp"))
    return p1, p2


@plan("metrics_upsert", sql=f"{Q.with_metrics('1h')}\nSELECT * FROM metrics")
def metrics_upsert(spark, sf_dir):
    """Write pass 1, upsert the recomputed pass 2; the table ends equal
    to the full recomputation (newest ``computed_at`` wins per key)."""
    p1, p2 = _passes(spark, sf_dir)
    path = scratch_path(spark, f"metrics-upsert-{uuid.uuid4().hex}")
    IO.write_metrics(p1, path)
    IO.upsert_metrics(p2, path)
    IO.upsert_metrics(p2, path)   # rerun: idempotent
    return IO.load_metrics(spark, path, window_size="1h")


@plan("insert_if_absent", sql=f"""
WITH {Q.API_LOGS},
early AS (SELECT * FROM api_logs WHERE status_code < 400),
p1 AS ({Q.metrics('1h', src='early')}),
p2 AS ({Q.metrics('1h')})
SELECT * FROM p1
UNION ALL
SELECT * FROM p2 WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.service_id = p2.service_id
                                    AND p1.window_start = p2.window_start)""")
def insert_if_absent(spark, sf_dir):
    """Bulk load that keeps existing keys: pass 1 rows stay, only new keys
    of pass 2 are added (twice, to show the rerun adds nothing)."""
    p1, p2 = _passes(spark, sf_dir)
    path = scratch_path(spark, f"metrics-insert-{uuid.uuid4().hex}")
    IO.write_metrics(p1, path)
    IO.load_metrics_if_absent(p2, path)
    IO.load_metrics_if_absent(p2, path)
    return IO.load_metrics(spark, path, window_size="1h")


@plan("active_model_runs", sql=f"""
{Q.with_metrics('1h')},
days AS (SELECT CAST(window_start AS DATE) AS d, count(*) AS n FROM metrics GROUP BY 1),
cum AS (SELECT d, sum(n) OVER (ORDER BY d) AS rows_to_date FROM days),
mods AS (SELECT * FROM (VALUES {", ".join(f"('{m}')" for m in S.MODULES)}) AS t(module)),
runs AS (SELECT module, CAST(d AS TIMESTAMP) + INTERVAL '1 day' AS trained_at, CAST(rows_to_date AS INTEGER) AS training_rows
         FROM mods CROSS JOIN cum)
SELECT module, strftime(trained_at, '%Y%m%dT%H%M%SZ') AS model_version, trained_at, training_rows
FROM runs QUALIFY row_number() OVER (PARTITION BY module ORDER BY trained_at DESC) = 1""")
def active_model_runs(spark, sf_dir):
    """One training run per module per day of data; newest is active."""
    m = metrics_of(spark, sf_dir, "1h")
    days = m.groupBy(F.to_date("window_start").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    cum = days.withColumn("rows_to_date", F.sum("n").over(Window.orderBy("d")))   # one row per day
    mods = spark.createDataFrame([(x,) for x in S.MODULES], "module string")
    runs = mods.crossJoin(cum).select(
        "module", (F.col("d").cast("timestamp") + F.make_dt_interval(days=F.lit(1))).alias("trained_at"),
        F.col("rows_to_date").cast("int").alias("training_rows"))
    runs = runs.withColumn("model_version", F.date_format("trained_at", "yyyyMMdd'T'HHmmss'Z'"))
    return MT.active_runs(runs).filter("is_active").select("module", "model_version", "trained_at", "training_rows")


@plan("api_logs_table", sql=f"""
WITH {Q.API_LOGS}
SELECT CAST(request_timestamp AS DATE) AS date, service_id, count(*) AS requests,
       CAST(sum(response_time_ms) AS BIGINT) AS total_ms
FROM api_logs GROUP BY 1, 2""")
def api_logs_table(spark, sf_dir):
    """A5: api_logs written partitioned by request date and scanned back whole."""
    path = scratch_path(spark, f"api-logs-{uuid.uuid4().hex}")
    IO.write_api_logs(logs(spark, sf_dir).drop("event_id"), path, mode="overwrite")
    back = spark.read.parquet(path)
    return back.groupBy("date", "service_id").agg(F.count(F.lit(1)).alias("requests"),
                                                 F.sum("response_time_ms").cast("long").alias("total_ms"))


@plan("load_summary", sql=f"""
WITH {Q.API_LOGS},
m AS ({Q.metrics('1m')} UNION ALL {Q.metrics('5m')} UNION ALL {Q.metrics('1h')})
SELECT window_size, count(*) AS rows, count(DISTINCT service_id) AS services FROM m GROUP BY window_size""")
def load_summary(spark, sf_dir):
    """rows and distinct services loaded, per window size."""
    m = M.aggregate_windows(logs(spark, sf_dir))
    return m.groupBy("window_size").agg(F.count(F.lit(1)).alias("rows"),
                                        F.countDistinct("service_id").alias("services"))


@plan("service_insert", sql=f"""
WITH {Q.API_LOGS}, {FEED}, {Q.SERVICES}
SELECT id, capture_telemetry FROM services
UNION ALL
SELECT DISTINCT service_id, true FROM feed WHERE service_id NOT IN (SELECT id FROM services)""")
def service_insert(spark, sf_dir):
    """M1: services first seen on the feed are inserted with defaults; known
    ids stay untouched (a rerun inserts nothing)."""
    feed = FX.api_log_payloads(FX.read_table(spark, sf_dir, "events"))
    seen = feed.select(F.col("service_id").alias("id")).distinct()
    new = seen.select(
        "id", F.col("id").alias("name"), F.lit("http://unknown").alias("base_url"),
        F.lit(None).cast("string").alias("owner"), F.lit("development").alias("environment"),
        F.lit("discovered on the api-logs feed").alias("description"), F.lit(True).alias("capture_telemetry"),
        F.lit(None).cast("string").alias("created_by"), F.lit(FX.SERVICES_CREATED_AT).alias("created_at"),
        F.lit(FX.SERVICES_CREATED_AT).alias("updated_at"))
    once = MT.insert_services(FX.services(spark), new)
    twice = MT.insert_services(once, new)
    return twice.select("id", "capture_telemetry")


REPAIR_SINCE, REPAIR_UNTIL = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


@plan("metrics_repair", sql=f"""
WITH {Q.API_LOGS},
early AS (SELECT * FROM api_logs WHERE status_code < 400),
p1 AS ({Q.metrics('1h', src='early')}),
p2 AS ({Q.metrics('1h')})
SELECT * FROM p1 WHERE window_start < TIMESTAMP '{REPAIR_SINCE}' OR window_start >= TIMESTAMP '{REPAIR_UNTIL}'
UNION ALL
SELECT * FROM p2 WHERE window_start >= TIMESTAMP '{REPAIR_SINCE}' AND window_start < TIMESTAMP '{REPAIR_UNTIL}'""")
def metrics_repair(spark, sf_dir):
    """The table holds windows computed before late rows arrived; a
    repair recomputes the windows of a time range from all stored logs and
    upserts them.  Returns the whole table after the repair."""
    p1, _ = _passes(spark, sf_dir)
    base = scratch_path(spark, f"metrics-repair-{uuid.uuid4().hex}")
    IO.write_api_logs(logs(spark, sf_dir), f"{base}/logs")
    table = VT.MetricsTable(spark, f"{base}/metrics")
    table.upsert(p1)
    IO.repair_windows(spark.read.parquet(f"{base}/logs"), table, REPAIR_SINCE, REPAIR_UNTIL, sizes=("1h",))
    return table.read("1h").select(*S.METRIC_COLUMNS)


@plan("durable_delete", sql=f"""
{Q.with_metrics('1h')}, {Q.SERVICES},
gone AS (SELECT m.service_id, m.window_start, m.service_id IN (SELECT id FROM services WHERE owner = '{RETENTION_OWNER}') AND m.window_start >= TIMESTAMP '{RETENTION_SINCE}' AS retention,
                m.service_id IN (SELECT id FROM services WHERE NOT capture_telemetry) AS cascade FROM metrics m)
SELECT 'retention' AS step, service_id, count(*) AS rows_left, (SELECT count(*) FROM gone WHERE retention) AS removed FROM gone WHERE NOT retention GROUP BY service_id
UNION ALL SELECT 'cascade', service_id, count(*), (SELECT count(*) FROM gone WHERE cascade AND NOT retention) FROM gone WHERE NOT retention AND NOT cascade GROUP BY service_id
UNION ALL SELECT 'repeated', service_id, count(*), 0 FROM gone WHERE NOT retention AND NOT cascade GROUP BY service_id""")
def durable_delete(spark, sf_dir):
    """M7/M4/E5: delete one owner's rows from a date on, then the rows of removed
    services, then both again, from the stored table; what each step removed and
    what the table holds afterwards, read back."""
    table = VT.MetricsTable(spark, scratch_path(spark, f"metrics-delete-{uuid.uuid4().hex}"))
    p1, p2 = _passes(spark, sf_dir)
    table.upsert(p1)
    table.upsert(p2)   # several versions of each row: a delete takes them all
    dim = FX.services(spark)
    owned, off = dim.filter(F.col("owner") == RETENTION_OWNER).select(F.col("id").alias("service_id")), dim.filter(~F.col("capture_telemetry")).select(F.col("id").alias("service_id"))
    out = None
    for step in ("retention", "cascade", "repeated"):
        removed = 0
        if step != "cascade":
            removed += table.delete(owned, since=RETENTION_SINCE)
        if step != "retention":
            removed += table.delete(off)
        left = table.read().groupBy("service_id").agg(F.count(F.lit(1)).alias("rows_left")) \
            .select(F.lit(step).alias("step"), "service_id", "rows_left", F.lit(removed).cast("long").alias("removed"))
        out = left if out is None else out.unionByName(left)
    return out


@plan("api_logs_ingest", sql=f"""
WITH {Q.API_LOGS}, {FEED}, {VALID},
keyed AS (SELECT *, {sql_dedup_key()} AS dedup_key FROM valid),
firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY event_id, delivery) = 1)
SELECT CAST(request_timestamp AS DATE) AS date, service_id, count(*) AS requests FROM firsts GROUP BY 1, 2""")
def api_logs_ingest(spark, sf_dir):
    """Parse the delivered feed, route, key, keep first deliveries
    and append to the date-partitioned table -- twice (a replayed load adds
    nothing).  Returns request counts per date and service."""
    from ..operators import quality as QY
    from .ingest import parsed_feed
    ok, _ = QY.split_valid(parsed_feed(spark, sf_dir))
    rows = QY.with_dedup_key(QY.payload_rows(ok, keep=(F.col("seq").alias("event_id"), "delivery")))
    path = scratch_path(spark, f"api-logs-ingest-{uuid.uuid4().hex}")
    IO.append_api_logs(rows, path, order=("event_id", "delivery"))
    IO.append_api_logs(rows, path, order=("event_id", "delivery"))
    back = spark.read.parquet(path)
    return back.groupBy("date", "service_id").agg(F.count(F.lit(1)).alias("requests"))


TAIL_ROWS, TAIL_STRETCH = 150, 6


@plan("metrics_tail", sql=f"""
{Q.with_metrics('1h')},
m AS (SELECT service_id, strftime(to_timestamp(epoch(TIMESTAMP '2024-01-01') + {TAIL_STRETCH} * (epoch(window_start) - epoch(TIMESTAMP '2024-01-01'))) AT TIME ZONE 'UTC', '%Y-%m') AS month
      FROM metrics),
n AS (SELECT service_id, month, count(*) AS rows_read FROM m GROUP BY ALL),
c AS (SELECT *, coalesce(sum(rows_read) OVER (PARTITION BY service_id ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM n)
SELECT service_id, month, rows_read FROM c
WHERE newer < {TAIL_ROWS} AND service_id IN (SELECT service_id FROM n WHERE month = (SELECT max(month) FROM n))""")
def metrics_tail(spark, sf_dir):
    """The newest rows of every service from the stored table (here spread
    over half a year): which months are read for which service."""
    m = metrics_of(spark, sf_dir, "1h").withColumn("window_start", F.timestamp_seconds(
        F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + TAIL_STRETCH * (F.unix_timestamp("window_start") - F.unix_timestamp(F.lit("2024-01-01 00:00:00")))))
    table = VT.MetricsTable(spark, scratch_path(spark, f"metrics-tail-{uuid.uuid4().hex}"))
    table.upsert(m)
    return table.read_tail("1h", TAIL_ROWS).groupBy("service_id", F.date_format("window_start", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows_read"))
