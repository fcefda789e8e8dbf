"""Streaming sinks over several batches: late rows, replays, keyed views.
(The stream plans themselves are held against SQL in test_oracle.)"""

import datetime as dt

from pyspark.sql import functions as F

from pulsewatch import schemas as S
from pulsewatch.session import cut_lineage
from pulsewatch.sources import fixtures as FX
from pulsewatch.sources import io as IO
from pulsewatch.sources import versioned as VT
from pulsewatch.streaming import jobs as J

DAY = dt.datetime(2024, 1, 10, 12)


def envelope(service, at, user="u", key=None):
    k = f', "dedup_key": "{key}"' if key else ""
    return (f'{{"event_id": "x", "event_type": "api_log", "event_version": "1", "occurred_at": "{at.isoformat()}Z", "producer": "g", '
            f'"payload": {{"service_id": "{service}", "endpoint": "/a", "http_method": "GET", "status_code": 200, "response_time_ms": 5, '
            f'"user_id": "{user}", "timestamp": "{at.isoformat()}Z"{k}}}}}')


def test_ingest_keeps_late_logs_and_takes_replays(spark, tmp_path):
    sink = J.ingest_sink(str(tmp_path / "logs"), str(tmp_path / "dlq"), FX.services(spark))
    batch = lambda *texts: spark.createDataFrame([(None, t) for t in texts], "key string, value string").coalesce(1)
    first = batch(envelope("svc-1", DAY), envelope("svc-1", DAY), "{bad", envelope("nobody", DAY), envelope("svc-2", DAY, key="client-1"))
    late = batch(envelope("svc-1", DAY - dt.timedelta(days=9)), envelope("svc-1", DAY), envelope("svc-2", DAY - dt.timedelta(days=3), key="client-1"))
    sink(first, 0)
    sink(late, 1)
    sink(late, 1)   # the batch is replayed
    sink(first, 2)  # delivered again under another id
    logs = spark.read.parquet(str(tmp_path / "logs"))
    assert sorted((r.service_id, r.request_timestamp) for r in logs.collect()) == [
        ("svc-1", DAY - dt.timedelta(days=9)), ("svc-1", DAY), ("svc-2", DAY)]
    dead = spark.read.parquet(str(tmp_path / "dlq")).where("batch_id = 0")
    assert sorted(r.error for r in dead.collect()) == ["malformed envelope", "unknown service"]
    assert IO.read_api_logs(spark, str(tmp_path / "logs"), since=DAY).count() == 2


def test_ingest_tasks_do_not_depend_on_the_number_of_services(spark, tmp_path, monkeypatch):
    """A batch of one service stays spread as it came, and is stored once."""
    seen = []
    monkeypatch.setattr(J, "cut_lineage", lambda df: seen.append(cut_lineage(df)) or seen[-1])
    texts = [(i, envelope("svc-1", DAY + dt.timedelta(seconds=i // 2))) for i in range(400)]
    sink = J.ingest_sink(str(tmp_path / "logs"), str(tmp_path / "dlq"), FX.services(spark), arrival=("seq",))
    sink(spark.createDataFrame(texts, "seq long, value string").repartition(4), 0)
    sizes = seen[0].rdd.glom().map(len).collect()
    assert len(sizes) == 4 and all(sizes)
    logs = spark.read.parquet(str(tmp_path / "logs"))
    assert logs.count() == 200 and "_arrival" not in logs.columns


def events_of(rows, lateness, known=None):
    """Feed (hour, p99) rows batch by batch to the rule, as the state does."""
    out, last, opened, waiting, seen = [], None, {}, {}, None
    hour = 3_600_000_000
    for batch in rows:
        for h, p in batch:
            us = h * hour
            seen = us if seen is None else max(seen, us)
            if last is None or us > last:
                waiting.setdefault(us, [p, 0.0])
        upto = seen - lateness * hour
        ready = sorted(u for u in waiting if u <= upto)
        got, last = J.evaluate_windows("s", [(u, *waiting.pop(u)) for u in ready], last, opened, upto, hour, 2000.0, 0.1)
        out += [(e[1], e[5], e[3].hour if e[5] == "open" else e[4].hour) for e in got]
    return out


def test_alert_rule_takes_late_rows_in_time_order():
    bad, good = 3000.0, 10.0
    in_order = events_of([[(1, bad), (2, bad), (3, good), (4, bad), (6, good), (9, good)]], 3)
    late = events_of([[(2, bad), (4, bad)], [(3, good), (1, bad)], [(6, good), (2, bad)], [(9, good)]], 3)
    assert in_order == late == [("latency", "open", 1), ("latency", "close", 3), ("latency", "open", 4), ("latency", "close", 5)]


def test_alert_stream_with_late_and_replayed_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "service_id string, window_start timestamp, window_size string, response_time_p99 decimal(10,2), error_rate decimal(5,4)"
    row = lambda h, p: ("s", base + dt.timedelta(hours=h), "1h", p, 0)
    from decimal import Decimal
    bad, good = Decimal("3000.00"), Decimal("10.00")
    rows = lambda *r: spark.createDataFrame([(a, b, c, d, Decimal("0")) for a, b, c, d, _ in r], schema)
    rows().write.mode("append").parquet(folder)
    stream = J.alerts_stream(spark.readStream.schema(schema).parquet(folder), "1h", lateness_minutes=180)
    for batch in (rows(row(2, bad), row(5, good)), rows(row(3, bad), row(4, good)), rows(row(3, bad), row(9, bad)), rows(row(20, good))):
        batch.write.mode("append").parquet(folder)
        J.start(stream, J.batch_sink(out), str(tmp_path / "ckpt"), trigger=None).awaitTermination()
    got = sorted((r.event, r.opened_at.hour, r.closed_at.hour if r.closed_at else None) for r in
                 spark.read.option("recursiveFileLookup", "true").parquet(out).collect())
    assert got == [("close", 2, 4), ("close", 9, 10), ("open", 2, None), ("open", 9, None)]
    full = spark.read.option("recursiveFileLookup", "true").parquet(out).where("event = 'open'").collect()
    assert all(r.id and r.message == "P99 latency 3000 ms exceeds threshold 2000 ms" for r in full)


def test_latest_view_over_two_batches(spark, tmp_path):
    sink, path = J.latest_sink(str(tmp_path / "v")), str(tmp_path / "v")
    rows = lambda *r: spark.createDataFrame([(s, "m", t, "1", v) for s, t, v in r],
                                            "service_id string, module string, generated_at timestamp, model_version string, value string")
    hour = lambda h: DAY + dt.timedelta(hours=h)
    sink(rows(("a", hour(1), "x"), ("b", hour(5), "y")), 0)
    second = rows(("a", hour(3), "z"), ("b", hour(2), "old"), ("c", hour(0), "w"))
    sink(second, 1)
    sink(second, 1)  # replayed
    assert sorted((r.service_id, r.value) for r in J.read_latest(spark, path).collect()) == [("a", "z"), ("b", "y"), ("c", "w")]


def test_latest_prediction_plan_stores_its_rows_once(spark, tmp_path, monkeypatch):
    """The newest window of a service wins whichever delivery holds it; the windows are made once for all of them."""
    from pulsewatch.plans import serving, streams
    seen = []
    monkeypatch.setattr(serving, "cut_lineage", lambda df: seen.append(cut_lineage(df)) or seen[-1], raising=False)
    # latency falls with time, so the newest score is the smallest
    spark.createDataFrame([(100 * u + k, DAY + dt.timedelta(minutes=k), u, "view", 10.0 * (12 - k) + u, "{}") for u in range(3) for k in range(12)],
                          "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = serving.latest_prediction_view(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(f"svc-{u}", "anomaly", DAY + dt.timedelta(minutes=12), round((200 + 20 * u) / 5000, 6)) for u in range(3)]
    assert len(seen) == 1 and seen[0].count() == 36
    last = seen[0].groupBy("service_id").agg(F.max_by("batch", "generated_at").alias("b")).collect()
    assert any(r.b < streams.BATCHES - 1 for r in last)


def test_metrics_sink_feeds_the_partitioned_table(spark, tmp_path):
    from decimal import Decimal
    path = str(tmp_path / "metrics")
    row = lambda n, at: ("s", DAY, DAY + dt.timedelta(minutes=1), "1m", n, Decimal("1.00"), None, None, None, Decimal("0"), Decimal("1"), None, None, at)
    sink = J.metrics_sink(path, str(tmp_path / "events"))
    sink(spark.createDataFrame([row(1, DAY)], S.METRICS), 0)
    sink(spark.createDataFrame([row(2, DAY + dt.timedelta(hours=1))], S.METRICS), 1)
    got = VT.MetricsTable(spark, path).read("1m", since=DAY).collect()
    assert [r.request_count for r in got] == [2]
    assert spark.read.parquet(str(tmp_path / "events")).where(F.col("key") == "s").count() == 2


def test_windows_merge_from_histograms_of_parts(spark, tmp_path):
    from pulsewatch.operators import metrics as M
    path = str(tmp_path / "counts")
    data = [("s" if k % 3 else "t", DAY + dt.timedelta(minutes=7 * k % 300, seconds=k % 60), None if k % 11 == 0 else 10 * (k % 37), 500 if k % 5 == 0 else 200) for k in range(400)]
    logs = spark.createDataFrame(data, "service_id string, request_timestamp timestamp, response_time_ms int, status_code int")
    sink = J.histograms_sink(path)
    for b in range(3):
        sink(logs.where(F.abs(F.hash("request_timestamp", "response_time_ms")) % 3 == b), b)
    sink(logs.where(F.abs(F.hash("request_timestamp", "response_time_ms")) % 3 == 1), 1)  # replayed
    cols = [c for c in S.METRIC_COLUMNS if c != "computed_at"]
    rows = lambda df: sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    want = M.aggregate_windows(logs)
    assert rows(J.windows_of(spark, path)) == rows(want)
    low, high = DAY + dt.timedelta(hours=1), DAY + dt.timedelta(hours=3)
    inside = (F.col("window_start") >= F.lit(low)) & (F.col("window_start") < F.lit(high))
    assert rows(J.windows_of(spark, path, since=low, until=high)) == rows(want.where(inside))
