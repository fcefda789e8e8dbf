"""Hand-computed micro fixtures for edge semantics (FIXTURES.md section 4)."""

import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pulsewatch import schemas as S
from pulsewatch.functions import exprs as X
from pulsewatch.ml import evaluate as EV
from pulsewatch.ml import heuristics as H
from pulsewatch.operators import alerts as AL
from pulsewatch.operators import features as FE
from pulsewatch.operators import metrics as M
from pulsewatch.operators import quality as QY
from pulsewatch.operators import views as V

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def mins(k):
    return T0 + dt.timedelta(minutes=k)


def metric_rows(spark, rows, size="1m"):
    """rows: (service, minute offset, p99, error_rate)."""
    data = [(s, mins(k), mins(k + 1), size, 1, Decimal("1.00"), Decimal("1.00"), Decimal(str(p99)),
             Decimal(str(p99)), Decimal(str(err)).quantize(Decimal("0.0001")),
             (1 - Decimal(str(err))).quantize(Decimal("0.0001")), None, None, None)
            for s, k, p99, err in rows]
    return spark.createDataFrame(data, S.METRICS)


def test_dedup_key_seconds_format(spark):
    rows = [(dt.datetime(2024, 1, 1, 10, 15, 0, 400000),), (dt.datetime(2024, 1, 1, 10, 15, 7, 100000),)]
    df = spark.createDataFrame(rows, "ts timestamp").select(X.iso_utc_seconds("ts").alias("s"))
    assert [r.s for r in df.collect()] == ["2024-01-01T10:15Z", "2024-01-01T10:15:07Z"]
    k = spark.createDataFrame([("s1", None, T0, 200, None)], "a string, b string, t timestamp, c int, d string") \
        .select(X.dedup_key("a", "b", "t", "c", "d").alias("k")).first().k
    assert k == hashlib.sha256("s1||2024-01-01T10:00Z|200|".encode()).hexdigest()


def test_client_key_wins_unless_blank(spark):
    df = spark.createDataFrame(
        [("s", "/a", T0, 200, "u", "given"), ("s", "/a", T0, 200, "u", "  "), ("s", "/a", T0, 200, "u", None)],
        "service_id string, endpoint string, request_timestamp timestamp, status_code int, user_id string, "
        "client_dedup_key string")
    keys = [r.dedup_key for r in QY.with_dedup_key(df).collect()]
    assert keys[0] == "given" and keys[1] == keys[2] != "given"


def test_dedup_first_wins_and_skips_existing(spark):
    df = spark.createDataFrame([("k1", 3, "c"), ("k1", 1, "a"), ("k2", 2, "b")], "dedup_key string, event_id int, v string")
    got = {r.dedup_key: r.v for r in QY.dedup_first(df).collect()}
    assert got == {"k1": "a", "k2": "b"}
    existing = spark.createDataFrame([("k2",)], "dedup_key string")
    assert [r.dedup_key for r in QY.dedup_first(df, existing=existing).collect()] == ["k1"]


def test_percentiles_and_rates(spark):
    logs = spark.createDataFrame(
        [("s", "/x", "GET", st, rt, None, None, None, None, None, mins(0) + dt.timedelta(seconds=i), None, None)
         for i, (st, rt) in enumerate([(0, 1), (399, 2), (400, 10), (599, 20)])]
        + [("s", "/x", "GET", 200, 5, None, None, None, None, None, mins(1), None, None)],   # at window end
        S.API_LOGS)
    m = {r.window_start: r for r in M.window_metrics(logs, "1m").collect()}
    r = m[mins(0)]
    assert r.request_count == 4
    assert r.response_time_p95 == Decimal("18.50") and r.response_time_p99 == Decimal("19.70")
    assert r.error_rate == Decimal("0.5000") and r.success_rate == Decimal("0.5000")
    assert r.response_time_mean == Decimal("8.25")
    assert m[mins(1)].request_count == 1


def test_half_up_mean(spark):
    df = spark.createDataFrame([(1, 8), (5, 8), (1, 3), (2, 3)], "num long, den long")
    got = [r.v for r in df.select(X.half_up_ratio("num", "den", 2, 10).alias("v")).collect()]
    assert got == [Decimal("0.13"), Decimal("0.63"), Decimal("0.33"), Decimal("0.67")]


def alert_fixture(spark):
    rows = [
        ("a", 0, 2500, 0.01),   # latency opens
        ("a", 1, 100, 0.30),    # error opens too (latency stays open: service still breaching)
        ("a", 2, 100, 0.01),    # recovers: both close at minute 2
        # minute 3 missing
        ("a", 4, 4000.01, 0),   # latency critical opens (> 2x)
        ("a", 6, 2000, 0.10),   # minute 5 silent closed it at 5; p99 = 2000 is no breach
        ("b", 0, 100, 0.21),    # error critical
        ("b", 1, 4000, 0),      # latency high (exactly 2x is high)
        ("b", 6, 2100, 0),      # new latency at the end: stays open
    ]
    return metric_rows(spark, rows)


def test_alert_lifecycle_islands(spark):
    got = sorted((r.service_id, r.triggering_metric, r.severity, r.opened_at, r.closed_at)
                 for r in AL.alert_lifecycle(alert_fixture(spark)).collect())
    assert got == sorted([
        ("a", "latency", "high", mins(0), mins(2)),
        ("a", "error_rate", "critical", mins(1), mins(2)),
        ("a", "latency", "critical", mins(4), mins(5)),
        ("b", "error_rate", "critical", mins(0), mins(2)),
        ("b", "latency", "high", mins(1), mins(2)),
        ("b", "latency", "high", mins(6), None),
    ])


def test_alert_step_matches_island_replay(spark):
    """Minute-by-minute E3/E4 evaluation equals the island replay."""
    metrics = alert_fixture(spark)
    open_alerts = spark.createDataFrame([], S.ALERTS)
    closed = []
    for k in range(0, 7):
        rows = metrics.filter(F.col("window_start") == mins(k))
        to_open, to_close = AL.alert_step(open_alerts, rows)
        shut = to_close.withColumn("closed_at", F.lit(mins(k)).cast("timestamp"))
        closed += [(r.service_id, r.triggering_metric, r.opened_at, r.closed_at) for r in shut.collect()]
        open_alerts = open_alerts.join(to_close.select("id"), "id", "left_anti").unionByName(to_open)
        open_alerts = spark.createDataFrame(open_alerts.collect(), S.ALERTS)
    still = [(r.service_id, r.triggering_metric, r.opened_at, None) for r in open_alerts.collect()]
    batch = [(r.service_id, r.triggering_metric, r.opened_at, r.closed_at)
             for r in AL.alert_lifecycle(metrics).collect()]
    assert sorted(closed + still, key=str) == sorted(batch, key=str)


def test_failure_streaks(spark):
    bad = [1, 1, 1, 1, 0] + [1] * 5 + [0] + [1] * 6 + [0] * 3 + [1] * 5
    rows = [("s", i, 2500 if b else 100, 0.0) for i, b in enumerate(bad)]
    f = FE.failure_labels(FE.as_numeric(metric_rows(spark, rows)), chunk_rows=7)
    got = [(r.streak_start, r.failure_target) for r in f.orderBy("window_start").collect()]
    starts = [i for i in range(len(bad) - 4) if all(bad[i:i + 5])]
    exp_s = [1 if i in starts else 0 for i in range(len(bad))]
    exp_t = [1 if any(j in starts for j in range(i + 1, i + 16)) else 0 for i in range(len(bad))]
    assert [g[0] for g in got] == exp_s
    assert [g[1] for g in got] == exp_t


def test_frequency_24h(spark):
    day = dt.timedelta(hours=24)
    ts = [T0, T0, T0, T0 + day, T0 + day + dt.timedelta(minutes=1)]
    orders = [0, 1, 2, 0, 0]
    df = spark.createDataFrame([("s", t, o) for t, o in zip(ts, orders)],
                               "service_id string, window_start timestamp, trigger_order int")
    got = [r.alert_frequency_24h for r in AL.alert_frequency(df).orderBy("window_start", "trigger_order").collect()]
    assert got == [0, 1, 2, 0, 1]


def test_health_worked_value(spark):
    df = spark.createDataFrame([(0.01, 300.0)], "error_rate double, response_time_p99 double")
    r = H.health_score(df).first()
    assert r.health_score == pytest.approx(84.875)
    assert r.health_status == "warning" and r.components.resource == 0.0
    df2 = spark.createDataFrame([(0.0, 0.0, 50.0, None), (1.0, 6000.0, None, None)],
                                "error_rate double, response_time_p99 double, cpu_usage_pct double, memory_usage_pct double")
    a, b = H.health_score(df2).collect()
    assert a.health_score == pytest.approx(100 * (0.3 + 0.3 + 0.1 + 0.1)) and a.health_status == "warning"
    assert b.health_score == pytest.approx(100 * 0.1 / 0.8) and b.health_status == "critical"


def test_risk_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.75, 0.7499, 0.5, 0.3, 0.2999, 0.95, 0.05)], "p double")
    got = [r[0] for r in df.select(X.risk_level(F.col("p"), 0.5)).collect()]
    assert got == ["critical", "high", "high", "medium", "low", "critical", "low"]
    got95 = [r[0] for r in df.select(X.risk_level(F.col("p"), 0.95)).collect()]
    assert got95[5] == "critical" and got95[0] == "medium"


def test_priority_cases(spark):
    rows = [("availability", 90.0, 0, False, False), ("latency", 40.0, 0, False, False),
            ("latency", 90.0, 10, False, False), ("latency", 90.0, 0, False, False),
            ("latency", 90.0, 0, True, False), ("availability", 90.0, 0, False, True),
            ("latency", 90.0, 10, False, True)]
    df = spark.createDataFrame(rows, "triggering_metric string, current_health_score double, "
                                     "alert_frequency_24h int, failure_prediction_active boolean, "
                                     "service_is_payment_or_auth boolean")
    got = [r.priority for r in H.heuristic_priority(df).collect()]
    assert got == ["high", "high", "medium", "low", "critical", "critical", "high"]


def test_asof_window(spark):
    preds = spark.createDataFrame(
        [("s", "anomaly", "v", T0, '{"x":1}')],
        "service_id string, module string, model_version string, generated_at timestamp, value string")
    probes = spark.createDataFrame(
        [(i, "s", "anomaly", T0 + dt.timedelta(seconds=sec)) for i, sec in
         enumerate([4 * 60 + 59, 5 * 60, 5 * 60 + 1, -1])],
        "probe_id int, service_id string, module string, at timestamp")
    got = {r.probe_id: r.status for r in V.asof_prediction(probes, preds).collect()}
    assert got == {0: "stale", 1: "no-cache", 2: "no-cache", 3: "no-cache"}


def test_episode_overlay(spark):
    m = metric_rows(spark, [("s", k, 1000, 0.01) for k in range(5)])
    an = spark.createDataFrame([("s", mins(1), 2, 2.0), ("s", mins(2), 10, 3.0), ("s", mins(-1), 5, 9.0)],
                               "service_id string, start timestamp, duration_minutes int, latency_multiplier double")
    fl = spark.createDataFrame([("s", mins(4), 3, 0.25, 2500.0)],
                               "service_id string, start timestamp, duration_minutes int, error_rate_floor double, "
                               "p99_floor_ms double")
    got = {r.window_start: r for r in V.label_episodes(m, an, fl).collect()}
    assert got[mins(0)].response_time_p99 == 1000 and not got[mins(0)].is_anomaly
    assert got[mins(1)].response_time_p99 == 2000
    assert got[mins(2)].response_time_p99 == 6000          # overlap multiplies
    assert got[mins(3)].response_time_p99 == 3000
    assert got[mins(4)].is_failure_window and got[mins(4)].response_time_p99 == 3000
    assert got[mins(4)].error_rate == 0.25


def test_chunked_sequence_equals_single_partition(spark):
    rows = [(f"s{i % 3}", k, 100 + (k * 37 % 23) * 100, (k % 7) / 20) for i in range(3) for k in range(60)]
    m = FE.as_numeric(metric_rows(spark, rows))
    cols = ["service_id", "window_start", *S.FEATURE_COLUMNS]
    a = FE.build_features(m, lags=(1, 6, 24), rolling=15, chunk_rows=None).select(*cols)
    b = FE.build_features(m, lags=(1, 6, 24), rolling=15, chunk_rows=25).select(*cols)
    c = FE.build_features(m.repartition(7), lags=(1, 6, 24), rolling=15, chunk_rows=40).select(*cols)
    assert sorted(a.collect()) == sorted(b.collect()) == sorted(c.collect())
    t1 = FE.horizon_targets(m, (1, 2, 6, 24), chunk_rows=None).select("service_id", "window_start", "target_24")
    t2 = FE.horizon_targets(m, (1, 2, 6, 24), chunk_rows=26).select("service_id", "window_start", "target_24")
    assert sorted(t1.collect()) == sorted(t2.collect())


def test_threshold_sweep_and_auc_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "p double, y int")
    sw = {r.threshold: r for r in EV.threshold_sweep(df).collect()}
    for t in EV.threshold_grid():
        tp = sum(1 for p, y in rows if p >= t and y)
        fp = sum(1 for p, y in rows if p >= t and not y)
        assert (sw[t].tp, sw[t].fp) == (tp, fp)
    pos = [p for p, y in rows if y]
    neg = [p for p, y in rows if not y]
    u = sum((n < p) + 0.5 * (n == p) for p in pos for n in neg) / (len(pos) * len(neg))
    assert EV.rank_auc(df, buckets=8).first().roc_auc == pytest.approx(u)


def test_permutation_invariance(spark):
    logs = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from pulsewatch.sources import fixtures as FX
    a = M.aggregate_windows(FX.api_logs(logs)).drop("computed_at")
    b = M.aggregate_windows(FX.api_logs(logs.repartition(5).orderBy(F.rand(3)))).drop("computed_at")
    assert sorted(a.collect()) == sorted(b.collect())


def test_chrono_split_on_timestamp_boundary(spark):
    df = spark.createDataFrame([("s", mins(k // 2)) for k in range(10)], "service_id string, window_start timestamp")
    train, test = FE.chrono_split(df)
    assert train.count() == 8 and test.count() == 2
    df2 = spark.createDataFrame([("s", mins(k // 3)) for k in range(10)], "service_id string, window_start timestamp")
    train2, test2 = FE.chrono_split(df2)      # cut at row 8 falls inside minute 2 -> whole minute tests
    assert train2.count() == 6 and test2.count() == 4


def test_user_id_and_status_defaults(spark):
    df = spark.createDataFrame([("0F8FAD5B-D9CB-469F-A165-70867728950E", None), ("42", 404)],
                               "user_id string, status_code short")
    out = QY.default_status(QY.parse_user_id(df)).collect()
    assert out[0].user_id == "0f8fad5b-d9cb-469f-a165-70867728950e" and out[0].status_code == 0
    assert out[1].user_id is None and out[1].status_code == 404


def test_metrics_table_scan_and_csv(spark, tmp_path):
    from pulsewatch.sources import io as IO
    m = metric_rows(spark, [("a", k, 100 + k, 0.01) for k in range(5)] + [("b", 2, 50, 0.0)])
    path = str(tmp_path / "metrics")
    IO.write_metrics(m, path)
    got = IO.load_metrics(spark, path, "1m", since=mins(1), until=mins(4), service_id="a")
    assert sorted(r.window_start for r in got.collect()) == [mins(1), mins(2), mins(3)]
    assert got.columns == list(S.METRIC_COLUMNS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    csv = str(tmp_path / "csv")
    IO.write_metrics_csv(m, csv)
    back = IO.read_metrics_csv(spark, csv)
    assert sorted(back.collect()) == sorted(m.select(*S.METRIC_COLUMNS).collect())


def test_history_and_snapshot(spark):
    m = metric_rows(spark, [("a", k, 100 + k, 0.01) for k in range(5)] + [("b", 2, 50, 0.0)])
    h = M.history(m, "a", mins(1), mins(3))
    assert [r.window_start for r in h.collect()] == [mins(1), mins(2)]
    snap = M.snapshot(m.filter(F.col("service_id") == "b")).first()
    assert snap.timestamp == mins(2) and snap.response_time_p99 == 50.0 and snap.cpu_usage_pct is None


def test_upsert_is_idempotent(spark, tmp_path):
    from pulsewatch.sources import io as IO
    path = str(tmp_path / "up")
    old = metric_rows(spark, [("a", k, 100, 0.01) for k in range(3)]) \
        .withColumn("computed_at", F.lit(mins(0)).cast("timestamp"))
    new = metric_rows(spark, [("a", k, 900, 0.5) for k in range(1, 4)]) \
        .withColumn("computed_at", F.lit(mins(10)).cast("timestamp"))
    IO.write_metrics(old, path)
    IO.upsert_metrics(new, path)
    IO.upsert_metrics(new, path)
    got = {r.window_start: float(r.response_time_p99) for r in IO.load_metrics(spark, path).collect()}
    assert got == {mins(0): 100.0, mins(1): 900.0, mins(2): 900.0, mins(3): 900.0}
    IO.load_metrics_if_absent(old, path)
    assert IO.load_metrics(spark, path).count() == 4


def test_isolation_forest_deterministic(spark):
    from pulsewatch.ml import iforest as IF
    import random
    rnd = random.Random(3)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(400)] + [(1000, 8.0, 8.0)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    f1 = IF.fit(df, ["x", "y"], ["k"], n_trees=20)
    f2 = IF.fit(df.repartition(7), ["x", "y"], ["k"], n_trees=20)
    assert sorted(f1.collect()) == sorted(f2.collect())
    s = IF.score(df, f1, ["x", "y"]).orderBy(F.col("iso_score").desc()).first()
    assert s.k == 1000


def test_anomaly_training_sweep_and_score(spark):
    import random
    from pulsewatch.ml import models as ML
    rnd = random.Random(5)
    rows = []
    for k in range(300):
        p99 = 5000.0 if k % 37 == 0 else 200 + rnd.random() * 50
        rows.append(("a", k, round(p99, 2), 0.01))
    m = metric_rows(spark, rows)
    feats = FE.build_features(m, lags=(1, 2, 3), rolling=3)
    labels = spark.createDataFrame([("a", mins(k), k % 37 == 0, False) for k in range(300)], S.ANOMALY_LABELS)
    _, forest, scored, sweep = ML.train_anomaly(feats, labels=labels, n_trees=30)
    got = sweep.collect()
    assert len(got) == len(S.CONTAMINATION_GRID) and sum(r.is_best for r in got) == 1
    s = scored.collect()
    assert all(0.0 <= r.anomaly_score <= 1.0 for r in s)
    top = sorted(s, key=lambda r: -r.iso_score)[:5]
    assert sum(r.is_anomaly for r in top) >= 3


def test_bad_events_routing(spark):
    from pulsewatch.sources import io as IO
    good = ('{"event_id":"e","event_type":"api_log","event_version":"1","occurred_at":"2024-01-01T10:00:00Z",'
            '"producer":"gw","payload":{"service_id":"s","endpoint":"/a","http_method":"GET","status_code":200,'
            '"response_time_ms":5,"timestamp":"2024-01-01T10:00:01.5Z"%s}%s}')
    cases = {
        "ok": good % ("", ""),
        "extra_field": good % (', "new_field": 1', ', "also_new": true'),
        "text": "not json at all",
        "wrong_type": good.replace('"status_code":200', '"status_code":"abc"') % ("", ""),
        "null_payload": '{"event_id":"e","event_version":"1","payload":null}',
        "no_endpoint": good.replace('"endpoint":"/a",', '') % ("", ""),
        "no_service": good.replace('"service_id":"s",', '') % ("", ""),
        "no_method": good.replace('"http_method":"GET",', '') % ("", ""),
        "no_timestamp": good.replace(',"timestamp":"2024-01-01T10:00:01.5Z"', '') % ("", ""),
        "version_2": good.replace('"event_version":"1"', '"event_version":"2"') % ("", ""),
    }
    raw = spark.createDataFrame(list(cases.items()), "name string, value string")
    ok, dlq = QY.split_valid(IO.unwrap(raw))
    routed = {r.name: None for r in ok.collect()}
    routed.update({r.name: r.error for r in dlq.collect()})
    assert routed["ok"] is None and routed["extra_field"] is None
    assert routed["text"] == "malformed envelope" and routed["wrong_type"] == "malformed envelope"
    for k in ("null_payload", "no_endpoint", "no_service", "no_method", "no_timestamp"):
        assert routed[k] == "payload missing required fields", k
    assert routed["version_2"].startswith("unsupported event_version")
    row = QY.payload_rows(ok.filter(F.col("name") == "ok")).first()
    assert row.request_timestamp == dt.datetime(2024, 1, 1, 10, 0, 1, 500000) and row.status_code == 200
    assert set(dlq.columns) >= {"original", "error", "routedAt"}


def test_repair_late_windows(spark, tmp_path):
    from pulsewatch.sources import io as IO
    def logs(rows):
        return spark.createDataFrame(
            [("s", "/x", "GET", 200, rt, None, None, None, None, None, t, None, None) for t, rt in rows], S.API_LOGS)
    on_time = logs([(mins(0), 10), (mins(1), 20), (mins(61), 30)])
    late = logs([(mins(1) + dt.timedelta(seconds=5), 40)])
    path = str(tmp_path / "m")
    IO.write_metrics(M.aggregate_windows(on_time), path)
    IO.repair_windows(on_time.unionByName(late), path, mins(1), mins(2))
    m1 = {r.window_start: r.request_count for r in IO.load_metrics(spark, path, "1m").collect()}
    h1 = {r.window_start: r.request_count for r in IO.load_metrics(spark, path, "1h").collect()}
    assert m1 == {mins(0): 1, mins(1): 2, mins(61): 1}
    assert h1 == {mins(0): 3, mins(60): 1}
    # a window starting exactly at ``until`` is not recomputed
    later = logs([(mins(60) + dt.timedelta(seconds=1), 99)])
    IO.repair_windows(on_time.unionByName(late).unionByName(later), path, mins(0), mins(60), sizes=("1h",))
    h2 = {r.window_start: r.request_count for r in IO.load_metrics(spark, path, "1h").collect()}
    assert h2 == {mins(0): 3, mins(60): 1}


def test_score_dispatch_falls_back(spark, tmp_path):
    from pulsewatch.ml import jobs as MJ
    m = metric_rows(spark, [("a", k, 2500, 0.01) for k in range(40)])
    f = FE.build_features(m, lags=(1, 2, 3), rolling=3)
    rows = MJ.score(spark, "failure", m, store=str(tmp_path / "empty"), features=f, min_rows=10).collect()
    assert len(rows) == 1 and rows[0].model_version == S.HEURISTIC_MODEL_VERSION
    assert MJ.score(spark, "health", m).count() == 1


def test_fill_gaps_across_month_boundary(spark):
    base = dt.datetime(2024, 1, 31, 22, 0)
    hours = [0, 1, 3, 4]                       # 2024-02-01 00:00 is silent
    data = [("s", base + dt.timedelta(hours=h), base + dt.timedelta(hours=h + 1), "1h", 5, Decimal("0.08"),
             None, None, None, Decimal("0.0000"), Decimal("1.0000"), None, None, None) for h in hours]
    m = spark.createDataFrame(data, S.METRICS)
    got = sorted((r.window_start, r.is_gap, r.request_count) for r in M.fill_gaps(m, "1h").collect())
    assert got == [(base + dt.timedelta(hours=h), h == 2, 0 if h == 2 else 5) for h in range(5)]


def test_append_api_logs_dedups_within_touched_dates(spark, tmp_path):
    from pulsewatch.sources import io as IO
    def rows(items):   # ingest order = position in the list
        return spark.createDataFrame(
            [("s", "/x", "GET", 200, rt, None, None, "u", None, None, t, t + dt.timedelta(milliseconds=i), k)
             for i, (k, t, rt) in enumerate(items)], S.API_LOGS)
    path = str(tmp_path / "logs")
    day1, day2 = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 2, 10)
    first = rows([("k1", day1, 1), ("k2", day2, 2), ("k2", day2, 3)])
    assert IO.append_api_logs(first, path).count() == 2
    again = rows([("k2", day2, 9), ("k3", day2, 4)])
    IO.append_api_logs(again, path)
    got = {r.dedup_key: r.response_time_ms for r in spark.read.parquet(path).collect()}
    assert got == {"k1": 1, "k2": 2, "k3": 4}
    held = spark.read.parquet(path).filter(F.col("date").isin([dt.date(2024, 1, 2)]))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-02" in plan


def test_key_check_reads_the_time_of_the_batch(spark, tmp_path):
    """A live batch with one late log opens two short spans, not two days."""
    from pulsewatch.sources import io as IO
    day1, day2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    def rows(items):
        return spark.createDataFrame([(f"k{t.isoformat()}{n}", t, i, "s") for i, (t, n) in enumerate(items)],
                                     "dedup_key string, request_timestamp timestamp, seq int, service_id string")
    path = str(tmp_path / "logs")
    for day in (day1, day2):        # one batch an hour, as a live stream writes
        for h in range(0, 24, 3):
            IO.append_api_logs(rows([(day + dt.timedelta(hours=h, minutes=m), "") for m in range(0, 60, 10)]), path, order=("seq",))
    late, live = day1 + dt.timedelta(hours=3, minutes=20), day2 + dt.timedelta(hours=21, minutes=50)
    batch = rows([(late, ""), (live, ""), (live, "new"), (live + dt.timedelta(minutes=5, microseconds=7), ""), (late, "new")])
    assert len(IO.time_spans(batch)) == 2
    keys = IO.stored_keys(spark, path, batch.withColumn("date", F.to_date("request_timestamp")))
    assert sorted(r.dedup_key for r in keys.collect()) == [f"k{late.isoformat()}", f"k{live.isoformat()}"]
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(request_timestamp" in plan.split("PushedFilters")[1]
    assert IO.append_api_logs(batch, path, order=("seq",)).count() == 3
    assert IO.append_api_logs(batch, path, order=("seq",)).count() == 0   # replayed
    assert spark.read.parquet(path).count() == 2 * 8 * 6 + 3


def test_time_spans_hold_every_row_and_stay_few(spark):
    from pulsewatch.sources import io as IO
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(hours=5 * i, seconds=i % 7, microseconds=i) for i in range(400)]
    d = spark.createDataFrame([(t,) for t in [*times, None]], "request_timestamp timestamp")
    spans = IO.time_spans(d)
    assert len(spans) == IO.SPANS and all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    micros = [r[0] for r in d.dropna().select(F.unix_micros("request_timestamp")).collect()]
    assert all(any(a <= m < b for a, b in spans) for m in micros)
    assert IO.time_spans(d.limit(0)) == []
    hourly = spark.createDataFrame([(base + dt.timedelta(minutes=40 * i),) for i in range(100)], "request_timestamp timestamp")
    assert len(IO.time_spans(hourly)) == 1


def test_append_api_logs_client_key_on_two_dates(spark, tmp_path):
    from pulsewatch.sources import io as IO
    def rows(items):
        return spark.createDataFrame([(k, c, t, i) for i, (k, c, t) in enumerate(items)],
                                     "dedup_key string, client_dedup_key string, request_timestamp timestamp, seq int") \
            .withColumn("service_id", F.lit("s"))
    path = str(tmp_path / "logs")
    day1, day2 = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 2, 10)
    assert IO.append_api_logs(rows([("c1", "c1", day1), ("h1", None, day1), ("h2", " ", day1)]), path, order=("seq",)).count() == 3
    again = rows([("c1", "c1", day2), ("h1", None, day1), ("h3", None, day2), ("c2", "c2", day2)])
    assert {r.dedup_key for r in IO.append_api_logs(again, path, order=("seq",)).collect()} == {"h3", "c2"}
    assert sorted(r.dedup_key for r in spark.read.parquet(path).collect()) == ["c1", "c2", "h1", "h2", "h3"]


def test_create_services_ranks_only_requests_that_can_be_accepted(spark):
    from pulsewatch.operators import maintain as MT
    dim = spark.createDataFrame([], S.SERVICES)
    req = spark.createDataFrame(
        [("a", "n", None, None, "production", None, None, None, 1), ("b", "n", "http://x", None, "production", None, None, None, 2),
         ("c", "n", "http://y", None, "production", None, None, None, 3)],
        "id string, name string, base_url string, owner string, environment string, description string, "
        "capture_telemetry boolean, created_by string, request_seq int")
    accepted, conflicts = MT.create_services(dim, req)
    assert [r.id for r in accepted.collect()] == ["b"]
    assert {r.request_seq: r.reason for r in conflicts.collect()} == {1: "invalid: base_url_present", 3: "conflict: duplicate in batch"}


def test_macro_report_averages_the_classes_that_occur(spark):
    df = spark.createDataFrame([("low", "low"), ("high", "high"), ("low", "low")], "y string, yhat string")
    macro = [r for r in EV.macro_report(df).collect() if r.cls == "macro"][0]
    assert (macro.precision, macro.recall, macro.f1, macro.accuracy) == (1.0, 1.0, 1.0, 1.0)
    third = spark.createDataFrame([("low", "low"), ("high", "medium")], "y string, yhat string")
    assert [r.recall for r in EV.macro_report(third).collect() if r.cls == "macro"] == [pytest.approx(1 / 3)]


def test_threshold_falls_back_to_one_half(spark):
    df = spark.createDataFrame([(0.01, 0), (0.02, 1)], "p double, y int")
    assert EV.best_threshold(EV.threshold_sweep(df)).first().threshold == 0.5
    up = spark.createDataFrame([(0.2, 0), (0.9, 1)], "p double, y int")
    assert EV.best_threshold(EV.threshold_sweep(up, grid=[0.6, 0.3, 0.1])).first().threshold == 0.3


def test_quantiles_equal_exact_percentile(spark):
    import random
    from pulsewatch.ml import iforest as IF
    rng = random.Random(1)
    vals = [rng.random() for _ in range(3001)] + [0.25] * 1500
    df = spark.createDataFrame([(v,) for v in vals], "s double").repartition(5)
    qs = [0.0, 0.01, 0.5, 0.95, 0.975, 1.0]
    want = df.agg(*[F.percentile("s", F.lit(q)).alias(f"q{i}") for i, q in enumerate(qs)]).first()
    assert list(IF.quantiles(df, "s", qs).first()) == pytest.approx(list(want), abs=1e-12)


def test_episode_labels_every_overlapped_hour(spark):
    from pulsewatch.operators import views as V
    base = dt.datetime(2024, 1, 1)
    data = [("s", base + dt.timedelta(hours=h), base + dt.timedelta(hours=h + 1), "1h", 5, Decimal("0.08"), Decimal("10.00"),
             Decimal("10.00"), Decimal("10.00"), Decimal("0.0000"), Decimal("1.0000"), None, None, None) for h in range(5)]
    an = spark.createDataFrame([("s", base + dt.timedelta(minutes=90), 31, 2.0), ("s", base + dt.timedelta(minutes=100), 3, 3.0)],
                               "service_id string, start timestamp, duration_minutes int, latency_multiplier double")
    fl = spark.createDataFrame([], "service_id string, start timestamp, duration_minutes int, error_rate_floor double, p99_floor_ms double")
    got = {r.window_start.hour: r.response_time_p99 for r in
           V.label_episodes(spark.createDataFrame(data, S.METRICS), an, fl, window_size="1h").collect()}
    assert got == {0: 10.0, 1: 60.0, 2: 20.0, 3: 10.0, 4: 10.0}


def test_auc_undefined_with_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.7, 0), (0.4, 0)], "p double, y int")
    r = EV.rank_auc(df).first()
    assert r.roc_auc is None and r.positives == 0 and r.negatives == 3
    sw = EV.threshold_sweep(df).collect()
    assert len(sw) == 12 and all(x.tp == 0 for x in sw)


def test_constraints_have_three_valued_logic(spark):
    from pulsewatch.operators import constraints as CN
    from pulsewatch.operators import maintain as MT
    cols = "id string, name string, base_url string, owner string, environment string, description string, capture_telemetry boolean, created_by string, request_seq int"
    req = spark.createDataFrame([("1", "a", "http://a", None, None, None, None, None, 1), ("2", "b", "  ", None, "staging", None, None, None, 2),
                                 ("3", "c", "http://c", None, "nowhere", None, None, None, 3), ("4", "\t", None, "o" * 129, "staging", "", None, None, 4),
                                 ("5", "e", "http://e", None, "staging", None, None, None, 5)], cols)
    accepted, conflicts = MT.create_services(spark.createDataFrame([], S.SERVICES), req)
    assert [r.id for r in accepted.collect()] == ["5"]
    assert {r.request_seq: r.reason for r in conflicts.collect()} == {
        1: "invalid: environment_present", 2: "invalid: base_url_present", 3: "invalid: environment_valid",
        4: "invalid: name_present,base_url_present,owner_length"}
    alerts = spark.createDataFrame([("s", "bogus", "high", None, "m", mins(1), None), ("s", None, "odd", "odd", "m", mins(1), mins(0))],
                                   "service_id string, triggering_metric string, severity string, priority string, message string, opened_at timestamp, closed_at timestamp")
    assert [r.failed_rules for r in CN.violations(alerts, CN.ALERTS).collect()] == [
        ["trigger_valid"], ["triggering_metric_present", "severity_valid", "priority_valid", "closed_after_opened"]]
    kept, broken = CN.enforce(alerts, CN.ALERTS)
    assert kept.count() == 0 and broken.count() == 2


def test_ingest_rejects_rows_that_break_a_rule(spark, tmp_path):
    import json
    from pulsewatch.streaming import jobs as J
    send = lambda **kw: json.dumps({"event_version": "1", "payload": {"service_id": "s", "endpoint": "/a", "http_method": "GET", "status_code": 200,
                                                                      "response_time_ms": 5, "timestamp": "2024-01-01T00:00:00Z", **kw}})
    uid = "0B6F1E4C-7A7E-4F0A-9C45-1B2C3D4E5F60"
    values = [send(), send(http_method="FETCH"), send(response_time_ms=-1), send(response_time_ms=None), send(endpoint="/" + "x" * 600),
              send(endpoint="/u", user_id=uid), send(endpoint="/v", user_id="joe"), send(endpoint="/w", status_code=None)]
    raw = spark.createDataFrame([(None, v, i) for i, v in enumerate(values)], "key string, value string, place int")
    J.ingest_sink(str(tmp_path / "logs"), str(tmp_path / "dlq"), arrival=("place",))(raw, 0)
    stored = {r.endpoint: r for r in spark.read.parquet(str(tmp_path / "logs")).collect()}
    assert set(stored) == {"/a", "/u", "/v", "/w"} and stored["/u"].user_id == uid.lower() and stored["/v"].user_id is None and stored["/w"].status_code == 0
    assert sorted(r.error for r in spark.read.parquet(str(tmp_path / "dlq")).collect()) == [
        "violates: endpoint_length", "violates: http_method_valid", "violates: response_time_ms_present", "violates: response_time_nonneg"]
