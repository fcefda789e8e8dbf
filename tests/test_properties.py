"""Seeded random inputs checked against brute-force Python definitions."""

import datetime as dt
import hashlib
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from pulsewatch import schemas as S
from pulsewatch.functions import exprs as X
from pulsewatch.operators import alerts as AL
from pulsewatch.operators import features as FE

from .test_micro import metric_rows, mins

T0 = dt.datetime(2024, 3, 1)


def test_half_up_ratio_matches_decimal(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randrange(0, 10 ** 9), rnd.randrange(1, 10 ** 6)) for _ in range(500)]
    pairs += [(1, 8), (3, 8), (5, 8), (1, 2), (0, 7)]
    df = spark.createDataFrame(pairs, "n long, d long").select(
        "n", "d", X.half_up_ratio("n", "d", 4, 20).alias("r"))
    for r in df.collect():
        exp = (Decimal(r.n) / Decimal(r.d)).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)
        assert r.r == exp, (r.n, r.d)


def test_dedup_key_matches_hashlib(spark):
    rnd = random.Random(12)
    rows = []
    for _ in range(200):
        ts = T0 + dt.timedelta(seconds=rnd.randrange(0, 86400 * 3), microseconds=rnd.randrange(0, 10 ** 6))
        rows.append((f"s{rnd.randrange(3)}", rnd.choice(["/a", None, "/b/c"]), ts, rnd.choice([200, 500, None]),
                     rnd.choice(["u1", None])))
    df = spark.createDataFrame(rows, "s string, e string, t timestamp, c int, u string") \
        .select("*", X.dedup_key("s", "e", "t", "c", "u").alias("k"))
    for r in df.collect():
        t = r.t.replace(microsecond=0)
        iso = t.strftime("%Y-%m-%dT%H:%M") + ("" if t.second == 0 else t.strftime(":%S")) + "Z"
        canon = "|".join([r.s, r.e or "", iso, str(r.c if r.c is not None else 0), r.u or ""])
        assert r.k == hashlib.sha256(canon.encode()).hexdigest()


def _risk(p, t):
    if p >= min(0.95, t + (1 - t) * 0.5):
        return "critical"
    if p >= t:
        return "high"
    if p >= max(0.05, t * 0.6):
        return "medium"
    return "low"


def test_risk_level_matches_definition(spark):
    rnd = random.Random(13)
    rows = [(round(rnd.random(), 3), rnd.choice([0.1, 0.3, 0.5, 0.8, 0.95])) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, t double").select(
        "p", "t", X.risk_level(F.col("p"), F.col("t")).alias("r"))
    for r in df.collect():
        assert r.r == _risk(r.p, r.t)


@pytest.mark.parametrize("chunk", [None, 9, 40])
def test_failure_labels_match_nested_loops(spark, chunk):
    rnd = random.Random(14)
    rows, truth = [], {}
    for s in ("a", "b", "c"):
        n = rnd.randrange(30, 90)
        bad = [int(rnd.random() < 0.6) for _ in range(n)]
        starts = [i for i in range(n - 4) if all(bad[i:i + 5])]
        lab = [0] * n
        for i in starts:                       # the 15 rows before a streak start
            for j in range(max(0, i - 15), i):
                lab[j] = 1
        for k, b in enumerate(bad):
            rows.append((s, k, 2500 if b else 100, 0.0))
            truth[(s, mins(k))] = (int(k in starts), lab[k])
    f = FE.failure_labels(FE.as_numeric(metric_rows(spark, rows)), chunk_rows=chunk)
    got = {(r.service_id, r.window_start): (r.streak_start, r.failure_target) for r in f.collect()}
    assert got == truth


def test_alert_frequency_matches_brute_force(spark):
    rnd = random.Random(15)
    rows = []
    for s in ("a", "b"):
        for _ in range(120):
            t = T0 + dt.timedelta(hours=rnd.randrange(0, 96))
            rows.append((s, t, rnd.randrange(0, 3)))
    rows = list({(s, t, o): None for s, t, o in rows})    # (service, time, trigger) unique
    df = spark.createDataFrame(rows, "service_id string, window_start timestamp, trigger_order int")
    got = {(r.service_id, r.window_start, r.trigger_order): r.alert_frequency_24h
           for r in AL.alert_frequency(df).collect()}
    for s, t, o in rows:
        exp = sum(1 for s2, t2, o2 in rows
                  if s2 == s and t - dt.timedelta(hours=24) < t2 and (t2 < t or (t2 == t and o2 < o)))
        assert got[(s, t, o)] == exp


def _simulate_alerts(series, until):
    """Minute-by-minute rule: latency first, else error; open if none open for
    (service, trigger); close all of a service that does not breach (or is silent)."""
    out, open_ = [], {}
    services = {s for s, _ in series}
    for k in range(0, until + 1):
        breaching = set()
        for s in sorted(services):
            if (s, k) not in series:
                continue
            p99, err = series[(s, k)]
            trig = "latency" if p99 > 2000 else ("error_rate" if err > 0.10 else None)
            if trig:
                breaching.add(s)
                if (s, trig) not in open_:
                    open_[(s, trig)] = k
        for (s, trig), o in list(open_.items()):
            if s not in breaching:
                out.append((s, trig, mins(o), mins(k)))
                del open_[(s, trig)]
    out += [(s, trig, mins(o), None) for (s, trig), o in open_.items()]
    return sorted(out, key=str)


def test_alert_islands_match_simulation(spark):
    rnd = random.Random(16)
    series = {}
    for s in ("a", "b", "c"):
        for k in range(200):
            if rnd.random() < 0.15:
                continue                              # silent minute
            p99 = rnd.choice([100, 1999.99, 2000, 2000.01, 4500])
            err = rnd.choice([0.0, 0.1, 0.1001, 0.3])
            series[(s, k)] = (p99, err)
    until = max(k for _, k in series)
    m = metric_rows(spark, [(s, k, p, e) for (s, k), (p, e) in series.items()])
    got = sorted(((r.service_id, r.triggering_metric, r.opened_at, r.closed_at)
                  for r in AL.alert_lifecycle(m).collect()), key=str)
    assert got == _simulate_alerts(series, until)
