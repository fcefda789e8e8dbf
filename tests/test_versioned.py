"""The merge-on-read metrics table."""

import datetime as dt
from decimal import Decimal

import pytest

from pulsewatch import schemas as S
from pulsewatch.sources.versioned import MetricsTable

DAY = dt.datetime(2024, 1, 30)


def rows(spark, version, keys):
    one = Decimal("1.00")
    data = [(s, DAY + dt.timedelta(days=d), DAY + dt.timedelta(days=d, minutes=1), size, version, one, None, None, None, Decimal("0"), Decimal("1"), None, None,
             DAY + dt.timedelta(hours=version)) for s, d, size in keys]
    return spark.createDataFrame(data, S.METRICS)


def content(table, **kw):
    return {(r.service_id, (r.window_start - DAY).days, r.window_size): r.request_count for r in table.read(**kw).collect()}


def test_newest_version_wins_through_compaction_and_snapshots(spark, tmp_path):
    table, want = MetricsTable(spark, str(tmp_path / "m"), fanout=2), {}
    for v in range(1, 8):
        keys = [("a", v % 3, "1m"), ("b", 0, "1m"), ("a", v % 2, "1h")]
        table.upsert(rows(spark, v, keys))
        want |= {k: v for k in keys}
        assert content(table) == want
    per = {}
    for p in table.parts():
        per.setdefault((p.window_size, p.month), []).append(p.level)
    assert all(len(v) == len(set(v)) for v in per.values())  # fanout 2: one part a level
    table.upsert(rows(spark, 3, [("b", 0, "1m")]))  # an older version comes late
    assert content(table) == want and MetricsTable(spark, str(tmp_path / "m")).read("1h").count() == 2
    assert content(table, window_size="1m", since=DAY + dt.timedelta(days=1), until=DAY + dt.timedelta(days=2)) == {k: v for k, v in want.items() if k[1] == 1 and k[2] == "1m"}
    assert table.vacuum() > 0 and content(table) == want and table.vacuum() == 0


def test_a_commit_without_its_end_is_not_read(spark, tmp_path):
    table = MetricsTable(spark, str(tmp_path / "m"))
    table.upsert(rows(spark, 1, [("a", 0, "1m")]))
    table._write(rows(spark, 9, [("a", 0, "1m"), ("z", 0, "1m")]), 0)          # written, never committed
    (tmp_path / "m" / "_log" / "000000000002").mkdir()                          # begun, not ended
    assert content(table) == {("a", 0, "1m"): 1}
    table.upsert(rows(spark, 2, [("a", 0, "1m")]))
    assert content(table) == {("a", 0, "1m"): 2}


def test_delete_rewrites_touched_partitions_only(spark, tmp_path):
    table = MetricsTable(spark, str(tmp_path / "m"))
    table.upsert(rows(spark, 1, [("a", 0, "1m"), ("b", 0, "1m"), ("b", 10, "1m"), ("c", 10, "1m"), ("a", 0, "1h")]))
    table.upsert(rows(spark, 2, [("b", 0, "1m")]))
    before = set(table.parts())
    ids = spark.createDataFrame([("c",), (None,), ("nobody",)], "service_id string")
    assert table.delete(ids) == 1 and table.delete(ids) == 0
    kept = before & set(table.parts())
    assert {(p.window_size, p.month) for p in kept} == {("1m", "2024-01"), ("1h", "2024-01")}
    assert table.delete(spark.createDataFrame([("b",)], "service_id string"), since=DAY, until=DAY + dt.timedelta(days=1)) == 1
    assert content(table) == {("a", 0, "1m"): 1, ("b", 10, "1m"): 1, ("a", 0, "1h"): 1}


def test_empty_table_and_batch(spark, tmp_path):
    table = MetricsTable(spark, str(tmp_path / "m"))
    assert table.read().count() == 0 and table.delete(spark.createDataFrame([("a",)], "service_id string")) == 0
    table.upsert(rows(spark, 1, [("a", 0, "1m")]).limit(0))
    assert table.parts() == []


def test_writers_of_one_number_collide(spark, tmp_path):
    one, two = MetricsTable(spark, str(tmp_path / "m")), MetricsTable(spark, str(tmp_path / "m"))
    one.upsert(rows(spark, 1, [("a", 0, "1m")]))
    two._commits = lambda: []
    with pytest.raises(Exception, match="(?i)exist"):
        two._commit([], [])


def test_tail_reads_older_months_only_where_rows_lack(spark, tmp_path):
    table = MetricsTable(spark, str(tmp_path / "m"))
    table.upsert(rows(spark, 1, [("a", d, "1m") for d in range(0, 100, 2)] + [("b", d, "1m") for d in (0, 40, 95)] + [("gone", 3, "1m"), ("gone", 4, "1m"), ("a", 1, "1h")]))
    got = content(table)
    tail = {(r.service_id, (r.window_start - DAY).days) for r in table.read_tail("1m", 10).collect()}
    assert {d for s, d in tail if s == "b"} == {0, 40, 95}                       # all it has
    assert len([d for s, d in tail if s == "a"]) >= 10 and ("a", 0) not in tail   # its oldest month is not read
    assert {d for s, d in tail if s == "a"} >= set(range(80, 100, 2)) and "gone" not in {s for s, _ in tail}
    asked = spark.createDataFrame([("gone",), ("nobody",)], "service_id string")
    assert {(r.service_id, (r.window_start - DAY).days) for r in table.read_tail("1m", 1, asked).collect()} == {("gone", 3), ("gone", 4)}
    assert MetricsTable(spark, str(tmp_path / "none")).read_tail("1m", 5).count() == 0 and got
