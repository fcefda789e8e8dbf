"""Model quality floors and store round trips."""

import json

import pytest
from pyspark.sql import functions as F

from pulsewatch.ml import jobs as MJ
from pulsewatch.ml import models as ML
from pulsewatch.operators import alerts as AL
from pulsewatch.operators import features as FE
from pulsewatch.plans import load_all
from pulsewatch.session import cut_lineage

from .conftest import SF_MED

load_all()
from pulsewatch.plans.alerting import candidates  # noqa: E402
from pulsewatch.plans.core import metrics_of  # noqa: E402
from pulsewatch.plans.features import HORIZONS, LAGS, ROLLING, features  # noqa: E402


def test_priority_forest_learns_the_rule(spark):
    lab = AL.label_priority(AL.alert_frequency(candidates(spark, SF_MED)))
    _, rep = ML.train_priority(lab, n_trees=30, max_depth=8)
    macro = rep.filter(F.col("cls") == "macro").first()
    assert macro.accuracy >= 0.9


def test_failure_report(spark):
    f = features(spark, SF_MED)
    model, sweep, rep = ML.train_failure(f, max_iter=5, max_depth=3)
    r = rep.first()
    assert 0.0 <= r.roc_auc <= 1.0 and r.tp + r.fp + r.fn + r.tn > 0
    assert sweep.filter("is_best").count() <= 1
    top = ML.top_contributions(model)
    assert len(top) == 5 and top[0]["contribution"] >= top[-1]["contribution"]


def test_train_store_and_score_every_module(spark, tmp_path):
    store = str(tmp_path / "store")
    m = metrics_of(spark, SF_MED, "1h")
    small = {"traffic": {"max_iter": 2, "max_depth": 2}, "failure": {"max_iter": 2, "max_depth": 2}, "anomaly": {"n_trees": 10},
             "alerts": {"n_trees": 4, "max_depth": 3}}
    with pytest.raises(ValueError, match="unknown module"):
        MJ.train(spark, m, store, modules=["traffic", "nope"])
    with pytest.raises(ValueError, match="no metrics"):
        MJ.train(spark, m.limit(0), store, window_size="1h")
    with pytest.raises(ValueError, match="no usable rows"):
        MJ.train(spark, m, store, modules=["traffic"], window_size="1h", days=1, lags=LAGS, rolling=ROLLING, horizons=HORIZONS, params=small)
    runs = MJ.train(spark, m, store, days=None, window_size="1h", lags=LAGS, rolling=ROLLING, horizons=HORIZONS, params=small).collect()
    assert sorted(r.module for r in runs) == ["alerts", "anomaly", "failure", "traffic"] and all(r.is_active for r in runs)
    assert MJ.list_models(spark, store).count() == 4 and MJ.load_meta(spark, str(tmp_path / "none"), "failure") is None
    f, contexts = features(spark, SF_MED), AL.label_priority(AL.alert_frequency(candidates(spark, SF_MED)))
    model = MJ.load_model(store, "failure", MJ.active_version(spark, store, "failure"))
    by_hand = {r.service_id: r.p for r in model.transform(FE.latest_features(f, min_rows=39)[0], out="p").select("service_id", "p").collect()}
    for module, n in (("traffic", 4), ("failure", 1), ("anomaly", 1)):
        rows = MJ.score(spark, module, m, store, f, "1h", 39).collect()
        assert len(rows) == 5 * n and all(r.confidence is None and json.loads(r.value)["service_id"] == r.service_id for r in rows)
        assert all(r.model_version != "heuristic-0" and r.generated_at.minute == 0 for r in rows)
        if module == "failure":
            assert {r.service_id: json.loads(r.value)["failure_probability"] for r in rows} == pytest.approx(by_hand)
    heuristic = {r.model_version for r in MJ.score(spark, "anomaly", m, store, f, "1h", 39, snapshot_only=True).collect()}
    stored = {r.model_version for r in MJ.score(spark, "anomaly", m, store, f, "1h", 39).collect()}
    assert heuristic.isdisjoint(stored)
    alerts = MJ.score(spark, "alerts", m, store, contexts=contexts).collect()
    assert len(alerts) == contexts.count() and all(0 < r.confidence <= 1 for r in alerts)
    assert {r.model_version for r in MJ.score(spark, "failure", m, str(tmp_path / "none"), f, "1h", 39).collect()} == heuristic


def test_training_reads_what_it_is_given_once(spark, tmp_path):
    """However many passes a fit makes, the rows that metrics and labels derive from are read once."""
    def counted(df):
        seen = spark.sparkContext.accumulator(0)

        def count(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf
        return df.mapInPandas(count, df.schema), seen

    m = cut_lineage(metrics_of(spark, SF_MED, "1h"))
    labels = m.select("service_id", "window_start", (F.col("error_rate") > 0.5).alias("is_anomaly"))
    (rows, seen), (marks, marks_seen) = counted(m), counted(labels)
    MJ.train(spark, rows, str(tmp_path / "store"), modules=["failure", "anomaly"], days=None, window_size="1h", lags=LAGS, rolling=ROLLING,
             horizons=HORIZONS, labels=marks, params={"failure": {"max_iter": 2, "max_depth": 2}, "anomaly": {"n_trees": 10}})
    assert seen.value == marks_seen.value == m.count()


def test_hourly_rows_are_made_once_and_alerts_scored_by_all_tasks(spark, tmp_path):
    from pulsewatch.plans import models as PM
    m = PM.hourly(spark, SF_MED)
    assert PM.hourly(spark, SF_MED) is m
    lab = cut_lineage(AL.label_priority(AL.alert_frequency(candidates(spark, SF_MED))))
    MJ.train(spark, m, str(tmp_path / "store"), modules=["alerts"], days=None, window_size="1h", params={"alerts": {"n_trees": 2, "max_depth": 2}})
    rows = MJ.score(spark, "alerts", m, str(tmp_path / "store"), contexts=lab.coalesce(1))
    spread = rows.groupBy(F.spark_partition_id().alias("task"), F.to_date("generated_at").alias("date")).count().collect()
    tasks, dates = {r.task for r in spread}, {r.date for r in spread}
    assert len(tasks) > 1 and len(spread) < len(dates) + len(tasks) and sum(r["count"] for r in spread) == lab.count()


def test_priority_scoring(spark):
    lab = AL.label_priority(AL.alert_frequency(candidates(spark, SF_MED)))
    model, _ = ML.train_priority(lab, n_trees=10, max_depth=5)
    ctx = lab.drop("priority").limit(20).withColumn("current_health_score", F.lit(None).cast("double"))
    out = ML.score_priority(model, ctx).collect()
    assert len(out) == 20
    assert all(r.predicted_priority in ("low", "medium", "high", "critical") for r in out)
    assert all(0.0 <= r.confidence <= 1.0 for r in out)


def test_traffic_model_feeds_tile(spark):
    from pulsewatch.operators import views as V
    from pulsewatch.plans.core import metrics_of
    f = features(spark, SF_MED)
    model, rep = ML.train_traffic(f, horizons=(1, 24), max_iter=3, max_depth=3)
    assert rep.count() == 2
    fc = ML.score_traffic(model, f, 1, min_rows=39)
    assert fc.count() == 5 and all(r.predicted_rpm >= 0 for r in fc.collect())
    assert ML.score_traffic(model, f, 6, min_rows=39).count() == 0
    tile = V.traffic_tile(metrics_of(spark, SF_MED, "1h"), window_size="1h", forecasts=fc, min_history=1)
    assert tile.filter(F.col("forecast_rpm").isNull()).count() == 0


def test_anomaly_fit_and_score_new_rows(spark):
    f = features(spark, SF_MED)
    scaler, forest, z = ML.fit_anomaly(f, n_trees=20)
    cut = z.count() and ML.IF.score(z, forest, ML.ZCOLS).agg(
        F.percentile("iso_score", F.lit(0.95)).alias("c")).first().c
    out = ML.score_anomaly(scaler, forest, f, cut)
    rows = out.collect()
    assert rows and all(0.0 <= r.anomaly_score <= 1.0 for r in rows)
    share = sum(r.is_anomaly for r in rows) / len(rows)
    assert 0.02 <= share <= 0.1
