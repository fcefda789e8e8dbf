"""Training and scoring jobs over a model store.

A store is a folder.  ``<module>/versions/<version>/`` holds the artifacts of
one training and, written last, a one-row JSON meta table; it never changes
afterwards.  ``<module>/active`` is a log of activations, one appended row each;
the newest row names the version that scorers read, so no reader sees a
half-written model and an older version can be made active again.  Everything is
read on every call, so a reload is simply the next load.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import exprs as X
from ..operators import alerts as AL
from ..operators import features as FE
from ..operators import maintain as MT
from ..operators import quality as QY
from ..session import cut_lineage
from ..sources import io as IO
from . import boost as BO
from . import evaluate as EV
from . import heuristics as H
from . import iforest as IF
from . import models as ML

MODULES = ("traffic", "failure", "anomaly", "alerts")


# ---- A12 store --------------------------------------------------------------------------------

def version_path(store: str, module: str, version: str) -> str:
    return f"{store}/{module}/versions/{version}"


def new_version(spark: SparkSession, store: str, module: str) -> str:
    """A version name that the module does not have yet."""
    base = name = IO.model_version()
    n = 1
    while IO.table_exists(spark, version_path(store, module, name)):
        n += 1
        name = f"{base}-{n}"
    return name


def save_meta(spark: SparkSession, store: str, module: str, version: str, algorithm: str, training_rows: int, metrics: dict,
              hyperparameters: dict) -> dict:
    """Complete a version: its meta is written after all artifacts, then it becomes the active one."""
    meta = {"module": module, "model_version": version, "algorithm": algorithm,
            "feature_columns": list(S.ALERT_FEATURES) if module == "alerts" else ML.FEATURES, "training_rows": int(training_rows),
            "metrics": metrics, "hyperparameters": hyperparameters, "trained_at": dt.datetime.now(dt.timezone.utc).isoformat()}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("errorifexists").text(f"{version_path(store, module, version)}/meta")
    activate(spark, store, module, version)
    return meta


def activate(spark: SparkSession, store: str, module: str, version: str) -> None:
    """Make a complete version the one that scorers read (also to roll back)."""
    if not IO.table_exists(spark, f"{version_path(store, module, version)}/meta"):
        raise ValueError(f"{module}: no complete version {version!r}")
    log = activations(spark, store, module)
    n = (log.agg(F.max("n")).first()[0] or 0) + 1 if log is not None else 1
    spark.createDataFrame([(n, version)], ACTIVATIONS).coalesce(1).write.mode("append").json(f"{store}/{module}/active")


ACTIVATIONS = "n long, model_version string"


def activations(spark: SparkSession, store: str, module: str) -> DataFrame | None:
    """(n, model_version): the module's activations, oldest first by n."""
    path = f"{store}/{module}/active"
    return spark.read.schema(ACTIVATIONS).json(path) if IO.table_exists(spark, path) else None


def active_version(spark: SparkSession, store: str, module: str) -> str | None:
    """The version activated last, or None when the module was never trained."""
    log = activations(spark, store, module)
    return log.agg(F.max_by("model_version", "n")).first()[0] if log is not None else None


def load_meta(spark: SparkSession, store: str, module: str, version: str | None = None) -> dict | None:
    """Meta of a version (default the active one), or None when the module was
    never trained (callers fall back to heuristics)."""
    version = version or active_version(spark, store, module)
    if version is None:
        return None
    return json.loads(spark.read.text(f"{version_path(store, module, version)}/meta").first()["value"])


def save_model(model, store: str, module: str, version: str, name: str = "model") -> None:
    path = f"{version_path(store, module, version)}/{name}"
    model.save(path) if isinstance(model, BO.Boosted) else model.write().save(path)


def load_model(store: str, module: str, version: str, name: str = "model"):
    path = f"{version_path(store, module, version)}/{name}"
    return BO.Boosted.load(path) if module in BOOSTED else PipelineModel.load(path)


BOOSTED = ("traffic", "failure")


def list_models(spark: SparkSession, store: str) -> DataFrame:
    """(module, model_version, algorithm, training_rows) of the active models."""
    rows = [(m["module"], m["model_version"], m["algorithm"], m["training_rows"]) for m in
            (load_meta(spark, store, x) for x in MODULES) if m]
    return spark.createDataFrame(rows, "module string, model_version string, algorithm string, training_rows int")


def run_row(spark: SparkSession, meta: dict, artifact_path: str) -> DataFrame:
    """One ``ml_model_results`` row for a training run."""
    return spark.createDataFrame([(
        f"{meta['module']}-{meta['model_version']}", meta["module"], meta["model_version"], meta["algorithm"],
        dt.datetime.fromisoformat(meta["trained_at"]).replace(tzinfo=None), meta["training_rows"],
        json.dumps(meta["hyperparameters"]), json.dumps(meta["metrics"]), artifact_path, False)], schema=S.MODEL_RUNS)


# ---- K23 training -----------------------------------------------------------------------------

def _train_traffic(spark, store, version, features, context, **params) -> dict:
    horizons = context["horizons"]
    complete = QY.drop_incomplete(FE.horizon_targets(features, horizons), ML.FEATURES + [f"target_{h}" for h in horizons])
    rows = _guarded(complete, "traffic")
    model, report = ML.train_traffic(features, horizons=horizons, **params)
    save_model(model, store, "traffic", version)
    metrics = {f"{k}_h{r['horizon']}": float(r[k]) for r in report.collect() for k in ("n", "rmse", "mape", "train_mean") if r[k] is not None}
    return save_meta(spark, store, "traffic", version, "HistogramBoosting per horizon", rows, metrics, {"horizons": list(horizons), **params})


def _train_failure(spark, store, version, features, context, **params) -> dict:
    rows = _guarded(QY.drop_incomplete(FE.failure_labels(features), ML.FEATURES), "failure")
    model, sweep, report = ML.train_failure(features, **params)
    save_model(model, store, "failure", version)
    metrics = {k: float(v) for k, v in report.first().asDict().items() if v is not None}
    threshold = float(EV.best_threshold(sweep).first()["threshold"])
    return save_meta(spark, store, "failure", version, "HistogramBoosting", rows, metrics, {"decision_threshold": threshold, **params})


def _train_anomaly(spark, store, version, features, context, **params) -> dict:
    complete = QY.drop_incomplete(features, ML.FEATURES)
    rows = complete.count()
    if rows == 0:
        raise ValueError("anomaly: no complete feature rows to train on")
    scaler, forest, scored, sweep = ML.train_anomaly(features, labels=context["labels"], **params)
    path = version_path(store, "anomaly", version)
    save_model(scaler, store, "anomaly", version, "scaler")
    forest.write.parquet(f"{path}/forest")
    sweep.write.parquet(f"{path}/sweep")
    best = sweep.filter("is_best").first()
    return save_meta(spark, store, "anomaly", version, "IsolationForest", rows, {"f1": float(best["f1"])},
                     {"contamination": float(best["contamination"]), "cutoff": float(best["cutoff"]), **params})


def _train_alerts(spark, store, version, features, context, **params) -> dict:
    rows = _guarded(context["alerts"], "alerts")
    model, report = ML.train_priority(context["alerts"], **params)
    save_model(model, store, "alerts", version)
    report.write.parquet(f"{version_path(store, 'alerts', version)}/report")
    macro = report.filter(F.col("cls") == "macro").first().asDict()
    return save_meta(spark, store, "alerts", version, "RandomForestClassifier", rows,
                     {k: float(macro[k]) for k in ("precision", "recall", "f1", "accuracy") if macro[k] is not None}, params)


def _guarded(rows: DataFrame, module: str) -> int:
    """Rows of the train split; no rows is an error, as in the product."""
    train, test = FE.chrono_split(rows)
    n = train.count()
    if n == 0:
        raise ValueError(f"{module}: no usable rows after feature engineering; extend the history")
    return n


TRAINERS = {"traffic": _train_traffic, "failure": _train_failure, "anomaly": _train_anomaly, "alerts": _train_alerts}


def train(spark: SparkSession, metrics: DataFrame, store: str, modules=None, days: int | None = 30, window_size: str = "1m",
          lags=S.FEATURE_LAGS, rolling: int = S.FEATURE_ROLLING, horizons=S.TRAFFIC_HORIZONS, labels: DataFrame | None = None,
          services: DataFrame | None = None, params: dict | None = None) -> DataFrame:
    """Train the modules (default all) on the last ``days`` of the metric
    rows, save each with every artifact (A12) and return their run rows (A11),
    newest per module active.  Unknown modules and empty data are errors.

    A fit reads its input many times: the metric rows, the features, the alert
    contexts and the labels are materialised first, each once, so that whatever
    ``metrics`` and ``labels`` derive from (raw logs) is read once a call."""
    wanted = list(modules or MODULES)
    unknown = [m for m in wanted if m not in TRAINERS]
    if unknown:
        raise ValueError(f"unknown module(s): {unknown}; valid: {list(MODULES)}")
    rows = cut_lineage(metrics.filter(F.col("window_size") == window_size))
    newest = rows.agg(F.max("window_start")).first()[0]
    if newest is None:
        raise ValueError("no metrics to train on")
    if days is not None:
        rows = rows.filter(F.col("window_start") >= F.lit(newest - dt.timedelta(days=days)))
    features = cut_lineage(FE.build_features(rows, lags=lags, rolling=rolling)) if set(wanted) - {"alerts"} else None
    alerts = cut_lineage(AL.label_priority(AL.alert_frequency(AL.alert_candidates(rows, services)))) if "alerts" in wanted else None
    if labels is not None and "anomaly" in wanted:
        labels = cut_lineage(labels)
    context = {"horizons": horizons, "labels": labels, "alerts": alerts}
    runs = []
    for m in wanted:
        version = new_version(spark, store, m)
        meta = TRAINERS[m](spark, store, version, features, context, **(params or {}).get(m, {}))
        runs.append(run_row(spark, meta, version_path(store, m, version)))
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return MT.active_runs(out)


# ---- K22 scoring ------------------------------------------------------------------------------

def _with_rest(by_model: DataFrame, heuristic: DataFrame) -> DataFrame:
    """The model's rows, and the heuristic's for the services it has no row for."""
    return by_model.unionByName(heuristic.join(by_model.select("service_id").distinct(), "service_id", "left_anti"))


def score(spark: SparkSession, module: str, metrics: DataFrame, store: str | None = None, features: DataFrame | None = None,
          window_size: str = "1m", min_rows: int = S.FEATURE_MIN_ROWS, contexts: DataFrame | None = None,
          snapshot_only: bool = False) -> DataFrame:
    """Prediction rows (A10) of one module.

    The stored model scores the services that have a complete inference row
    (G8); the others, and modules never trained, get the heuristic.  ``alerts``
    scores ``contexts`` (rows of ``alert_candidates``).  ``snapshot_only``
    (D8): anomaly scores from the newest metric row alone, by the heuristic."""
    if module not in (*MODULES, "health"):
        raise ValueError(f"unknown module {module!r}")
    meta = load_meta(spark, store, module) if store is not None and module != "health" else None
    if module == "alerts":
        return _score_alerts(spark, contexts, store, meta)
    heuristic = ML.heuristic_predictions(metrics, window_size)
    rows = heuristic.filter(F.col("module") == module)
    if meta is None or features is None or (module == "anomaly" and snapshot_only):
        return rows
    step = F.make_dt_interval(mins=F.lit(S.WINDOW_MINUTES[window_size]))
    ready, _ = FE.latest_features(features, min_rows=min_rows)
    ready = ready.withColumn("generated_at", F.col("window_start") + step)
    version = meta["model_version"]
    if module == "traffic":
        out, model = None, load_model(store, "traffic", version)
        for k, h in enumerate(meta["hyperparameters"]["horizons"]):
            scored = model.transform(ready, k).withColumn("predicted_rpm", F.greatest(F.lit(0.0), F.col("prediction")))
            part = ML.prediction_rows(scored, "traffic", version, F.struct("service_id", F.lit(h).alias("horizon_minutes"), "predicted_rpm"), horizon=F.lit(h))
            out = part if out is None else out.unionByName(part)
        return _with_rest(out, rows)
    if module == "failure":
        model, t = load_model(store, "failure", version), float(meta["hyperparameters"]["decision_threshold"])
        top = F.array(*[F.struct(F.lit(c["feature"]).alias("feature"), F.lit(c["contribution"]).alias("contribution"))
                        for c in ML.top_contributions(model)])           # K24
        scored = model.transform(ready, out="failure_probability") \
            .withColumn("risk_level", X.risk_level(F.col("failure_probability"), F.lit(t))).withColumn("contributing_features", top)
        return _with_rest(ML.prediction_rows(scored, "failure", version, F.struct(
            "service_id", "failure_probability", "risk_level", F.lit(30).alias("horizon_minutes"), "contributing_features"), horizon=F.lit(30)), rows)
    scored = ML.score_anomaly(load_model(store, "anomaly", version, "scaler"), spark.read.parquet(f"{version_path(store, 'anomaly', version)}/forest"),
                              ready, meta["hyperparameters"]["cutoff"]).join(ready.select("service_id", "generated_at"), "service_id")
    return _with_rest(ML.prediction_rows(scored, "anomaly", version, F.struct(
        "service_id", "anomaly_score", "is_anomaly", F.lit(meta["hyperparameters"]["contamination"]).alias("contamination"))), rows)


def _score_alerts(spark: SparkSession, contexts: DataFrame | None, store: str | None, meta: dict | None) -> DataFrame:
    """Priority of alert contexts; the only module with a confidence."""
    if contexts is None:
        raise ValueError("alerts are scored from alert contexts")
    at = contexts.withColumn("generated_at", F.col("window_start"))
    value: Column = F.struct("service_id", "triggering_metric", "priority")
    if meta is None:
        return ML.prediction_rows(H.heuristic_priority(at), "alerts", S.HEURISTIC_MODEL_VERSION, value)
    # contexts are few bytes and a shuffle leaves them in a task or two; in ranges of time all
    # tasks walk the forest, and each writes the files of its own dates
    at = at.repartitionByRange(spark.sparkContext.defaultParallelism, "generated_at", "service_id")
    scored = ML.score_priority(load_model(store, "alerts", meta["model_version"]), at).withColumn("priority", F.col("predicted_priority"))
    return ML.prediction_rows(scored, "alerts", meta["model_version"], value, confidence=F.round("confidence", 4))
