"""Model training and scoring with MLlib.

Models are fitted on the chronological train split and evaluated on the test
split with the aggregate reports of ``ml.evaluate``.  Tree counts, depths and
rates default to the product's.  Boosting is ``ml.boost`` (histograms in barrier
stages); the priority forest and the scalers are MLlib's.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import features as FE
from ..session import cut_lineage
from ..operators import quality as QY
from . import boost as BO
from . import evaluate as EV
from . import iforest as IF

FEATURES = list(S.FEATURE_COLUMNS)


ROWS_PER_PARTITION = 20_000


def split_rows(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """G9 chronological split, materialised: (train, test, train rows).  The
    partitions follow the rows: small tables are not all scheduling, and rows that
    a shuffle packed into a few tasks by their bytes are spread for the fit."""
    whole = cut_lineage(df)
    parts = max(1, -(-whole.count() // ROWS_PER_PARTITION))
    train, test = FE.chrono_split(whole)
    if parts < whole.rdd.getNumPartitions():
        train, test = train.coalesce(parts), test.coalesce(parts)
    elif parts > whole.rdd.getNumPartitions():
        train, test = train.repartition(parts), test.repartition(parts)
    train, test = cut_lineage(train), cut_lineage(test)
    return train, test, train.count()


# ---- K3 / K4 traffic ------------------------------------------------------------------

KEY = ["service_id", "window_start"]


def train_traffic(features: DataFrame, horizons=S.TRAFFIC_HORIZONS, max_iter: int = 300, max_depth: int = 6, step: float = 0.05,
                  subsample: float = 0.8, colsample: float = 0.8, seed: int = 42) -> tuple[BO.Boosted, DataFrame]:
    """One boosted regressor per horizon, grown side by side over the same
    rows.  Returns (model whose targets are the horizons, per-horizon RMSE/MAPE
    on test and the mean of the training targets, where boosting starts)."""
    targets = [f"target_{h}" for h in horizons]
    df = QY.drop_incomplete(FE.horizon_targets(features, horizons), FEATURES + targets)
    train, test, _ = split_rows(df)
    settings = BO.Settings(max_iter, max_depth, step, subsample, colsample, seed=seed)
    model = BO.fit(train, FEATURES, targets, KEY, settings)
    reports = [EV.regression_report(model.transform(test, k), t, "prediction").withColumn("horizon", F.lit(h)).withColumn("train_mean", F.lit(model.base[k]))
               for k, (h, t) in enumerate(zip(horizons, targets))]
    rep = reports[0]
    for r in reports[1:]:
        rep = rep.unionByName(r)
    return model, rep


# ---- K5-K7 failure ----------------------------------------------------------------------

def train_failure(features: DataFrame, max_iter: int = 800, max_depth: int = 8, step: float = 0.03, subsample: float = 0.85,
                  colsample: float = 0.8, seed: int = 42, run: int = S.FAILURE_RUN, lookahead: int = S.FAILURE_LOOKAHEAD,
                  min_child_weight: float = 2.0, gamma: float = 0.1) -> tuple[BO.Boosted, DataFrame, DataFrame]:
    """Boosted classifier with positive weight sqrt(neg/pos); threshold swept on
    test by F1.5.  Returns (model, sweep, report)."""
    df = QY.drop_incomplete(FE.failure_labels(features, run, lookahead), FEATURES)
    train, test, _ = split_rows(df)
    counts = train.agg(F.sum("failure_target").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    pos = max(1, int(counts["pos"] or 0))
    neg = max(1, int(counts["n"]) - pos)
    w_pos = math.sqrt(neg / pos)
    train = train.withColumn("_w", F.when(F.col("failure_target") == 1, F.lit(w_pos)).otherwise(F.lit(1.0)))
    settings = BO.Settings(max_iter, max_depth, step, subsample, colsample, min_child_weight, gamma, logistic=True, seed=seed)
    model = BO.fit(train, FEATURES, ["failure_target"], KEY, settings, weight="_w")
    scored = cut_lineage(model.transform(test, out="p"))
    sweep = EV.threshold_sweep(scored, "failure_target", "p")
    best = EV.best_threshold(sweep).select(F.col("threshold").alias("_t"))
    pred = scored.crossJoin(F.broadcast(best)).withColumn("yhat", (F.col("p") >= F.col("_t")).cast("int"))
    report = EV.classification_report(pred, "failure_target", "yhat").crossJoin(
        EV.rank_auc(scored, "failure_target", "p")).withColumn("scale_pos_weight", F.lit(w_pos))
    return model, sweep, report


def top_contributions(model: BO.Boosted, k: int = 5) -> list[dict]:
    """The k largest feature importances of a boosted model (15
    numbers of the model, not data)."""
    pairs = sorted(zip(model.features, model.importances()), key=lambda x: -x[1])[:k]
    return [{"feature": f, "contribution": float(v)} for f, v in pairs]


# ---- K8-K10 anomaly -----------------------------------------------------------------------

ZCOLS = [f"z{i}" for i in range(len(FEATURES))]


def _standardised(scaler: PipelineModel, df: DataFrame) -> DataFrame:
    z = scaler.transform(df).withColumn("_z", vector_to_array("features"))
    return z.select("service_id", "window_start", *[F.col("_z")[i].alias(c) for i, c in enumerate(ZCOLS)])


def fit_anomaly(features: DataFrame, n_trees: int = 200, max_samples: int = 256
                ) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """K2 + K8: scaler fitted on the complete feature rows, then the forest on
    the standardised rows.  Returns (scaler, forest node table, standardised rows)."""
    df = QY.drop_incomplete(features, FEATURES)
    scaler = BO.scaler_for(FEATURES).fit(df)
    z = cut_lineage(_standardised(scaler, df))
    # trees x nodes rows, grown once for scoring and for the store
    forest = cut_lineage(IF.fit(z, ZCOLS, ["service_id", "window_start"], n_trees=n_trees, max_samples=max_samples))
    return scaler, forest, z


def score_anomaly(scaler: PipelineModel, forest: DataFrame, features: DataFrame, cutoff: float
                  ) -> DataFrame:
    """K8/K10 inference: isolation score of new feature rows, flag strictly above
    the contamination cut-off, and the 0..1 score (floor = offset - 0.1)."""
    from . import heuristics as H
    scored = IF.score(_standardised(scaler, QY.drop_incomplete(features, FEATURES)), forest, ZCOLS)
    return scored.withColumn("is_anomaly", F.col("iso_score") > F.lit(cutoff)) \
        .withColumn("anomaly_score", H.normalised_anomaly(-F.col("iso_score"), F.lit(-cutoff - 0.1), 0.0))


def train_anomaly(features: DataFrame, labels: DataFrame | None = None, n_trees: int = 200,
                  max_samples: int = 256, grid=S.CONTAMINATION_GRID
                  ) -> tuple[PipelineModel, DataFrame, DataFrame, DataFrame]:
    """Isolation forest on standardised features; contamination chosen by F1
    against labels when given (else the default).  The forest is fitted once:
    contamination only moves the cut-off.  Returns (scaler, forest, scored rows, sweep)."""
    df = cut_lineage(QY.drop_incomplete(features, FEATURES))
    scaler, forest, z = fit_anomaly(df, n_trees=n_trees, max_samples=max_samples)
    # one vectorised scoring pass, materialised: every contamination value reads it
    scored = cut_lineage(IF.score(z, forest, ZCOLS))
    cuts = IF.cutoffs(scored, list(grid))
    if labels is not None:
        scored = FE.join_labels(scored, labels)
    else:
        scored = scored.withColumn("is_anomaly", F.lit(False))
    sc = scored.crossJoin(F.broadcast(cuts))  # one-row side
    rows = [sc.agg(
        F.lit(c).alias("contamination"),
        F.sum(((F.col("iso_score") > F.col(f"c{i}")) & F.col("is_anomaly")).cast("int")).alias("tp"),
        F.sum(((F.col("iso_score") > F.col(f"c{i}")) & ~F.col("is_anomaly")).cast("int")).alias("fp"),
        F.sum(((F.col("iso_score") <= F.col(f"c{i}")) & F.col("is_anomaly")).cast("int")).alias("fn"),
        F.first(F.col(f"c{i}")).alias("cutoff")) for i, c in enumerate(grid)]
    sweep = rows[0]
    for r in rows[1:]:
        sweep = sweep.unionByName(r)
    sweep = sweep.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
                             .otherwise(F.lit(0.0)))
    # K9: first grid value with the best F1 (the default when no label is positive)
    from pyspark.sql import Window
    has_pos = F.max(F.col("tp") + F.col("fn")).over(Window.partitionBy()) > 0     # <= 6 rows
    rank = F.row_number().over(Window.orderBy(F.col("f1").desc(), F.col("contamination")))
    sweep = sweep.withColumn("is_best", F.when(has_pos, rank == 1)
                             .otherwise(F.col("contamination") == S.ANOMALY_CONTAMINATION_DEFAULT))
    # 0..1 anomaly score; raw = score_samples (= -iso), floor = offset - 0.1, ceiling 0;
    # rows are flagged and scored at the best contamination's cut-off
    from . import heuristics as H
    sweep = cut_lineage(sweep)                                                     # <= 6 rows
    best = sweep.filter("is_best").select(F.col("cutoff").alias("_cut"))
    scored = scored.crossJoin(F.broadcast(best)).withColumn(                       # one-row side
        "anomaly_score", H.normalised_anomaly(-F.col("iso_score"), -F.col("_cut") - 0.1, 0.0)) \
        .withColumn("is_anomaly_pred", F.col("iso_score") > F.col("_cut")).drop("_cut")
    return scaler, forest, scored, sweep


# ---- K14 / K15 priority ------------------------------------------------------------------

def priority_feature(c: str):
    """Model input column of an alert context; a missing health score reads as
    75 and missing flags / counts as 0 (C13), so scoring never meets a null."""
    default = S.ALERT_HEALTH_DEFAULT if c == "current_health_score" else 0.0
    return F.coalesce(F.col(c).cast("double"), F.lit(float(default))).alias(c)


def train_priority(alerts: DataFrame, n_trees: int = 200, max_depth: int = 12, seed: int = 42
                   ) -> tuple[PipelineModel, DataFrame]:
    """Random forest over the 8 alert-context features with balanced class
    weights n / (k * n_class); labels indexed alphabetically (same order as a
    label encoder).  Returns (model, macro report on the test split)."""
    df = alerts.select(*[priority_feature(c) for c in S.ALERT_FEATURES], "priority", "window_start")
    train, test, _ = split_rows(df)
    cls = train.groupBy("priority").agg(F.count(F.lit(1)).alias("_nc"))
    k = cls.count()
    tot = train.count()
    train = train.join(F.broadcast(cls), "priority").withColumn(  # a row a class; the rows stay spread
        "_w", F.lit(float(tot)) / (F.lit(float(k)) * F.col("_nc")))
    idx = StringIndexer(inputCol="priority", outputCol="label", stringOrderType="alphabetAsc",
                        handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="_w", numTrees=n_trees,
                                maxDepth=max_depth, minInstancesPerNode=4, seed=seed)
    asm = VectorAssembler(inputCols=list(S.ALERT_FEATURES), outputCol="features")
    model = Pipeline(stages=[idx, asm, rf]).fit(train)
    labels = model.stages[0].labels
    to_str = IndexToString(inputCol="prediction", outputCol="predicted_priority", labels=labels)
    pred = to_str.transform(model.transform(test)) \
        .withColumn("confidence", F.array_max(vector_to_array("probability")))
    return model, EV.macro_report(pred, "priority", "predicted_priority")


# ---- K22 scoring -----------------------------------------------------------------------------

def prediction_rows(df: DataFrame, module: str, version, value, horizon=None, confidence=None) -> DataFrame:
    """A10 rows; ``value`` holds the service id as the product's responses do."""
    return df.select(
        "service_id", F.lit(module).alias("module"),
        (version if not isinstance(version, str) else F.lit(version)).alias("model_version"),
        F.col("generated_at"),
        (horizon if horizon is not None else F.lit(None)).cast("int").alias("horizon_minutes"),
        F.to_json(value).alias("value"),
        (confidence if confidence is not None else F.lit(None)).cast("decimal(5,4)").alias("confidence"))


def heuristic_predictions(metrics: DataFrame, window_size: str = "1m", horizon: int = 60) -> DataFrame:
    """K22 without models: health, anomaly, failure and traffic predictions for
    the latest window of every service, as ``predictions`` rows (A10, C15).
    ``generated_at`` is the end of the scored window (replayable)."""
    from . import heuristics as H
    from ..operators import metrics as M
    v = S.HEURISTIC_MODEL_VERSION
    latest = M.latest_per_service(metrics, window_size).withColumn("generated_at", F.col("window_end"))
    h = H.health_score(latest)
    health = prediction_rows(h, "health", v, F.struct("service_id", F.col("health_score").alias("score"),
                                                       F.col("health_status").alias("status"), "components"))
    a = H.heuristic_anomaly(latest)
    anomaly = prediction_rows(a, "anomaly", v, F.struct("service_id", "anomaly_score", "is_anomaly", "contamination"))
    f = H.heuristic_failure(metrics.filter(F.col("window_size") == window_size)) \
        .join(latest.select("service_id", "generated_at"), "service_id")
    failure = prediction_rows(f, "failure", v, F.struct("service_id", "failure_probability", "risk_level",
                                                         F.lit(30).alias("horizon_minutes")), horizon=F.lit(30))
    t = H.naive_forecast(latest)
    traffic = prediction_rows(t, "traffic", v, F.struct("service_id", F.lit(horizon).alias("horizon_minutes"), "predicted_rpm"),
                               horizon=F.lit(horizon))
    return health.unionByName(anomaly).unionByName(failure).unionByName(traffic)


def score_priority(model: PipelineModel, contexts: DataFrame) -> DataFrame:
    """Priority and confidence (the winning class probability) for
    alert contexts, from a fitted ``train_priority`` pipeline."""
    labels = model.stages[0].labels
    x = contexts.select("*", *[priority_feature(c).alias(f"_f_{c}") for c in S.ALERT_FEATURES])
    asm_in = {c: f"_f_{c}" for c in S.ALERT_FEATURES}
    # the pipeline's assembler reads the plain names: swap the defaulted copies in
    for c, tmp in asm_in.items():
        x = x.drop(c).withColumnRenamed(tmp, c)
    x = x.withColumn("priority", F.lit(labels[0]))           # indexer input; not used for prediction
    pred = IndexToString(inputCol="prediction", outputCol="predicted_priority", labels=labels) \
        .transform(model.transform(x))
    return pred.withColumn("confidence", F.array_max(vector_to_array("probability"))) \
        .drop("label", "features", "rawPrediction", "probability", "prediction")


def score_traffic(model: BO.Boosted, features: DataFrame, horizon: int, min_rows: int = S.FEATURE_MIN_ROWS
                  ) -> DataFrame:
    """K3/K19 inference: the horizon's model scores each service's latest
    complete feature row (G8), floored at 0.  Services without one, or a
    horizon without a model, are left out; ``views.traffic_tile`` then falls
    back to the naive forecast for them."""
    if f"target_{horizon}" not in model.targets:
        return features.sparkSession.createDataFrame([], "service_id string, predicted_rpm double")
    ready, _ = FE.latest_features(features, min_rows=min_rows)
    return model.transform(ready, model.targets.index(f"target_{horizon}")).select(
        "service_id", F.greatest(F.lit(0.0), F.col("prediction")).alias("predicted_rpm"))
