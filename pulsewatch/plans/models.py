"""Model plans: training at the product's settings, and scoring from the store.

What a fit decides (errors, scores) SQL cannot state; the plans return what it
can: rows per split and horizon, class counts, weights, and which services the
stored model or the heuristic answers for.  A module is trained once per
application and table folder, whichever plan asks first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..ml import jobs as MJ
from ..operators import alerts as AL
from ..operators import features as FE
from ..operators import views as V
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as FX
from ..sources import io as IO
from . import sqlparts as Q
from .alerting import CANDIDATES_SQL, FREQ_SQL, LABEL_SQL
from .core import metrics_of
from .dashboards import _episodes_sql
from .features import FAILURE_SQL, FEATURES_SQL, HORIZONS, LAGS, MIN_ROWS, ROLLING, SIZE
from .registry import plan

_hourly: dict[tuple[str, str], DataFrame] = {}


def hourly(spark, sf_dir):
    """The metric rows, materialised: training and scoring read them many times,
    the raw logs are read for them once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _hourly:
        _hourly[key] = cut_lineage(metrics_of(spark, sf_dir, SIZE))
    return _hourly[key]


def features_of(m):
    return cut_lineage(FE.build_features(m, lags=LAGS, rolling=ROLLING))


_stores: dict[tuple[str, str], tuple[str, set[str]]] = {}


def trained(spark, sf_dir, *modules: str) -> str:
    """The store of this application and folder, with ``modules`` trained."""
    key = (spark.sparkContext.applicationId, sf_dir)
    store, done = _stores.setdefault(key, (scratch_path(spark, f"models-{uuid.uuid4().hex}"), set()))
    missing = [m for m in modules if m not in done]
    if missing:
        ev = FX.read_table(spark, sf_dir, "events")
        m = hourly(spark, sf_dir)
        labels = V.label_episodes(m, FX.anomaly_episodes(ev), FX.failure_episodes(ev), window_size=SIZE)
        runs = MJ.train(spark, m, store, modules=missing, days=None, window_size=SIZE, lags=LAGS, rolling=ROLLING, horizons=HORIZONS,
                        labels=labels.select("service_id", "window_start", "is_anomaly"), services=FX.services(spark))
        runs.write.mode("append").parquet(f"{store}/runs")
        done.update(missing)
    return store


def cut_sql(rows: str) -> str:
    """The chronological 80/20 cut of a relation, as relation ``cut``."""
    return f"""
per_ts AS (SELECT window_start, count(*) AS n FROM {rows} GROUP BY window_start),
cum AS (SELECT *, coalesce(sum(n) OVER (ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(n) OVER () AS total FROM per_ts),
cut AS (SELECT min(window_start) AS cut_at FROM cum WHERE before + n > floor(total * 0.8))"""


COMPLETE = " AND ".join(f"f.{c} IS NOT NULL" for c in S.FEATURE_COLUMNS)


@plan("traffic_gbt", sql=f"""
{Q.with_metrics(SIZE)}, {FEATURES_SQL},
tgt AS (SELECT service_id, window_start, {", ".join(f"lead(CAST(rpm AS DOUBLE), {h}) OVER w AS target_{h}" for h in HORIZONS)}
        FROM metrics WINDOW w AS (PARTITION BY service_id ORDER BY window_start)),
usable AS (SELECT f.window_start, {', '.join(f't.target_{h}' for h in HORIZONS)} FROM feat f JOIN tgt t ON f.service_id = t.service_id AND f.window_start = t.window_start
           WHERE {COMPLETE} AND {" AND ".join(f"t.target_{h} IS NOT NULL" for h in HORIZONS)}),
{cut_sql("usable")}
{" UNION ALL ".join(f"""
SELECT {h} AS horizon, count(*) FILTER (WHERE window_start >= cut_at) AS test_rows, count(*) FILTER (WHERE window_start < cut_at) AS training_rows,
       round(avg(target_{h}) FILTER (WHERE window_start < cut_at), 6) AS train_mean FROM usable, cut""" for h in HORIZONS)}""")
def traffic_gbt(spark, sf_dir):
    """A boosted regressor per horizon (300 trees, depth 6), stored
    with its test errors; rows per split and the mean each one starts from."""
    meta = MJ.load_meta(spark, trained(spark, sf_dir, "traffic"), "traffic")
    got = meta["metrics"]
    rows = [(h, int(got[f"n_h{h}"]), meta["training_rows"], round(got[f"train_mean_h{h}"], 6)) for h in HORIZONS]
    return spark.createDataFrame(rows, "horizon int, test_rows long, training_rows long, train_mean double")


@plan("failure_gbt", sql=f"""
{Q.with_metrics(SIZE)}, {FEATURES_SQL}, {FAILURE_SQL},
usable AS (SELECT f.window_start, l.failure_target AS y FROM feat f JOIN lab l ON f.service_id = l.service_id AND f.window_start = l.window_start
           WHERE {COMPLETE}),
{cut_sql("usable")},
c AS (SELECT sum(CASE WHEN window_start < cut_at THEN 1 ELSE 0 END) AS training_rows,
             sum(CASE WHEN window_start < cut_at THEN y ELSE 0 END) AS train_pos,
             sum(CASE WHEN window_start >= cut_at THEN y ELSE 0 END) AS positives,
             sum(CASE WHEN window_start >= cut_at THEN 1 - y ELSE 0 END) AS negatives FROM usable, cut)
SELECT CAST(training_rows AS BIGINT) AS training_rows, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives,
       round(sqrt(greatest(1, training_rows - greatest(1, train_pos)) / greatest(1, train_pos)), 6) AS scale_pos_weight,
       positives > 0 AND negatives > 0 AS auc_defined
FROM c""")
def failure_gbt(spark, sf_dir):
    """K5/K6/K7: weighted boosted classifier (800 trees, depth 8); class counts of its test report."""
    meta = MJ.load_meta(spark, trained(spark, sf_dir, "failure"), "failure")
    m = {k: meta["metrics"].get(k) for k in ("tp", "fp", "fn", "tn", "scale_pos_weight", "roc_auc")}
    rows = [(meta["training_rows"], int(m["tp"] + m["fn"]), int(m["fp"] + m["tn"]), round(m["scale_pos_weight"], 6), m["roc_auc"] is not None)]
    return spark.createDataFrame(rows, "training_rows long, positives long, negatives long, scale_pos_weight double, auc_defined boolean")


@plan("anomaly_iforest", sql=f"""
{Q.with_metrics(SIZE)}, {FEATURES_SQL}, {_episodes_sql('hour')},
usable AS (SELECT f.service_id, am.mult IS NOT NULL AS y FROM feat f
           LEFT JOIN am ON f.service_id = am.service_id AND f.window_start = am.window_start WHERE {COMPLETE})
SELECT contamination, (SELECT count(*) FROM usable WHERE y) AS positives,
       (SELECT count(*) - 1 - CAST(floor((1.0 - contamination) * (count(*) - 1)) AS BIGINT) FROM usable) AS flagged
FROM (VALUES {", ".join(f"(CAST({c!r} AS DOUBLE))" for c in S.CONTAMINATION_GRID)}) AS t(contamination)""")
def anomaly_iforest(spark, sf_dir):
    """Isolation forest (200 trees), contamination sweep against
    episode labels; each cut-off flags the rows above its quantile."""
    store = trained(spark, sf_dir, "anomaly")
    sweep = spark.read.parquet(f"{MJ.version_path(store, 'anomaly', MJ.active_version(spark, store, 'anomaly'))}/sweep")
    return sweep.select("contamination", (F.col("tp") + F.col("fn")).cast("long").alias("positives"), (F.col("tp") + F.col("fp")).cast("long").alias("flagged"))


@plan("priority_forest", sql=f"""
{Q.with_metrics(SIZE)}, {Q.SERVICES}, {CANDIDATES_SQL}, {FREQ_SQL}, {LABEL_SQL}, {cut_sql("prio")},
test AS (SELECT priority FROM prio, cut WHERE window_start >= cut_at)
SELECT cls, (SELECT count(*) FROM test WHERE priority = cls) AS support, (SELECT count(*) FROM prio, cut WHERE window_start < cut_at) AS training_rows
FROM (VALUES {", ".join(f"('{c}')" for c in S.LEVELS)}) AS t(cls)
UNION ALL SELECT 'macro', (SELECT count(*) FROM test), (SELECT count(*) FROM prio, cut WHERE window_start < cut_at)""")
def priority_forest(spark, sf_dir):
    """Balanced random forest (200 trees, depth 12) over alert contexts; class support of its test report."""
    store = trained(spark, sf_dir, "alerts")
    meta = MJ.load_meta(spark, store, "alerts")
    report = spark.read.parquet(f"{MJ.version_path(store, 'alerts', meta['model_version'])}/report")
    return report.select("cls", "support", F.lit(meta["training_rows"]).cast("long").alias("training_rows"))


@plan("model_list", sql=f"""
{Q.with_metrics(SIZE)}, {Q.SERVICES}, {FEATURES_SQL}, {CANDIDATES_SQL}, {FREQ_SQL}, {LABEL_SQL},
tgt AS (SELECT service_id, window_start, {", ".join(f"lead(CAST(rpm AS DOUBLE), {h}) OVER w AS target_{h}" for h in HORIZONS)}
        FROM metrics WINDOW w AS (PARTITION BY service_id ORDER BY window_start)),
rows_of AS (
  SELECT 'anomaly' AS module, f.window_start FROM feat f WHERE {COMPLETE}
  UNION ALL SELECT 'failure', f.window_start FROM feat f WHERE {COMPLETE}
  UNION ALL SELECT 'traffic', f.window_start FROM feat f JOIN tgt t ON f.service_id = t.service_id AND f.window_start = t.window_start
    WHERE {COMPLETE} AND {" AND ".join(f"t.target_{h} IS NOT NULL" for h in HORIZONS)}
  UNION ALL SELECT 'alerts', window_start FROM prio),
per_ts AS (SELECT module, window_start, count(*) AS n FROM rows_of GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY module ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(n) OVER (PARTITION BY module) AS total FROM per_ts),
cuts AS (SELECT module, min(window_start) AS cut_at FROM cum WHERE before + n > floor(total * 0.8) GROUP BY module)
SELECT module, algorithm, (SELECT CAST(count(*) AS INTEGER) FROM rows_of r JOIN cuts c USING (module)
                           WHERE r.module = t.module AND (r.module = 'anomaly' OR window_start < cut_at)) AS training_rows,
       module || '-run' AS active_run
FROM (VALUES ('traffic', 'HistogramBoosting per horizon'), ('failure', 'HistogramBoosting'),
  ('anomaly', 'IsolationForest'), ('alerts', 'RandomForestClassifier')) AS t(module, algorithm)
WHERE (SELECT count(*) FROM events) > 0""")
def model_list(spark, sf_dir):
    """The active models with their training rows, each joined to its active run row."""
    store = trained(spark, sf_dir, *MJ.MODULES)
    runs = spark.read.parquet(f"{store}/runs").where("is_active").select("module", "model_version", F.concat("module", F.lit("-run")).alias("active_run"))
    return MJ.list_models(spark, store).join(runs, ["module", "model_version"]).select("module", "algorithm", "training_rows", "active_run")


@plan("model_rollback", sql=f"""
{Q.with_metrics(SIZE)}, {FEATURES_SQL},
ranked AS (SELECT f.*, count(*) OVER (PARTITION BY service_id) AS history_rows,
                  row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) AS rn FROM feat f),
ready AS (SELECT f.service_id FROM ranked f WHERE rn = 1 AND history_rows >= {MIN_ROWS} AND {COMPLETE}),
svc AS (SELECT DISTINCT service_id FROM metrics)
SELECT step, service_id, CASE WHEN service_id IN (SELECT service_id FROM ready) THEN used ELSE 0 END AS version_used
FROM svc, (VALUES ('first trained', 1), ('second trained', 2), ('rolled back', 1)) AS t(step, used)""")
def model_rollback(spark, sf_dir):
    """Train the failure model twice, go back to the first version; which
    version answers for each service at each step (0: the heuristic)."""
    store = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    m = hourly(spark, sf_dir)
    f = features_of(m)
    out, names = None, []

    def answers(step):
        rows = MJ.score(spark, "failure", m, store, f, SIZE, MIN_ROWS)
        number = F.coalesce(*[F.when(F.col("model_version") == n, i) for i, n in enumerate(names, 1)], F.lit(0))
        path = f"{store}/answers-{step.replace(' ', '-')}"
        rows.select(F.lit(step).alias("step"), "service_id", number.cast("int").alias("version_used")).write.parquet(path)
        return spark.read.parquet(path)

    for step, trees in (("first trained", 20), ("second trained", 30)):
        run = MJ.train(spark, m, store, modules=["failure"], days=None, window_size=SIZE, lags=LAGS, rolling=ROLLING, horizons=HORIZONS,
                       params={"failure": {"max_iter": trees, "max_depth": 4}})
        names.append(run.first()["model_version"])
        out = answers(step) if out is None else out.unionByName(answers(step))
    MJ.activate(spark, store, "failure", names[0])
    return out.unionByName(answers("rolled back"))


@plan("score_models", sql=f"""
{Q.with_metrics(SIZE)}, {Q.SERVICES}, {FEATURES_SQL}, {CANDIDATES_SQL},
ranked AS (SELECT f.*, count(*) OVER (PARTITION BY service_id) AS history_rows,
                  row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) AS rn FROM feat f),
ready AS (SELECT f.service_id FROM ranked f WHERE rn = 1 AND history_rows >= {MIN_ROWS} AND {COMPLETE}),
svc AS (SELECT DISTINCT service_id FROM metrics),
routes AS (
  SELECT service_id, 'traffic' AS module, horizon_minutes, 'model' AS route FROM ready, (VALUES {", ".join(f"({h})" for h in HORIZONS)}) AS t(horizon_minutes)
  UNION ALL SELECT service_id, 'failure', 30, 'model' FROM ready
  UNION ALL SELECT service_id, 'anomaly', NULL, 'model' FROM ready
  UNION ALL SELECT service_id, 'traffic', 60, 'heuristic' FROM svc WHERE service_id NOT IN (SELECT service_id FROM ready)
  UNION ALL SELECT service_id, 'failure', 30, 'heuristic' FROM svc WHERE service_id NOT IN (SELECT service_id FROM ready)
  UNION ALL SELECT service_id, 'anomaly', NULL, 'heuristic' FROM svc WHERE service_id NOT IN (SELECT service_id FROM ready)
  UNION ALL SELECT service_id, 'health', NULL, 'heuristic' FROM svc
  UNION ALL SELECT service_id, 'alerts', NULL, 'model' FROM ctx)
SELECT service_id, module, CAST(horizon_minutes AS INTEGER) AS horizon_minutes, route, module = 'alerts' AS has_confidence, count(*) AS n
FROM routes GROUP BY ALL""")
def score_models(spark, sf_dir):
    """Reload every stored model and score every service and
    alert context with it, the heuristic answering for services without a
    complete row; predictions are appended and read back."""
    store = trained(spark, sf_dir, *MJ.MODULES)
    m = hourly(spark, sf_dir)
    f = features_of(m)
    contexts = cut_lineage(AL.label_priority(AL.alert_frequency(AL.alert_candidates(m, FX.services(spark)))))
    out = scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    for module in ("health", *MJ.MODULES):
        IO.write_predictions(MJ.score(spark, module, m, store, f, SIZE, MIN_ROWS, contexts=contexts), out)
    p = spark.read.parquet(out).where(F.get_json_object("value", "$.service_id") == F.col("service_id"))
    route = F.when(F.col("model_version") == S.HEURISTIC_MODEL_VERSION, "heuristic").otherwise("model")
    return p.groupBy("service_id", "module", "horizon_minutes", route.alias("route"), F.col("confidence").isNotNull().alias("has_confidence")) \
        .agg(F.count(F.lit(1)).alias("n"))
