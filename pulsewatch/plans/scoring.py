"""Heuristic scoring and evaluation plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..ml import evaluate as EV
from ..ml import heuristics as H
from ..operators import alerts as AL
from ..operators import features as FE
from ..operators import metrics as M
from . import sqlparts as Q
from .alerting import CANDIDATES_SQL, FREQ_SQL, LABEL_SQL, candidates
from .core import metrics_of
from .features import FAILURE_SQL, HORIZONS, LOOKAHEAD, RUN, SIZE
from .registry import plan
from ..session import cut_lineage

GRID = EV.threshold_grid()


ANOM = "least(1.0, greatest(CAST(response_time_p99 AS DOUBLE) / 5000.0, CAST(error_rate AS DOUBLE)))"


@plan("heuristic_anomaly", sql=f"""
{Q.with_metrics(SIZE)}
SELECT service_id, window_start, round({ANOM}, 6) AS anomaly_score,
       {ANOM} >= {1.0 - S.ANOMALY_CONTAMINATION_DEFAULT} AS is_anomaly
FROM metrics""")
def heuristic_anomaly(spark, sf_dir):
    """Heuristic anomaly score and flag for every hourly row."""
    a = H.heuristic_anomaly(metrics_of(spark, sf_dir, SIZE))
    return a.select("service_id", "window_start", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


RISK = """CASE WHEN {p} >= least(0.95, {t} + (1 - {t}) * 0.5) THEN 'critical'
            WHEN {p} >= {t} THEN 'high'
            WHEN {p} >= greatest(0.05, {t} * 0.6) THEN 'medium' ELSE 'low' END"""


@plan("heuristic_failure", sql=f"""
{Q.with_metrics(SIZE)},
last AS (SELECT * FROM metrics
         QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) <= {S.FAILURE_RECENT_ROWS}),
agg AS (SELECT service_id, avg(CAST(error_rate AS DOUBLE)) AS e,
               avg(CASE WHEN CAST(response_time_p99 AS DOUBLE) > 2000 THEN 1.0 ELSE 0.0 END) AS b,
               count(*) AS history_rows
        FROM last GROUP BY service_id)
SELECT service_id, CAST(history_rows AS BIGINT) AS history_rows,
       round(least(1.0, 0.5 * e + 0.5 * b), 6) AS failure_probability,
       {RISK.format(p="least(1.0, 0.5 * e + 0.5 * b)", t="0.5")} AS risk_level
FROM agg""")
def heuristic_failure(spark, sf_dir):
    """Heuristic failure probability over each service's last 30 rows."""
    f = H.heuristic_failure(metrics_of(spark, sf_dir, SIZE))
    return f.select("service_id", "history_rows", F.round("failure_probability", 6).alias("failure_probability"),
                    "risk_level")


@plan("naive_forecast", sql=f"""
{Q.with_metrics(SIZE)}
SELECT service_id, window_start, greatest(0.0, CAST(request_count AS DOUBLE)) AS predicted_rpm
FROM metrics
QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) = 1""")
def naive_forecast(spark, sf_dir):
    """Last observed request count as the forecast."""
    n = H.naive_forecast(M.latest_per_service(metrics_of(spark, sf_dir, SIZE), window_size=SIZE))
    return n.select("service_id", "window_start", "predicted_rpm")


ROLL_SQL = f"""
roll AS (
  SELECT service_id, window_start,
         round(least(1.0, 0.5 * avg(CAST(error_rate AS DOUBLE)) OVER w
                         + 0.5 * avg(CASE WHEN CAST(response_time_p99 AS DOUBLE) > 2000 THEN 1.0 ELSE 0.0 END) OVER w), 9)
           AS p
  FROM metrics
  WINDOW w AS (PARTITION BY service_id ORDER BY window_start ROWS BETWEEN {S.FAILURE_RECENT_ROWS - 1} PRECEDING AND CURRENT ROW)
),
scored AS (
  SELECT r.service_id, r.window_start, r.p, l.failure_target AS y
  FROM roll r JOIN lab l ON r.service_id = l.service_id AND r.window_start = l.window_start
)"""


def scored(spark, sf_dir):
    """Rolling failure heuristic (30 rows back) next to the failure label
    (5-row streaks, 15 rows ahead): one chunked sequence serves both frames."""
    from ..functions import exprs as X
    from ..operators import sequence as SQ
    m = FE.as_numeric(metrics_of(spark, sf_dir, SIZE))
    back = S.FAILURE_RECENT_ROWS
    seq = SQ.sequenced(m.withColumn("_bad", X.is_breach().cast("int")),
                       before=back - 1, after=RUN - 1 + LOOKAHEAD)
    w = SQ.halo_window()
    roll = w.rowsBetween(-(back - 1), 0)
    ahead = w.rowsBetween(0, RUN - 1)
    p = F.least(F.lit(1.0), 0.5 * F.avg("error_rate").over(roll)
                + 0.5 * F.avg((F.col("response_time_p99") > S.ALERT_P99_MS).cast("double")).over(roll))
    s = seq.withColumn("p", F.round(p, 9)).withColumn(
        "_start", ((F.min("_bad").over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == RUN)).cast("int"))
    s = s.withColumn("y", F.coalesce(F.max("_start").over(w.rowsBetween(1, LOOKAHEAD)), F.lit(0)).cast("int"))
    # metric-sized (one row per service window) and read by several branches:
    # materialise once in the shared checkpoint folder
    return cut_lineage(SQ.finish(s).select("service_id", "window_start", "p", "y"))


@plan("risk_levels", sql=f"""
{Q.with_metrics(SIZE)}, {FAILURE_SQL}, {ROLL_SQL}
SELECT service_id, window_start, p AS failure_probability,
       {RISK.format(p="p", t="0.5")} AS risk_t50,
       {RISK.format(p="p", t="0.95")} AS risk_t95
FROM scored""")
def risk_levels(spark, sf_dir):
    """Risk tiers of the rolling heuristic at thresholds 0.5 and 0.95."""
    from ..functions import exprs as X
    s = scored(spark, sf_dir)
    return s.select("service_id", "window_start", F.col("p").alias("failure_probability"),
                    X.risk_level(F.col("p"), 0.5).alias("risk_t50"),
                    X.risk_level(F.col("p"), 0.95).alias("risk_t95"))


GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(GRID)) + ") AS g(i, threshold))"

SWEEP_SQL = f"""
{GRID_SQL},
cnt AS (
  SELECT g.i, g.threshold,
         sum(CASE WHEN s.p >= g.threshold AND s.y = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN s.p >= g.threshold AND s.y = 0 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN s.p < g.threshold AND s.y = 1 THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN s.p < g.threshold AND s.y = 0 THEN 1 ELSE 0 END) AS tn
  FROM grid g CROSS JOIN scored s GROUP BY g.i, g.threshold
),
pr AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
  FROM cnt
),
fb AS (
  SELECT *, CASE WHEN precision + recall > 0
                 THEN (1 + 2.25) * precision * recall / (2.25 * precision + recall) ELSE 0.0 END AS fbeta
  FROM pr
),
best AS (SELECT i FROM fb WHERE tp + fp > 0 ORDER BY fbeta DESC, i LIMIT 1)"""


@plan("threshold_sweep", sql=f"""
{Q.with_metrics(SIZE)}, {FAILURE_SQL}, {ROLL_SQL}, {SWEEP_SQL}
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       CAST(tn AS BIGINT) AS tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(fbeta, 6) AS fbeta, i IN (SELECT i FROM best) AS is_best
FROM fb""")
def threshold_sweep(spark, sf_dir):
    """K6: 12 thresholds 0.05..0.6, F1.5 of the rolling failure heuristic vs labels."""
    sw = EV.threshold_sweep(scored(spark, sf_dir), "y", "p", grid=GRID)
    return sw.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fbeta")],
                     "is_best")


@plan("classification_report", sql=f"""
{Q.with_metrics(SIZE)}, {FAILURE_SQL}, {ROLL_SQL}, {SWEEP_SQL},
thr AS (SELECT coalesce(max(threshold), 0.5) AS threshold FROM fb WHERE i IN (SELECT i FROM best)),
c AS (
  SELECT sum(CASE WHEN p >= t.threshold AND y = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN p >= t.threshold AND y = 0 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN p < t.threshold AND y = 1 THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN p < t.threshold AND y = 0 THEN 1 ELSE 0 END) AS tn
  FROM scored CROSS JOIN thr t
)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM c""")
def classification_report(spark, sf_dir):
    """K7: precision / recall / F1 at the swept threshold."""
    s = scored(spark, sf_dir)
    best = EV.best_threshold(EV.threshold_sweep(s, "y", "p", grid=GRID)).select(F.col("threshold").alias("_t"))
    pred = s.crossJoin(F.broadcast(best)).withColumn("yhat", (F.col("p") >= F.col("_t")).cast("int"))  # one-row side
    r = EV.classification_report(pred, "y", "yhat")
    return r.select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")],
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@plan("rank_auc", sql=f"""
{Q.with_metrics(SIZE)}, {FAILURE_SQL}, {ROLL_SQL},
rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM scored),
t AS (SELECT sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS sr, sum(y) AS P, sum(1 - y) AS N FROM rk)
SELECT round((sr - P * (P + 1) / 2.0) / (P * N), 9) AS roc_auc, CAST(P AS BIGINT) AS positives,
       CAST(N AS BIGINT) AS negatives
FROM t""")
def rank_auc(spark, sf_dir):
    """K7: exact ROC-AUC of the rolling failure heuristic (ties count one half)."""
    a = EV.rank_auc(scored(spark, sf_dir), "y", "p")
    return a.select(F.round("roc_auc", 9).alias("roc_auc"), "positives", "negatives")


@plan("forecast_error", sql=f"""
{Q.with_metrics(SIZE)},
t AS (
  SELECT service_id, window_start, CAST(rpm AS DOUBLE) AS yhat,
         {", ".join(f"lead(CAST(rpm AS DOUBLE), {h}) OVER w AS target_{h}" for h in HORIZONS)}
  FROM metrics WINDOW w AS (PARTITION BY service_id ORDER BY window_start)
),
u AS ({" UNION ALL ".join(f"SELECT {h} AS horizon, yhat, target_{h} AS y FROM t WHERE target_{h} IS NOT NULL" for h in HORIZONS)})
SELECT horizon, count(*) AS n, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse,
       round(avg(abs(yhat - y) / greatest(abs(y), {EV.EPS!r})), 6) AS mape
FROM u GROUP BY horizon""")
def forecast_error(spark, sf_dir):
    """K4: RMSE / MAPE of the naive forecast against the 1/2/6/24-row targets."""
    f = FE.horizon_targets(FE.as_numeric(metrics_of(spark, sf_dir, SIZE)), HORIZONS)
    long = f.select("rpm", F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("y")) for h in HORIZONS])))
    long = long.filter(F.col("y").isNotNull())
    r = EV.regression_report(long, "y", "rpm", by=["horizon"])
    return r.select("horizon", "n", F.round("rmse", 6).alias("rmse"), F.round("mape", 6).alias("mape"))


@plan("confusion_macro", sql=f"""
{Q.with_metrics(SIZE)}, {Q.SERVICES}, {CANDIDATES_SQL}, {FREQ_SQL}, {LABEL_SQL},
yy AS (SELECT priority AS y, CASE WHEN triggering_metric = 'availability' THEN 'high' ELSE 'low' END AS yhat FROM prio),
cls AS (SELECT * FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) AS c(cls)),
per AS (
  SELECT cls, sum(CASE WHEN y = cls AND yhat = cls THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN yhat = cls THEN 1 ELSE 0 END) AS predicted,
         sum(CASE WHEN y = cls THEN 1 ELSE 0 END) AS support
  FROM cls CROSS JOIN yy GROUP BY cls
),
m AS (
  SELECT cls, tp, predicted, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM per
),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT cls, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted, CAST(support AS BIGINT) AS support,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(NULL AS DOUBLE) AS accuracy
FROM f
UNION ALL
SELECT 'macro', NULL, NULL, CAST(sum(support) AS BIGINT), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       round((SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) FROM yy), 6)
FROM f WHERE predicted + support > 0""")
def confusion_macro(spark, sf_dir):
    """Macro report of the dashboard's placeholder-context priority against the label."""
    lab = AL.label_priority(AL.alert_frequency(candidates(spark, sf_dir)))
    yy = lab.select(F.col("priority").alias("y"),
                    F.when(F.col("triggering_metric") == "availability", "high").otherwise("low").alias("yhat"))
    r = EV.macro_report(yy, "y", "yhat")
    return r.select("cls", "tp", "predicted", "support",
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])
