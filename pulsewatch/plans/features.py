"""Feature and label plans on hourly metrics (lags scaled to 1, 6, 24 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import features as FE
from ..operators import metrics as M
from . import sqlparts as Q
from .core import metrics_of
from .registry import plan

SIZE = "1h"
LAGS = (1, 6, 24)
ROLLING = 15
HORIZONS = (1, 2, 6, 24)          # 15/30/60/360 one-minute rows, scaled to hours
RUN, LOOKAHEAD = S.FAILURE_RUN, S.FAILURE_LOOKAHEAD
MIN_ROWS = max(LAGS) + ROLLING

R = 6   # decimals kept for doubles in outputs


def features(spark, sf_dir):
    return FE.build_features(metrics_of(spark, sf_dir, SIZE), lags=LAGS, rolling=ROLLING)


def rnd(*cols):
    """Round doubles to R places; negative zero is written as zero."""
    out = []
    for c in cols:
        r = F.round(c, R)
        out.append(F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c))
    return out


def srnd(c: str) -> str:
    return f"CASE WHEN round({c}, {R}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE round({c}, {R}) END AS {c}"


def features_sql(lags=LAGS, rolling=ROLLING) -> str:
    return f"""
feat AS (
  SELECT service_id, window_start,
         CAST(rpm AS DOUBLE) AS rpm,
         CAST(request_count AS DOUBLE) AS request_count,
         CAST(response_time_mean AS DOUBLE) AS response_time_mean,
         CAST(response_time_p95 AS DOUBLE) AS response_time_p95,
         CAST(response_time_p99 AS DOUBLE) AS response_time_p99,
         CAST(error_rate AS DOUBLE) AS error_rate,
         coalesce(CAST(cpu_usage_pct AS DOUBLE), 0.0) AS cpu_usage_pct,
         coalesce(CAST(memory_usage_pct AS DOUBLE), 0.0) AS memory_usage_pct,
         sin(2 * pi() * hour(window_start) / 24.0) AS hour_sin,
         cos(2 * pi() * hour(window_start) / 24.0) AS hour_cos,
         sin(2 * pi() * (isodow(window_start) - 1) / 7.0) AS dow_sin,
         cos(2 * pi() * (isodow(window_start) - 1) / 7.0) AS dow_cos,
         lag(CAST(rpm AS DOUBLE), {lags[0]}) OVER w AS rpm_lag_1h,
         lag(CAST(rpm AS DOUBLE), {lags[1]}) OVER w AS rpm_lag_6h,
         lag(CAST(rpm AS DOUBLE), {lags[2]}) OVER w AS rpm_lag_24h,
         avg(CAST(rpm AS DOUBLE)) OVER (w ROWS BETWEEN {rolling - 1} PRECEDING AND CURRENT ROW) AS rpm_rolling_15m
  FROM metrics
  WINDOW w AS (PARTITION BY service_id ORDER BY window_start)
)"""


FEATURES_SQL = features_sql()


@plan("cyclical_time", sql=f"""
{Q.with_metrics(SIZE)}, {FEATURES_SQL}
SELECT service_id, window_start, CAST(hour(window_start) AS INTEGER) AS hour_of_day,
       CAST(isodow(window_start) - 1 AS INTEGER) AS day_of_week,
       {srnd("hour_sin")}, {srnd("hour_cos")}, {srnd("dow_sin")}, {srnd("dow_cos")}
FROM feat""")
def cyclical_time(spark, sf_dir):
    """Hour and Monday=0 weekday with their sine/cosine encodings."""
    f = features(spark, sf_dir)
    return f.select("service_id", "window_start", F.hour("window_start").alias("hour_of_day"),
                    F.weekday("window_start").alias("day_of_week"),
                    *rnd("hour_sin", "hour_cos", "dow_sin", "dow_cos"))


@plan("lag_rolling_features", sql=f"""
{Q.with_metrics(SIZE)}, {FEATURES_SQL}
SELECT service_id, window_start, {", ".join(srnd(c) for c in S.FEATURE_COLUMNS)}
FROM feat""")
def lag_rolling_features(spark, sf_dir):
    """The 15-column feature frame in fixed order."""
    return features(spark, sf_dir).select("service_id", "window_start", *rnd(*S.FEATURE_COLUMNS))


@plan("features_1m_defaults", sql=f"""
{Q.with_metrics('1m')}, {features_sql(S.FEATURE_LAGS, S.FEATURE_ROLLING)},
tgt AS (SELECT service_id, window_start, count(*) OVER (PARTITION BY service_id) AS history_rows,
               {", ".join(f"lead(CAST(rpm AS DOUBLE), {h}) OVER w AS target_{h}" for h in S.TRAFFIC_HORIZONS)}
        FROM metrics WINDOW w AS (PARTITION BY service_id ORDER BY window_start))
SELECT f.service_id, f.window_start, {", ".join(srnd(c) for c in ("rpm_lag_1h", "rpm_lag_6h", "rpm_lag_24h", "rpm_rolling_15m"))},
       {", ".join(f"t.target_{h}" for h in S.TRAFFIC_HORIZONS)}, t.history_rows >= {S.FEATURE_MIN_ROWS} AS enough_history
FROM feat f JOIN tgt t ON f.service_id = t.service_id AND f.window_start = t.window_start""")
def features_1m_defaults(spark, sf_dir):
    """G2/G3/G4/G8 at the product's own settings: one-minute rows, lags 60, 360
    and 1,440, rolling 15, horizons 15 to 360, history of 1,455 rows."""
    f = FE.horizon_targets(FE.build_features(metrics_of(spark, sf_dir, "1m")))
    ready, rejected = FE.latest_features(f.select("service_id", "window_start", *S.FEATURE_COLUMNS))
    short = rejected.filter("reason = 'insufficient-history'").select("service_id", F.lit(False).alias("_enough"))
    return f.join(short, "service_id", "left").select(
        "service_id", "window_start", *rnd("rpm_lag_1h", "rpm_lag_6h", "rpm_lag_24h", "rpm_rolling_15m"),
        *[f"target_{h}" for h in S.TRAFFIC_HORIZONS], F.coalesce("_enough", F.lit(True)).alias("enough_history"))


@plan("horizon_targets", sql=f"""
{Q.with_metrics(SIZE)}
SELECT service_id, window_start,
       {", ".join(f"lead(CAST(rpm AS DOUBLE), {h}) OVER w AS target_{h}" for h in HORIZONS)}
FROM metrics WINDOW w AS (PARTITION BY service_id ORDER BY window_start)""")
def horizon_targets(spark, sf_dir):
    """Rpm 1/2/6/24 rows ahead per service."""
    t = FE.horizon_targets(features(spark, sf_dir), HORIZONS)
    return t.select("service_id", "window_start", *[f"target_{h}" for h in HORIZONS])


FAILURE_SQL = f"""
b AS (
  SELECT service_id, window_start,
         CAST(coalesce(CAST(response_time_p99 AS DOUBLE) > 2000 OR CAST(error_rate AS DOUBLE) > 0.10, false) AS INTEGER) AS bad
  FROM metrics
),
s AS (
  SELECT *, CAST(min(bad) OVER (w ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) = 1
                 AND count(*) OVER (w ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) = {RUN} AS INTEGER)
            AS streak_start
  FROM b WINDOW w AS (PARTITION BY service_id ORDER BY window_start)
),
lab AS (
  SELECT *, CAST(coalesce(max(streak_start) OVER (w ROWS BETWEEN 1 FOLLOWING AND {LOOKAHEAD} FOLLOWING), 0) AS INTEGER)
            AS failure_target
  FROM s WINDOW w AS (PARTITION BY service_id ORDER BY window_start)
)"""


@plan("failure_labels", sql=f"""
{Q.with_metrics(SIZE)}, {FAILURE_SQL}
SELECT service_id, window_start, streak_start, failure_target FROM lab""")
def failure_labels(spark, sf_dir):
    """5-row breach streak starts and the 15-row look-ahead label."""
    lab = FE.failure_labels(features(spark, sf_dir), RUN, LOOKAHEAD)
    return lab.select("service_id", "window_start", "streak_start", "failure_target")


@plan("chrono_split_counts", sql=f"""
{Q.with_metrics(SIZE)},
per_ts AS (SELECT window_start, count(*) AS n FROM metrics GROUP BY window_start),
cum AS (SELECT *, coalesce(sum(n) OVER (ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
               sum(n) OVER () AS total FROM per_ts),
cut AS (SELECT min(window_start) AS cut_ts FROM cum WHERE before + n > floor(total * 0.8))
SELECT (SELECT cut_ts FROM cut) AS cut_ts,
       CAST(sum(CASE WHEN window_start < (SELECT cut_ts FROM cut) THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
       CAST(sum(CASE WHEN window_start >= (SELECT cut_ts FROM cut) THEN 1 ELSE 0 END) AS BIGINT) AS test_rows
FROM metrics""")
def chrono_split_counts(spark, sf_dir):
    """Chronological 80/20 split cut on a timestamp boundary."""
    m = metrics_of(spark, sf_dir, SIZE)
    train, test = FE.chrono_split(m)
    cut = FE.chrono_cut(m).select("cut_ts")
    return cut.crossJoin(train.agg(F.count(F.lit(1)).alias("train_rows"))) \
        .crossJoin(test.agg(F.count(F.lit(1)).alias("test_rows")))


@plan("metrics_gap_filled", sql=f"""
{Q.with_metrics(SIZE)},
spans AS (SELECT service_id, min(window_start) AS lo, max(window_start) AS hi FROM metrics GROUP BY service_id),
grid AS (SELECT service_id, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS window_start FROM spans)
SELECT g.service_id, g.window_start, coalesce(m.request_count, 0) AS request_count,
       coalesce(m.rpm, CAST(0 AS DECIMAL(10,2))) AS rpm, m.response_time_p99,
       m.request_count IS NULL AS is_gap
FROM grid g LEFT JOIN metrics m ON g.service_id = m.service_id AND g.window_start = m.window_start""")
def metrics_gap_filled(spark, sf_dir):
    """optional zero rows for silent windows between a service's first and last."""
    g = M.fill_gaps(metrics_of(spark, sf_dir, SIZE), SIZE)
    return g.select("service_id", "window_start", "request_count", "rpm", "response_time_p99", "is_gap")


@plan("latest_feature_rows", sql=f"""
{Q.with_metrics(SIZE)}, {FEATURES_SQL},
ranked AS (SELECT *, count(*) OVER (PARTITION BY service_id) AS history_rows,
                  row_number() OVER (PARTITION BY service_id ORDER BY window_start DESC) AS rn FROM feat)
SELECT service_id, window_start, CAST(history_rows AS BIGINT) AS history_rows,
       {", ".join(srnd(c) for c in S.FEATURE_COLUMNS)}
FROM ranked WHERE rn = 1 AND history_rows >= {MIN_ROWS}
  AND {" AND ".join(f"{c} IS NOT NULL" for c in S.FEATURE_COLUMNS)}""")
def latest_feature_rows(spark, sf_dir):
    """Inference row per service (last features, history gate)."""
    ready, _ = FE.latest_features(features(spark, sf_dir), min_rows=MIN_ROWS)
    return ready.select("service_id", "window_start", "history_rows", *rnd(*S.FEATURE_COLUMNS))
