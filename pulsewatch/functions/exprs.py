"""Pure Column functions (scalar expressions and predicates).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- time -----------------------------------------------------------------

def floor_time(ts, minutes: int) -> Column:
    """Start of the tumbling window of ``minutes`` containing ``ts`` (epoch aligned, UTC)."""
    step = int(minutes) * 60 * 1_000_000
    us = F.unix_micros(_c(ts))
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)))


def weekday(ts) -> Column:
    """Monday = 0 .. Sunday = 6."""
    return F.weekday(_c(ts))


def cyclical(ts) -> list[Column]:
    """hour_sin, hour_cos, dow_sin, dow_cos."""
    h = F.hour(_c(ts)).cast("double")
    d = weekday(ts).cast("double")
    two_pi = 2 * F.pi()
    return [
        F.sin(two_pi * h / 24.0).alias("hour_sin"),
        F.cos(two_pi * h / 24.0).alias("hour_cos"),
        F.sin(two_pi * d / 7.0).alias("dow_sin"),
        F.cos(two_pi * d / 7.0).alias("dow_cos"),
    ]


def iso_utc_seconds(ts) -> Column:
    """ISO-8601 UTC text of ``ts`` cut to seconds, seconds omitted when zero
    (the form ``OffsetDateTime.toString`` prints: ``2024-01-01T10:15Z``)."""
    t = F.date_trunc("second", _c(ts))
    return F.concat(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm"),
        F.when(F.second(t) == 0, F.lit("")).otherwise(F.date_format(t, ":ss")),
        F.lit("Z"),
    )


# ---- arithmetic -------------------------------------------------------------

def rate(num, den) -> Column:
    """num / den with a zero guard (C4)."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


def half_up_ratio(num, den, scale: int, precision: int) -> Column:
    """Exact decimal(precision, scale) of num/den for non-negative integers, HALF_UP.

    Integer arithmetic only, so the result equals a database NUMERIC cast.
    """
    p = 10 ** scale
    a = _c(num).cast("long") * (2 * p) + _c(den).cast("long")
    b = _c(den).cast("long") * 2
    q = ((a - F.pmod(a, b)).cast("decimal(38,0)") / b.cast("decimal(20,0)")).cast("decimal(20,0)")
    return (q * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({precision},{scale})")


def half_up_sql(num: str, den: str, scale: int, precision: int) -> str:
    """SQL text of ``half_up_ratio`` for column expressions given as SQL (one
    parse on the JVM instead of one call per operator)."""
    p = 10 ** scale
    a = f"(CAST({num} AS BIGINT) * {2 * p} + CAST({den} AS BIGINT))"
    b = f"(CAST({den} AS BIGINT) * 2)"
    q = f"CAST(CAST({a} - pmod({a}, {b}) AS DECIMAL(38,0)) / CAST({b} AS DECIMAL(20,0)) AS DECIMAL(20,0))"
    return f"CAST({q} * {Decimal(1).scaleb(-scale)}BD AS DECIMAL({precision},{scale}))"


def dec2(x) -> Column:
    """Round a double to 2 places then store as decimal(10,2)."""
    return F.round(_c(x), 2).cast("decimal(10,2)")


def clamp(c, lo=0.0, hi=1.0) -> Column:
    """Clamp to [lo, hi]."""
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


# ---- predicates -------------------------------------------------------------

def is_error(status) -> Column:
    """Status >= 400 is an error; a missing status counts as 0, a success."""
    return F.coalesce(_c(status), F.lit(0)) >= 400


def is_breach(p99="response_time_p99", err="error_rate",
              p99_ms: float = S.ALERT_P99_MS, error_rate: float = S.ALERT_ERROR_RATE) -> Column:
    """p99 > 2000 OR error rate > 0.10, strict; null reads as no breach."""
    return F.coalesce((_c(p99) > p99_ms) | (_c(err) > error_rate), F.lit(False))


def is_severe(p99="response_time_p99", err="error_rate") -> Column:
    """error rate > 0.20 AND p99 > 3500 (P5)."""
    return F.coalesce((_c(err) > S.SEVERE_ERROR_RATE) & (_c(p99) > S.SEVERE_P99_MS), F.lit(False))


def is_payment_or_auth(name) -> Column:
    """Service name contains one of the keywords, case-insensitive."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    out = F.lit(False)
    for k in S.PAYMENT_AUTH_KEYWORDS:
        out = out | n.contains(k)
    return out


# ---- labels -------------------------------------------------------------------

def escalate(level) -> Column:
    """One level up, capped at critical (C11)."""
    levels = F.array(*[F.lit(x) for x in S.LEVELS])
    pos = F.array_position(levels, _c(level))
    return F.element_at(levels, F.least(pos + 1, F.lit(len(S.LEVELS))).cast("int"))


def tier(c, bounds, floor_label: str) -> Column:
    """``bounds`` is ((cut, label), ...) in falling order; value >= cut gets label."""
    out = None
    for cut, label in bounds:
        out = F.when(_c(c) >= cut, F.lit(label)) if out is None else out.when(_c(c) >= cut, F.lit(label))
    return out.otherwise(F.lit(floor_label))


def health_status(score) -> Column:
    return tier(score, S.HEALTH_TIERS, S.HEALTH_TIER_FLOOR)


def risk_level(p, threshold=0.5) -> Column:
    """Risk buckets around a decision threshold t (K21):
    critical >= min(.95, t + (1-t)/2), high >= t, medium >= max(.05, .6 t), else low."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    critical = F.least(F.lit(0.95), t + (F.lit(1.0) - t) * 0.5)
    medium = F.greatest(F.lit(0.05), t * 0.6)
    pc = _c(p)
    return (F.when(pc >= critical, "critical").when(pc >= t, "high")
            .when(pc >= medium, "medium").otherwise("low"))


def one_hot(c, values) -> list[Column]:
    """``c == v`` as 0/1 int columns named ``<c>_<v>``."""
    name = c if isinstance(c, str) else "value"
    return [(_c(c) == F.lit(v)).cast("int").alias(f"{name}_{v}") for v in values]


def alert_message(trigger, p99, err, p99_ms: float = S.ALERT_P99_MS,
                  error_rate: float = S.ALERT_ERROR_RATE) -> Column:
    """Alert text (C9); java.util.Formatter rounding, as in the product."""
    return (F.when(_c(trigger) == "latency",
                   F.format_string(S.ALERT_MESSAGE_LATENCY,
                                   _c(p99).cast("double"), F.lit(float(p99_ms))))
            .when(_c(trigger) == "error_rate",
                  F.format_string(S.ALERT_MESSAGE_ERROR_RATE,
                                  _c(err).cast("double") * 100, F.lit(float(error_rate) * 100))))


def direction(delta) -> Column:
    """Forecast direction label from a delta."""
    d = _c(delta)
    return (F.when(d.isNull(), "none").when(d > 0, "up").when(d < 0, "down").otherwise("flat"))


def dedup_key(service_id, endpoint, ts, status, user_id) -> Column:
    """SHA-256 hex of service|endpoint|ts(UTC, seconds)|status|user."""
    return F.sha2(F.concat_ws(
        "|",
        F.coalesce(_c(service_id).cast("string"), F.lit("null")),
        F.coalesce(_c(endpoint), F.lit("")),
        iso_utc_seconds(ts),
        F.coalesce(_c(status), F.lit(0)).cast("string"),
        F.coalesce(_c(user_id), F.lit("")),
    ), 256)


UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def parse_uuid(c) -> Column:
    """Invalid UUID text -> null."""
    return F.when(_c(c).rlike(UUID_RE), F.lower(_c(c)))
