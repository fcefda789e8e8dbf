"""Declared constraints of the stored tables (B2, M5).

One table of rules with SQL's three-valued logic: a check that is unknown
(null) passes, as in a CHECK clause; whether null itself is allowed is a rule of
its own.  Validators, ingest rejects and counts are all made from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


@dataclass(frozen=True)
class Rule:
    """``kind`` of limit on ``column``: present, not_blank, one_of (values),
    at_least (least), above (bound), between (least, most), longest (characters)
    or not_before (other column)."""

    name: str
    column: str
    kind: str
    limit: tuple = ()

    def violated(self) -> Column:
        """True where a row breaks the rule, else false; never null."""
        c = F.col(self.column)
        if self.kind == "present":
            return c.isNull()
        if self.kind == "not_blank":
            return c.isNull() | ~c.rlike(r"\S")
        ok = {"one_of": lambda: c.isin(*self.limit), "at_least": lambda: c >= self.limit[0], "above": lambda: c > self.limit[0],
              "between": lambda: c.between(*self.limit), "longest": lambda: F.length(c) <= self.limit[0],
              "not_before": lambda: c >= F.col(self.limit[0])}[self.kind]()
        return F.coalesce(~ok, F.lit(False))


def _present(*columns: str) -> tuple[Rule, ...]:
    return tuple(Rule(f"{c}_present", c, "present") for c in columns)


API_LOGS = (
    *_present("service_id", "endpoint", "http_method", "status_code", "response_time_ms", "request_timestamp"),
    Rule("endpoint_length", "endpoint", "longest", (512,)),
    Rule("http_method_valid", "http_method", "one_of", S.HTTP_METHODS),
    Rule("response_time_nonneg", "response_time_ms", "at_least", (0,)),
    Rule("user_agent_length", "user_agent", "longest", (512,)),
)
METRICS = (
    *_present("service_id", "window_start", "window_end", "window_size", "request_count"),
    Rule("window_size_valid", "window_size", "one_of", S.WINDOW_SIZES),
    Rule("request_count_nonneg", "request_count", "at_least", (0,)),
    Rule("error_rate_unit", "error_rate", "between", (0, 1)),
    Rule("success_rate_unit", "success_rate", "between", (0, 1)),
    Rule("cpu_pct_range", "cpu_usage_pct", "between", (0, 100)),
    Rule("memory_pct_range", "memory_usage_pct", "between", (0, 100)),
)
ALERTS = (
    *_present("service_id", "triggering_metric", "severity", "message", "opened_at"),
    Rule("trigger_valid", "triggering_metric", "one_of", S.TRIGGERS),
    Rule("severity_valid", "severity", "one_of", S.LEVELS),
    Rule("priority_valid", "priority", "one_of", S.LEVELS),
    Rule("closed_after_opened", "closed_at", "not_before", ("opened_at",)),
)
PREDICTIONS = (
    *_present("service_id", "module", "model_version", "generated_at", "value"),
    Rule("module_valid", "module", "one_of", S.MODULES),
    Rule("model_version_length", "model_version", "longest", (64,)),
    Rule("horizon_positive", "horizon_minutes", "above", (0,)),
    Rule("confidence_unit", "confidence", "between", (0, 1)),
)
MODEL_RUNS = (
    *_present("module", "model_version", "algorithm", "trained_at", "is_active"),
    Rule("module_valid", "module", "one_of", S.MODULES),
    Rule("model_version_length", "model_version", "longest", (64,)),
    Rule("algorithm_length", "algorithm", "longest", (64,)),
    Rule("artifact_path_length", "artifact_path", "longest", (512,)),
)
SERVICES = (
    Rule("name_present", "name", "not_blank"),
    Rule("name_length", "name", "longest", (100,)),
    Rule("base_url_present", "base_url", "not_blank"),
    Rule("base_url_length", "base_url", "longest", (512,)),
    Rule("owner_length", "owner", "longest", (128,)),
    Rule("description_length", "description", "longest", (500,)),
    Rule("environment_present", "environment", "not_blank"),
    Rule("environment_valid", "environment", "one_of", S.ENVIRONMENTS),
)
#: A patch may leave any field out, so nothing has to be present.
SERVICE_PATCHES = tuple(r for r in SERVICES if r.kind != "not_blank")

TABLES = {"api_logs": API_LOGS, "metrics": METRICS, "alerts": ALERTS, "predictions": PREDICTIONS, "model_runs": MODEL_RUNS, "services": SERVICES}


def failed_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a row breaks, in declared order."""
    return F.filter(F.array(*[F.when(r.violated(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def violations(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows that break a rule, with ``failed_rules``."""
    return df.withColumn("failed_rules", failed_rules(rules)).filter(F.size("failed_rules") > 0)


def violation_counts(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule, violations): one pass, one partial aggregation, no explode."""
    wide = df.agg(*[F.coalesce(F.sum(r.violated().cast("long")), F.lit(0)).alias(r.name) for r in rules])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("violations")) for r in rules])))


def enforce(df: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, rows that do not with ``failed_rules``)."""
    tagged = df.withColumn("failed_rules", failed_rules(rules))
    return tagged.filter(F.size("failed_rules") == 0).drop("failed_rules"), tagged.filter(F.size("failed_rules") > 0)
