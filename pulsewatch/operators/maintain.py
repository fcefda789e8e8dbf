"""Dimension and table maintenance.

Key-based changes are joins: ``left_anti`` for insert-if-absent and deletes,
``left_semi`` for ownership filters, a left join + ``coalesce`` for patches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from . import constraints as CN

SERVICE_COLS = S.SERVICES.fieldNames()


def insert_services(dim: DataFrame, new: DataFrame) -> DataFrame:
    """M1: rows with an unseen id are appended; an existing id is left untouched."""
    fresh = new.join(dim.select("id"), "id", "left_anti")
    return dim.unionByName(fresh.select(*SERVICE_COLS))


def create_services(dim: DataFrame, requests: DataFrame, order: str = "request_seq",
                    now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """M2/M5: (accepted rows, conflicts) for create requests.

    A request conflicts when its (name, environment) exists, or an earlier
    request in the batch took it; requests failing the field checks are
    reported with the rule names.  ``capture_telemetry`` defaults to true.
    """
    now = now if now is not None else F.current_timestamp()
    checked = requests.withColumn("_failed", CN.failed_rules(CN.SERVICES))
    exists = dim.select("name", "environment").distinct().withColumn("_exists", F.lit(True))
    j = checked.join(exists, ["name", "environment"], "left")
    # only requests that could be accepted compete for a name
    able = (F.size("_failed") == 0) & F.col("_exists").isNull()
    w = Window.partitionBy("name", "environment", able).orderBy(order)
    j = j.withColumn("_rank", F.row_number().over(w))
    reason = (F.when(F.size("_failed") > 0, F.concat(F.lit("invalid: "), F.array_join("_failed", ",")))
              .when(F.col("_exists").isNotNull(), F.lit("conflict: name and environment exist"))
              .when(F.col("_rank") > 1, F.lit("conflict: duplicate in batch")))
    j = j.withColumn("reason", reason)
    conflicts = j.filter(F.col("reason").isNotNull()).select(order, "name", "environment", "reason")
    accepted = j.filter(F.col("reason").isNull()).select(
        "id", "name", "base_url", "owner", "environment", "description",
        F.coalesce(F.col("capture_telemetry"), F.lit(True)).alias("capture_telemetry"),
        F.col("created_by").cast("string").alias("created_by"),
        now.alias("created_at"), now.alias("updated_at"))
    return accepted, conflicts


def patch_services(dim: DataFrame, patches: DataFrame, now: Column | None = None) -> DataFrame:
    """M3: only non-null patch fields change; ``updated_at`` refreshed on patched rows."""
    now = now if now is not None else F.current_timestamp()
    editable = [c for c in ("name", "base_url", "owner", "environment", "description", "capture_telemetry")
                if c in patches.columns]
    p = patches.select("id", *[F.col(c).alias(f"_p_{c}") for c in editable], F.lit(True).alias("_patched"))
    j = dim.join(p, "id", "left")
    cols = []
    for c in SERVICE_COLS:
        if c in editable:
            cols.append(F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(F.col("_patched"), now).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def delete_services(dim: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4: (kept dimension rows, requested ids that did not exist)."""
    kept = dim.join(ids.select("id"), "id", "left_anti")
    unknown = ids.select("id").distinct().join(dim.select("id"), "id", "left_anti")
    return kept, unknown


def cascade(facts: DataFrame, deleted_ids: DataFrame, key: str = "service_id") -> DataFrame:
    """M4: fact rows of deleted services go with them."""
    return facts.join(deleted_ids.select(F.col("id").alias(key)), key, "left_anti")


def retention_delete(metrics: DataFrame, services: DataFrame, owner: str, since) -> tuple[DataFrame, DataFrame]:
    """M7/E5: drop rows of ``owner``'s services from ``since`` on -> (kept, removed)."""
    owned = services.filter(F.col("owner") == owner).select(F.col("id").alias("service_id"))
    hit = F.col("window_start") >= F.lit(since).cast("timestamp")
    in_scope = metrics.filter(hit).join(owned, "service_id", "left_semi")
    kept = metrics.filter(~hit).unionByName(metrics.filter(hit).join(owned, "service_id", "left_anti"))
    return kept, in_scope


def active_runs(runs: DataFrame) -> DataFrame:
    """Newest run per module is active, the others not."""
    w = Window.partitionBy("module").orderBy(F.col("trained_at").desc(), F.col("model_version").desc())
    return runs.withColumn("is_active", F.row_number().over(w) == 1)
