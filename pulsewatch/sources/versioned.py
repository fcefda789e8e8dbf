"""Metrics table with merge on read.

An upsert writes its own rows only: a new batch folder, partitioned by window
size and month, and one commit that names the new parts.  A read unions the
live parts of the partitions asked for and keeps the row with the newest
``computed_at`` per (service, size, start).  When a partition has ``FANOUT``
parts of a level, these are merged into one of the next level, so a row is
rewritten a logarithmic number of times and a read meets few parts.

The log is a folder per commit, complete when it has its ``_SUCCESS`` file; a
commit adds and removes parts at once, so a reader sees a partition before or
after a change and never between.  Every ``SNAPSHOT``-th commit lists all live
parts, and readers start from the last of these.  Replaced files stay until
``vacuum``.  One writer at a time: two that commit the same number collide and
one fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

KEY = ("service_id", "window_size", "window_start")
FANOUT = 8
SNAPSHOT = 32
MAX_RECORDS_PER_FILE = 5_000_000
STORED = T.StructType([f for f in S.METRICS.fields if f.name != "window_size"])


@dataclass(frozen=True)
class Part:
    """One partition's files in one batch folder."""

    batch: str
    window_size: str
    month: str
    level: int

    @property
    def folder(self) -> str:
        return f"batch={self.batch}/window_size={self.window_size}/month={self.month}"


def _month(ts):
    return F.date_format(ts, "yyyy-MM")


class MetricsTable:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout

    # ---- log ----

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        """Numbers of all commit folders, complete or not."""
        jvm, fs = self._fs()
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(log)) if fs.exists(log) else []

    def _complete(self, n: int) -> bool:
        jvm, fs = self._fs()
        return bool(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{n:012d}/_SUCCESS")))

    def parts(self) -> list[Part]:
        """The live parts, oldest first: a few per partition."""
        done = [n for n in self._commits() if self._complete(n)]
        start = max((n for n in done if n % SNAPSHOT == 0), default=0)
        paths = [f"{self.path}/_log/{n:012d}" for n in done if n >= start]
        if not paths:
            return []
        rows = self.spark.read.schema("n long, entry string").json(paths).orderBy("n").collect()
        live: dict[Part, None] = {}
        for row in rows:
            entry = json.loads(row["entry"])
            if entry["all"] is not None:
                live = {Part(**p): None for p in entry["all"]}
                continue
            for p in entry["remove"]:
                live.pop(Part(**p), None)
            live.update({Part(**p): None for p in entry["add"]})
        return list(live)

    def _commit(self, add: list[Part], remove: list[Part]) -> None:
        n = max(self._commits(), default=0) + 1
        whole = None
        if n % SNAPSHOT == 0:
            gone = set(remove)
            whole = [asdict(p) for p in [q for q in self.parts() if q not in gone] + add]
        entry = {"add": [asdict(p) for p in add], "remove": [asdict(p) for p in remove], "all": whole}
        self.spark.createDataFrame([(n, json.dumps(entry))], "n long, entry string").coalesce(1).write.mode("errorifexists").json(f"{self.path}/_log/{n:012d}")

    # ---- rows ----

    def _write(self, rows: DataFrame, level: int) -> list[Part]:
        """Write rows as a new batch folder; its parts (sizes x months of the rows)."""
        batch = uuid.uuid4().hex
        rows.select(*S.METRICS.fieldNames()).withColumn("month", _month(F.col("window_start"))) \
            .sortWithinPartitions("window_size", "month", "service_id", "window_start") \
            .write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("window_size", "month").parquet(f"{self.path}/batch={batch}")
        jvm, fs = self._fs()
        found = []
        for size in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch}")):
            if size.isDirectory():
                found += [Part(batch, size.getPath().getName().split("=", 1)[1], m.getPath().getName().split("=", 1)[1], level) for m in fs.listStatus(size.getPath())]
        return found

    def _rows(self, parts: list[Part]) -> DataFrame:
        """All rows of ``parts``, with their place in the log."""
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*S.METRICS.fields, T.StructField("_order", T.IntegerType())]))
        order = {p.batch: i for i, p in enumerate(sorted(parts, key=lambda p: -p.level))}  # higher levels hold older rows
        schema = T.StructType([*STORED.fields, T.StructField("batch", T.StringType()), T.StructField("window_size", T.StringType()), T.StructField("month", T.StringType())])
        read = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{p.folder}" for p in parts])
        place = F.element_at(F.create_map(*[F.lit(x) for b, i in order.items() for x in (b, i)]), F.col("batch"))
        return read.select(*S.METRICS.fieldNames(), place.cast("int").alias("_order"))

    def _merged(self, parts: list[Part]) -> DataFrame:
        """One row per key: newest ``computed_at``, then the later commit."""
        rows = self._rows(parts)
        if len(parts) < 2 or len({(p.window_size, p.month) for p in parts}) == len(parts):
            return rows.drop("_order")  # a part has no key twice
        values = [c for c in S.METRICS.fieldNames() if c not in KEY]
        newest = F.max_by(F.struct(*values), F.struct(F.coalesce("computed_at", F.lit("0001-01-01").cast("timestamp")), "_order"))
        return rows.groupBy(*KEY).agg(newest.alias("_r")).select(*KEY, "_r.*").select(*S.METRICS.fieldNames())

    def read(self, window_size: str | None = None, since=None, until=None, service_id: str | None = None) -> DataFrame:
        """Metric rows in ``[since, until)``; only the parts of the partitions
        asked for are listed and opened."""
        parts = [p for p in self.parts() if window_size is None or p.window_size == window_size]
        bounds = self.spark.range(1).select(_month(F.lit(since).cast("timestamp")).alias("low"), _month(F.lit(until).cast("timestamp")).alias("high")).first()
        parts = [p for p in parts if (bounds["low"] is None or p.month >= bounds["low"]) and (bounds["high"] is None or p.month <= bounds["high"])]
        df = self._merged(parts)
        if since is not None:
            df = df.filter(F.col("window_start") >= F.lit(since).cast("timestamp"))
        if until is not None:
            df = df.filter(F.col("window_start") < F.lit(until).cast("timestamp"))
        return df if service_id is None else df.filter(F.col("service_id") == service_id)

    def read_tail(self, window_size: str, n: int, services: DataFrame | None = None, key: str = "service_id") -> DataFrame:
        """At least the newest ``n`` rows of each service (all it has, if fewer),
        by whole months: the newest month is read, then older ones, each only for
        the services that still lack rows, until none does (G8).  ``services``
        are the ids to serve; by default those with a row in the newest month."""
        from ..session import cut_lineage
        mine = [p for p in self.parts() if p.window_size == window_size]
        out, lacking = None, None if services is None else cut_lineage(services.select(F.col(key).alias("service_id")).distinct().withColumn("have", F.lit(0).cast("long")))
        for month in sorted({p.month for p in mine}, reverse=True):
            rows = self._merged([p for p in mine if p.month == month])
            if lacking is not None:
                if lacking.isEmpty():
                    break
                rows = rows.join(lacking.select("service_id"), "service_id", "left_semi")
            counts = rows.groupBy("service_id").agg(F.count(F.lit(1)).alias("got"))
            if lacking is None:
                lacking = counts.select("service_id", F.lit(0).cast("long").alias("have"))
            lacking = cut_lineage(lacking.join(counts, "service_id", "left").select("service_id", (F.col("have") + F.coalesce("got", F.lit(0))).alias("have"))
                                  .where(F.col("have") < n))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self._merged([])

    # ---- changes ----

    def upsert(self, df: DataFrame) -> None:
        """Append the rows as a new version of their keys; of one key given
        twice the newest ``computed_at`` is kept.  No rows: no commit."""
        values = [c for c in S.METRICS.fieldNames() if c not in KEY]
        one = df.groupBy(*KEY).agg(F.max_by(F.struct(*values), F.coalesce("computed_at", F.lit("0001-01-01").cast("timestamp"))).alias("_r")).select(*KEY, "_r.*")
        added = self._write(one, 0)
        if not added:
            return
        self._commit(added, [])
        for size, month in sorted({(p.window_size, p.month) for p in added}):
            self._compact(size, month)

    def _compact(self, size: str, month: str) -> None:
        """Merge levels of a partition that have ``fanout`` parts or more."""
        level = 0
        while True:
            mine = [p for p in self.parts() if (p.window_size, p.month) == (size, month)]
            same = [p for p in mine if p.level == level]
            if len(same) < self.fanout:
                if not any(p.level > level for p in mine):
                    return
            else:
                self._commit(self._write(self._merged(same), level + 1), same)
            level += 1

    def delete(self, ids: DataFrame, since=None, until=None, key: str = "service_id") -> int:
        """Remove the rows of the services in ``ids`` (null ids match nothing)
        in ``[since, until)``; returns how many.  Partitions without such rows
        are not rewritten, and all changes become visible in one commit, so the
        delete can be repeated after a failure."""
        doomed = ids.select(F.col(key).alias("service_id")).distinct()
        hits = self.read(since=since, until=until).join(doomed, "service_id", "left_semi") \
            .groupBy("window_size", _month(F.col("window_start")).alias("month")).count().collect()  # a row a touched partition
        touched = {(h["window_size"], h["month"]) for h in hits}
        if not touched:
            return 0
        old = [p for p in self.parts() if (p.window_size, p.month) in touched]
        inside = F.lit(True)
        if since is not None:
            inside = inside & (F.col("window_start") >= F.lit(since).cast("timestamp"))
        if until is not None:
            inside = inside & (F.col("window_start") < F.lit(until).cast("timestamp"))
        rows = self._merged(old).withColumn("_inside", inside).join(doomed.withColumn("_doomed", F.lit(True)), "service_id", "left")
        kept = rows.where(~(F.col("_inside") & F.coalesce("_doomed", F.lit(False))))
        self._commit(self._write(kept, max(p.level for p in old)), old)
        return sum(h["count"] for h in hits)

    def vacuum(self) -> int:
        """Delete the files of parts that are not live any more (no reader may
        still use them); returns how many parts went."""
        jvm, fs = self._fs()
        live, gone = {p.folder for p in self.parts()}, 0
        for batch in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)):
            if not batch.getPath().getName().startswith("batch="):
                continue
            for size in fs.listStatus(batch.getPath()):
                for month in fs.listStatus(size.getPath()) if size.isDirectory() else []:
                    folder = "/".join([batch.getPath().getName(), size.getPath().getName(), month.getPath().getName()])
                    if folder not in live:
                        fs.delete(month.getPath(), True)
                        gone += 1
        return gone
