"""Histogram gradient boosting as barrier stages (K3, K5).

MLlib starts a job per tree level.  Here the features are cut into at most 256
bins once and stored as bytes, spread over tasks, and a barrier stage grows
many trees: at each level every task adds up gradients and hessians per (node,
feature, bin) of its own rows, the tasks exchange these histograms
(``allGather``; their size depends on bins and nodes, not on rows), and each
task finds the same splits from the same sums.  Several targets are boosted
side by side and share the exchanges.  Up to ``ROWS_PER_TASK`` rows there is
nothing to exchange and each target is grown in a task of its own.

A stage grows ``rounds`` trees and writes them; the next one starts from the
written trees.  An executor that is lost costs the rounds of one stage.

Split and leaf rules are second order: gain = GL^2/(HL+l) + GR^2/(HR+l) -
G^2/(H+l) has to reach ``gamma``, each child's hessian ``min_child_weight``, a
leaf is -rate * G/(H+l).
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_code

MAX_BINS = 256
ROWS_PER_TASK = 1 << 22
BLOCK = 1 << 15            # rows added up at once: their cells stay in the processor's cache
TREES = "target int, tree int, node int, feature int, cut int, gain double, hess double, value double"


@dataclass(frozen=True)
class Settings:
    """Boosting parameters; names and meaning as in the product's settings."""

    n_trees: int
    max_depth: int
    rate: float
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 1.0
    gamma: float = 0.0
    l2: float = 1.0
    logistic: bool = False
    seed: int = 42


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted loss by the margin."""
    if not logistic:
        return w * (margin - y), w.copy()
    p = 1 / (1 + np.exp(-margin))
    return w * (p - y), np.maximum(w * p * (1 - p), 1e-16)


def sampled(rows: np.ndarray, tree: int, target: int, s: Settings) -> np.ndarray:
    """Which rows a tree is grown on: by a hash of the row's own number, so it
    does not depend on how rows are spread."""
    if s.subsample >= 1:
        return np.ones(len(rows), bool)
    x = rows.astype(np.uint64) + np.uint64((s.seed * 1_000_003 + tree * 31 + target + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(s.subsample * ((1 << 64) - 1)))


def chosen_features(n: int, tree: int, target: int, s: Settings) -> np.ndarray:
    take = max(1, int(s.colsample * n))
    if take >= n:
        return np.arange(n)
    return np.sort(np.random.default_rng([s.seed, target, tree]).choice(n, take, replace=False))


def best_splits(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Per node the best (gain, feature place, cut, left G, left H) from its
    histograms of shape (nodes, features, bins); gain -inf where none may be."""
    gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    ga, ha = gl[:, :, -1:], hl[:, :, -1:]
    gr, hr = ga - gl, ha - hl
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = gl * gl / (hl + s.l2) + gr * gr / (hr + s.l2) - ga * ga / (ha + s.l2)
    gain = np.where((hl >= s.min_child_weight) & (hr >= s.min_child_weight), gain, -np.inf)
    gain[:, :, -1] = -np.inf
    flat = gain.reshape(len(gain), -1)
    top = flat.max(axis=1, keepdims=True)
    at = (flat >= top - 1e-9 * np.abs(top)).argmax(axis=1)   # the first of equals, whatever the order of the sums
    nodes, bins = np.arange(len(g)), g.shape[2]
    f, cut = at // bins, at % bins
    return flat[nodes, at], f, cut, gl[nodes, f, cut], hl[nodes, f, cut]


class Tree:
    """One tree in heap order: node i has children 2i+1 and 2i+2; feature -1 is a leaf."""

    def __init__(self, depth: int):
        size = (1 << (depth + 1)) - 1
        self.feature, self.cut = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.gain, self.hess, self.value = np.zeros(size), np.zeros(size), np.zeros(size)
        self.used = np.zeros(size, bool)

    def rows(self, target: int, tree: int) -> list[tuple]:
        return [(target, tree, int(i), int(self.feature[i]), int(self.cut[i]), float(self.gain[i]), float(self.hess[i]), float(self.value[i]))
                for i in np.flatnonzero(self.used)]


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of every row of ``x`` (right where x > cut)."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            break
        node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
    return node


def leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, its rows) of one tree: rows are dealt out column by column, which
    for many rows takes a fraction of the time of ``walk``."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        n, rows = todo.pop()
        if feature[n] < 0 or not len(rows):
            yield n, rows
            continue
        right = x[:, feature[n]].take(rows) > cut[n]
        todo += [(2 * n + 1, rows.compress(~right)), (2 * n + 2, rows.compress(right))]


class Grower:
    """Grows one target's tree level by level on this task's rows.

    ``x`` is read by column.  Rows are kept by node; of two siblings only the one
    with the smaller hessian (over all tasks) is added up, the other's histogram is
    their parent's less that."""

    def __init__(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, features: np.ndarray, bins: int, s: Settings):
        self.x, self.g, self.h, self.features, self.bins, self.s = x, g, h, features, bins, s
        self.tree, self.rows, self.opened = Tree(s.max_depth), {0: np.flatnonzero(rows)}, []
        self.tree.used[0] = True
        self.active = np.array([0])
        # per active node: its place among the counted ones, whether it is counted itself, its parent's place in ``sums``
        self.counted, self.place, self.itself, self.parent, self.sums = [0], np.array([0]), np.array([True]), np.array([0]), None

    def cells(self) -> int:
        return len(self.counted) * len(self.features) * self.bins

    def histogram(self) -> tuple[np.ndarray, np.ndarray]:
        """G and H of this task by (feature, counted node, bin)."""
        for n in self.opened:
            rows = self.rows.pop(n)
            right = self.x[:, self.tree.feature[n]].take(rows) > self.tree.cut[n]
            self.rows[2 * n + 1], self.rows[2 * n + 2] = rows.compress(~right), rows.compress(right)
        out = np.zeros((2, len(self.features), len(self.counted), self.bins))
        for i, n in enumerate(self.counted):
            for at in range(0, len(self.rows[n]), BLOCK):
                rows = self.rows[n][at:at + BLOCK]
                g, h = self.g.take(rows), self.h.take(rows)
                for j, f in enumerate(self.features):
                    cell = self.x[:, f].take(rows).astype(np.intp)
                    out[0, j, i] += np.bincount(cell, g, self.bins)
                    out[1, j, i] += np.bincount(cell, h, self.bins)
        return out[0].ravel(), out[1].ravel()

    def split(self, parts: list[tuple]) -> None:
        """Take the histograms of all tasks and open the next level."""
        shape = (len(self.features), len(self.counted), self.bins)
        g, h = [sum(p[i] for p in parts).reshape(shape).transpose(1, 0, 2)[self.place] for i in (0, 1)]
        other = np.flatnonzero(~self.itself)
        for now, before in zip((g, h), self.sums or ()):
            now[other] = before[self.parent[other]] - now[other]
        gain, f, cut, gl, hl = best_splits(g, h, self.s)
        ga, ha = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
        t, s, following = self.tree, self.s, []
        self.sums, self.counted, self.opened = (g, h), [], []
        for i, n in enumerate(self.active):
            if n == 0:
                t.hess[0], t.value[0] = ha[i], -s.rate * ga[i] / (ha[i] + s.l2)
            if not gain[i] > max(s.gamma, 1e-6):
                continue
            t.feature[n], t.cut[n], t.gain[n] = self.features[f[i]], cut[i], gain[i]
            children = ((2 * n + 1, gl[i], hl[i]), (2 * n + 2, ga[i] - gl[i], ha[i] - hl[i]))
            lighter = min(children, key=lambda c: c[2])[0]
            for child, gs, hs in children:
                t.used[child], t.hess[child], t.value[child] = True, hs, -s.rate * gs / (hs + s.l2)
                if hs >= 2 * s.min_child_weight:
                    following.append((child, len(self.counted), child == lighter, i))
            if following and following[-1][3] == i:
                self.counted.append(lighter)
                self.opened.append(n)
        self.active, self.place, self.itself, self.parent = [np.array(c, kind) for c, kind in
                                                             zip(zip(*following) if following else [()] * 4, (np.int64, np.int64, bool, np.int64))]


def _packed(parts: list[tuple]) -> str:
    """The cells that are not empty: how many, place, G, H."""
    out = []
    for g, h in parts:
        full = np.flatnonzero(h)
        out += [np.array([len(full)], "<i4"), full.astype("<i4"), g[full].astype("<f8"), h[full].astype("<f8")]
    return base64.b64encode(b"".join(a.tobytes() for a in out)).decode()


def _unpacked(text: str, sizes: list[int]) -> list[tuple]:
    raw, at, out = base64.b64decode(text), 0, []
    for size in sizes:
        m, g, h = int(np.frombuffer(raw, "<i4", 1, at)[0]), np.zeros(size), np.zeros(size)
        full = np.frombuffer(raw, "<i4", m, at + 4)
        g[full], h[full] = np.frombuffer(raw, "<f8", 2 * m, at + 4 + 4 * m).reshape(2, m)
        out.append((g, h))
        at += 4 + 20 * m
    return out


def _grow(x: np.ndarray, ys: np.ndarray, w: np.ndarray, ids: np.ndarray, margins: np.ndarray, first: int, last: int, bins: int, s: Settings, gather,
          targets: list[int] | None = None) -> Iterator[tuple]:
    """Trees ``first`` to ``last`` - 1 of every target, as node rows; ``targets``
    are the numbers of the columns of ``ys`` and ``margins``."""
    numbers = list(range(ys.shape[1])) if targets is None else targets
    for t in range(first, last):
        growers = []
        for i, k in enumerate(numbers):
            g, h = gradients(margins[:, i], ys[:, i], w, s.logistic)
            growers.append(Grower(x, g, h, sampled(ids, t, k, s), chosen_features(x.shape[1], t, k, s), bins, s))
        for _ in range(s.max_depth):
            going = [a for a in growers if len(a.active)]
            if not going:
                break
            told = gather([a.histogram() for a in going], [a.cells() for a in going])
            for i, a in enumerate(going):
                a.split([p[i] for p in told])
        for i, (k, a) in enumerate(zip(numbers, growers)):
            for n, rows in leaves(x, a.tree.feature, a.tree.cut):
                margins[rows, i] += a.tree.value[n]
            yield from a.tree.rows(k, t)


# ---- on Spark ---------------------------------------------------------------------------------

@dataclass
class Boosted:
    """A fitted model: scaler, cuts per feature, margin at the start per target
    and the node table, whose size depends on trees and depth alone."""

    scaler: PipelineModel
    features: list[str]
    cuts: list[list[float]]
    base: list[float]
    settings: Settings
    nodes: pd.DataFrame
    targets: list[str] = field(default_factory=list)

    def importances(self, target: int = 0) -> list[float]:
        """Mean gain of a feature's splits, summing to one."""
        inner = self.nodes[(self.nodes["target"] == target) & (self.nodes["feature"] >= 0)]
        mean = inner.groupby("feature")["gain"].mean()
        total = float(mean.sum())
        return [float(mean.get(i, 0.0)) / total if total else 0.0 for i in range(len(self.features))]

    def transform(self, df: DataFrame, target: int = 0, out: str | None = None) -> DataFrame:
        """Add ``prediction`` (the mean) or, for a classifier, ``probability``."""
        ship_code(df.sparkSession)
        mine = self.nodes[self.nodes["target"] == target]
        depth, size = self.settings.max_depth, (1 << (self.settings.max_depth + 1)) - 1
        trees = []
        for _, t in mine.sort_values(["tree", "node"]).groupby("tree", sort=True):
            feature, cut, value = np.full(size, -1, np.int32), np.zeros(size), np.zeros(size)
            at, f = t["node"].to_numpy(), t["feature"].to_numpy()
            feature[at], value[at] = f, t["value"].to_numpy()
            inner = f >= 0
            cut[at[inner]] = [self.cuts[a][b] for a, b in zip(f[inner], t["cut"].to_numpy()[inner])]
            trees.append((feature, cut, value))
        shared = df.sparkSession.sparkContext.broadcast(trees)
        base, logistic = self.base[target], self.settings.logistic

        @F.pandas_udf(T.DoubleType())
        def predict(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="float64")
            x = np.stack(vectors.to_numpy())
            margin = np.full(len(x), base)
            for feature, cut, value in shared.value:
                margin += value[walk(x, feature, cut, depth)]
            return pd.Series(1 / (1 + np.exp(-margin)) if logistic else margin)

        scaled = self.scaler.transform(df).withColumn("_x", vector_to_array("features"))
        return scaled.withColumn(out or ("probability" if logistic else "prediction"), predict("_x")).drop("_x", "_raw", "features")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.scaler.write().overwrite().save(f"{path}/scaler")
        spark.createDataFrame(self.nodes, TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        facts = {"features": self.features, "cuts": self.cuts, "base": self.base, "targets": self.targets, "settings": self.settings.__dict__}
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @staticmethod
    def load(path: str) -> "Boosted":
        spark = SparkSession.active()
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        nodes = spark.read.schema(TREES).parquet(f"{path}/trees").toPandas()  # trees x nodes rows, whatever the data
        return Boosted(PipelineModel.load(f"{path}/scaler"), facts["features"], facts["cuts"], facts["base"], Settings(**facts["settings"]), nodes, facts["targets"])


def scaler_for(cols: list[str]) -> Pipeline:
    """K2: assemble then standardise (mean 0, std 1)."""
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="keep"),
                            StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)])


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of a barrier stage, which all run at once: one per
    ``ROWS_PER_TASK`` rows.  Spark answers an ``allGather`` about a second after
    it is complete, and a level of 2^20 rows takes about a tenth of that, so a
    task gets enough rows to be worth it (about 100 bytes each, as arrays)."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))


def fit(train: DataFrame, cols: list[str], targets: list[str], key: list[str], settings: Settings, weight: str | None = None,
        rounds: int = 200, tasks: int | None = None) -> Boosted:
    """Boost one model per target column over complete rows.

    ``key`` names the columns that tell rows apart (for the row samples).
    ``rounds`` trees a stage; ``tasks`` overrides their spread."""
    spark = train.sparkSession
    ship_code(spark)
    scaler = scaler_for(cols).fit(train)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = scaler.transform(train).select(vector_to_array("features").alias("x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"),
                                          w.alias("w"), F.xxhash64(*key).alias("id"))
    shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col("y")[k]).alias(f"y{k}") for k in range(len(targets))],
                     *[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"c{i}") for i in range(len(cols))]).first()
    if not facts["n"]:
        raise ValueError("no rows to boost on")
    cuts = [sorted(set(facts[f"c{i}"])) for i in range(len(cols))]
    means = [facts[f"y{k}"] / facts["w"] for k in range(len(targets))]
    base = [float(np.log(np.clip(m, 1e-6, 1 - 1e-6) / (1 - np.clip(m, 1e-6, 1 - 1e-6)))) if settings.logistic else float(m) for m in means]
    n_tasks = tasks or tasks_for(spark, facts["n"])
    edges = [np.array(c) for c in cuts]
    bins = max(len(c) for c in cuts) + 1

    def to_bytes(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                b = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pd.DataFrame({"x": [r.tobytes() for r in b], "y": pdf["y"], "w": pdf["w"], "id": pdf["id"]})

    folder = scratch_path(spark, f"boost-{uuid.uuid4().hex}")
    stored = "x binary, y array<double>, w double, id long"
    rows.mapInPandas(to_bytes, stored).withColumn("task", F.pmod(F.col("id"), F.lit(n_tasks))).write.parquet(f"{folder}/rows")
    binned = spark.read.schema(f"{stored}, task long").parquet(f"{folder}/rows")
    alone = n_tasks == 1                                     # nothing to exchange: a task a target
    if alone:
        binned = binned.select("x", F.posexplode("y").alias("task", "_y"), "w", "id").select("x", F.array("_y").alias("y"), "w", "id", "task")
    binned = binned.repartitionById(len(targets) if alone else n_tasks, F.col("task").cast("int"))

    grown = pd.DataFrame({c.split()[0]: [] for c in TREES.split(", ")})
    for first in range(0, settings.n_trees, rounds):
        last = min(settings.n_trees, first + rounds)
        so_far = spark.sparkContext.broadcast(grown)

        def boost(batches: Iterator[pd.DataFrame], first=first, last=last, so_far=so_far):
            read: dict[int, list[tuple]] = {}                # Python objects for a batch at a time only
            for pdf in batches:
                for k, rows in pdf.groupby("task" if alone else np.zeros(len(pdf), int)):
                    read.setdefault(int(k), []).append((np.frombuffer(b"".join(rows["x"]), np.uint8).reshape(len(rows), len(cols)),
                                                        np.stack(rows["y"].to_numpy()), rows["w"].to_numpy(float), rows["id"].to_numpy(np.int64)))
            if not alone and not read:                       # a task without rows still takes part
                read[0] = [(np.zeros((0, len(cols)), np.uint8), np.zeros((0, len(targets))), np.zeros(0), np.zeros(0, np.int64))]
            ctx = BarrierTaskContext.get() if not alone else None

            def gather(parts: list[tuple], sizes: list[int]) -> list[list[tuple]]:
                return [parts] if alone else [_unpacked(m, sizes) for m in ctx.allGather(_packed(parts))]

            for k in list(read):
                x, ys, w, ids = [np.concatenate(c) for c in zip(*read.pop(k))]
                x, mine = np.asfortranarray(x), [k] if alone else list(range(len(targets)))
                margins = np.tile(np.array(base)[mine], (len(x), 1))
                size = (1 << (settings.max_depth + 1)) - 1
                for (target, _), t in so_far.value.groupby(["target", "tree"], sort=True):
                    if target not in mine:
                        continue
                    feature, cut, value = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size)
                    at = t["node"].to_numpy(int)
                    feature[at], cut[at], value[at] = t["feature"], t["cut"], t["value"]
                    for n, rows in leaves(x, feature, cut):
                        margins[rows, mine.index(int(target))] += value[n]
                made = list(_grow(x, ys, w, ids, margins, first, last, bins, settings, gather, mine))
                if alone or ctx.partitionId() == 0:
                    yield pd.DataFrame(made, columns=[c.split()[0] for c in TREES.split(", ")])

        binned.mapInPandas(boost, TREES, barrier=not alone).write.parquet(f"{folder}/trees-{first}")
        grown = pd.concat([grown, spark.read.schema(TREES).parquet(f"{folder}/trees-{first}").toPandas()]) if len(grown) else \
            spark.read.schema(TREES).parquet(f"{folder}/trees-{first}").toPandas()
    return Boosted(scaler, list(cols), cuts, base, settings, grown.sort_values(["target", "tree", "node"]).reset_index(drop=True), list(targets))
