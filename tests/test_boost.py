"""Histogram boosting against plain definitions (K3, K5)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsewatch.ml import boost as BO


def plain_best(x, g, h, s):
    """Best (gain, feature, cut) of one node by trying every split."""
    best = (-np.inf, 0, 0)
    for f in range(x.shape[1]):
        for cut in range(255):
            left = x[:, f] <= cut
            hl, hr = h[left].sum(), h[~left].sum()
            if left.all() or hl < s.min_child_weight or hr < s.min_child_weight:
                continue
            gain = g[left].sum() ** 2 / (hl + s.l2) + g[~left].sum() ** 2 / (hr + s.l2) - g.sum() ** 2 / (h.sum() + s.l2)
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    return best


def test_root_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (300, 3))
    y = (x[:, 1] > 90).astype(float) + rng.normal(0, 0.2, 300)
    s = BO.Settings(1, 1, 0.3, min_child_weight=5)
    g, h = BO.gradients(np.zeros(300), y, np.ones(300), False)
    grower = BO.Grower(x, g, h, np.ones(300, bool), np.arange(3), 256, s)
    grower.split([grower.histogram()])
    gain, f, cut = plain_best(x, g, h, s)
    assert (grower.tree.feature[0], grower.tree.cut[0]) == (f, cut) and grower.tree.gain[0] == pytest.approx(gain, rel=1e-4)
    left = x[:, f] <= cut
    assert grower.tree.value[1] == pytest.approx(-0.3 * g[left].sum() / (h[left].sum() + 1), rel=1e-4)


def test_siblings_share_one_count():
    """A level adds up one child of each pair; the splits are those of adding up both."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (900, 3))
    y = (x[:, 0] > 60) * 1.0 + (x[:, 1] > 150) * 2 + rng.normal(0, 0.2, 900)
    s = BO.Settings(1, 2, 0.3, min_child_weight=5)
    g, h = BO.gradients(np.zeros(900), y, np.ones(900), False)
    a = BO.Grower(x, g, h, np.ones(900, bool), np.arange(3), 256, s)
    a.split([a.histogram()])
    told = a.histogram()
    assert len(a.active) == 2 and told[0].size == a.cells() == 3 * 256
    a.split([told])
    right = x[:, a.tree.feature[0]] > a.tree.cut[0]
    for node, rows in ((1, ~right), (2, right)):
        gain, f, cut = plain_best(x[rows], g[rows], h[rows], s)
        assert (a.tree.feature[node], a.tree.cut[node]) == (f, cut) and a.tree.gain[node] == pytest.approx(gain)


def test_leaves_are_those_of_a_walk():
    rng = np.random.default_rng(6)
    x, feature, cut = rng.integers(0, 256, (500, 3)), np.array([1, 0, -1, -1, 2, -1, -1] + [-1] * 8), rng.integers(60, 200, 15)
    got = np.full(500, -1)
    for n, rows in BO.leaves(x, feature, cut):
        got[rows] = n
    assert (got == BO.walk(x, feature, cut, 3)).all()


def test_gamma_and_child_weight_stop_splits():
    x, y = np.arange(40).reshape(-1, 1) % 20, np.r_[np.zeros(20), np.ones(20) * 0.1]
    g, h = BO.gradients(np.zeros(40), y, np.ones(40), False)
    for s in (BO.Settings(1, 3, 1.0, gamma=100.0), BO.Settings(1, 3, 1.0, min_child_weight=21)):
        a = BO.Grower(x, g, h, np.ones(40, bool), np.arange(1), 256, s)
        a.split([a.histogram()])
        assert a.tree.used.sum() == 1 and len(a.active) == 0


def test_sample_share_does_not_depend_on_order():
    s = BO.Settings(10, 2, 0.1, subsample=0.85)
    ids = np.random.default_rng(2).integers(-2 ** 62, 2 ** 62, 20_000)
    taken = BO.sampled(ids, 3, 0, s)
    assert abs(taken.mean() - 0.85) < 0.01
    assert (BO.sampled(ids[::-1], 3, 0, s)[::-1] == taken).all() and (BO.sampled(ids, 4, 0, s) != taken).any()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        a, b, c = rng.normal(size=3)
        data.append((i, float(a), float(b), float(c), float(2 * a - (b > 0.3) * 3), float(a + b > 0.8), 1.0 + (i % 3)))
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double, z double, w double").repartition(3).cache()


def test_spread_over_tasks_and_stages_is_the_same_model(spark, rows):
    s = BO.Settings(3, 3, 0.3, 0.8, 0.7)
    one = BO.fit(rows, ["a", "b", "c"], ["y", "z"], ["id"], s, weight="w", rounds=3, tasks=1)
    two = BO.fit(rows, ["a", "b", "c"], ["y", "z"], ["id"], s, weight="w", rounds=2, tasks=2)
    for k in (0, 1):
        p = {r.id: r.prediction for r in one.transform(rows, k).collect()}
        q = {r.id: r.prediction for r in two.transform(rows, k).collect()}
        assert p == pytest.approx(q, abs=1e-4)


def test_targets_without_exchange_are_grown_in_tasks_of_their_own(spark, rows, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    grow = BO._grow

    def counted(x, ys, *rest):
        seen.add(ys.shape[1] * 1000 + 1)
        yield from grow(x, ys, *rest)
    monkeypatch.setattr(BO, "_grow", counted)
    BO.fit(rows, ["a", "b", "c"], ["y", "z"], ["id"], BO.Settings(2, 2, 0.3), weight="w")
    assert seen.value == 2002                                # two calls of one target each


def test_learns_stores_and_loads(spark, rows, tmp_path):
    model = BO.fit(rows, ["a", "b", "c"], ["y"], ["id"], BO.Settings(80, 3, 0.2))
    r = model.transform(rows).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2)).alias("e"), F.stddev("y").alias("s")).first()
    assert r.e < 0.2 * r.s
    imp = model.importances()
    assert sum(imp) == pytest.approx(1) and imp[2] < min(imp[:2])
    model.save(str(tmp_path / "m"))
    back = BO.Boosted.load(str(tmp_path / "m"))
    assert {x.id: x.prediction for x in back.transform(rows).collect()} == {x.id: x.prediction for x in model.transform(rows).collect()}
    yes = BO.fit(rows, ["a", "b", "c"], ["z"], ["id"], BO.Settings(60, 3, 0.2, logistic=True, min_child_weight=2, gamma=0.1), weight="w")
    hit = yes.transform(rows).select(((F.col("probability") >= 0.5) == (F.col("z") == 1)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert hit > 0.97


def test_no_rows_is_an_error(rows):
    with pytest.raises(Exception):
        BO.fit(rows.limit(0), ["a", "b", "c"], ["y"], ["id"], BO.Settings(2, 2, 0.2))
