"""Trees shared by all settings of a forest grid."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvecal.operators import ensembles, forests, selection


def plain(bins, y, weight, held, depth, leaf):
    """One tree by trying every cut of every node."""
    mean = weight @ y / weight.sum()
    out, best, cut = np.full(held.shape[1], mean), 1e-9, None
    for j in range(len(bins) if depth else 0):
        for c in np.unique(bins[j])[:-1]:
            left = bins[j] <= c
            a, b = weight[left].sum(), weight[~left].sum()
            gain = (weight * (y - mean))[left].sum() ** 2 * (1 / a + 1 / b)
            if min(a, b) >= leaf and gain > best + 1e-9:
                best, cut = gain, (j, c)
    if cut:
        for side, far in ((bins[cut[0]] <= cut[1], held[cut[0]] <= cut[1]), (bins[cut[0]] > cut[1], held[cut[0]] > cut[1])):
            out[far] = plain(bins[:, side], y[side], weight[side], held[:, far], depth - 1, leaf)
    return out


@pytest.mark.parametrize("leaf", [1, 2, 4])
def test_tree_takes_the_best_cut_at_every_depth(leaf):
    rng = np.random.default_rng(leaf)
    for moved in (0.0, 1000.0):
        bins, held = rng.integers(0, 9, (3, 60)), rng.integers(0, 9, (3, 20))
        y, weight = rng.normal(size=60) + moved, rng.poisson(1.0, 60)
        kept = weight > 0
        got = forests.grow(bins, y, weight, held, [0, 2, 5, 30], leaf)
        for depth, values in zip([0, 2, 5, 30], got):
            np.testing.assert_allclose(values, plain(bins[:, kept], y[kept], weight[kept].astype(float), held, depth, leaf), atol=1e-7)


def test_trees_of_odd_rows():
    same = np.zeros((2, 5), int)
    assert (forests.grow(same, np.arange(5.0), np.ones(5, int), same, [1, 9], 1) == 2.0).all()  # nothing to cut
    assert (forests.grow(np.arange(5)[None], np.full(5, 3.0), np.ones(5, int), same[:1], [9], 1) == 3.0).all()  # one target
    assert (forests.grow(same, np.arange(5.0), np.zeros(5, int), same, [9], 1) == 2.0).all()  # an empty bag
    assert forests.grow(same, np.arange(5.0), np.ones(5, int), same[:, :0], [9], 1).shape == (1, 0)
    assert forests.thresholds(np.array([1.0, 1.0, 3.0])).tolist() == [2.0] and not len(forests.thresholds(np.ones(4)))
    assert len(forests.thresholds(np.arange(1000.0))) == 31


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 10 + 4 * (x[:, 0] > 0) + 2 * x[:, 1] + rng.normal(0, 0.3, 300)
    return spark.createDataFrame([(str(k % 5), float(y[k]), [float(v) for v in x[k]]) for k in range(300)],
                                 "g string, y double, x array<double>").cache()


def test_grid_needs_no_fit_per_setting(rows, monkeypatch):
    """The whole grid of 36 settings comes from one set of trees, without a fit for each setting and fold."""
    monkeypatch.setattr(selection.E, "fit_trees", lambda *a: pytest.fail("a fit of its own"))
    monkeypatch.setattr(forests, "BLOCK", 7)
    grid = {"forest": {"trees": [5, 10, 20], "depth": [2, 4, 6, None], "min_leaf": [1, 2, 4]}}
    settings = selection.expand(selection.Candidate("Random Forest", "forest"), grid)
    trainer = selection.Trainer(rows, 3)
    scores = trainer.cross_validate(settings)
    assert len(scores) == 36 * 5 and {(s[1], s[2]) for s in scores} == {(g, 60) for g in range(5)}
    alone = selection.Trainer(rows.repartition(4), 3).cross_validate([settings[13]])
    want = [s for s in scores if s[0] == settings[13].label()]
    assert [s[:3] for s in alone] == [s[:3] for s in want]
    np.testing.assert_allclose([s[3:] for s in alone], [s[3:] for s in want])


def test_scores_near_those_of_mllib(rows, monkeypatch):
    forest = [selection.Candidate("Random Forest", "forest", {"trees": 60, "depth": 5, "min_leaf": 2})]
    trainer = selection.Trainer(rows, 3)
    shared = selection.mean_rmse(trainer.cross_validate(forest))["Random Forest[trees=60,depth=5,min_leaf=2]"]
    monkeypatch.setattr(forests, "TASK_CELLS", 10)  # more rows than a task may hold: MLlib deals them out
    each = selection.mean_rmse(trainer.cross_validate(forest))["Random Forest[trees=60,depth=5,min_leaf=2]"]
    assert shared == pytest.approx(each, rel=0.1) and shared < 1.0


def test_constant_target_has_no_r2(rows):
    flat = rows.withColumn("y", F.lit(7.0))
    found = forests.forest_scores(flat, 3, [(5, None, 1)])[5, None, 1]
    assert [(f, n, e, r) for f, n, e, _, r in found] == [(g, 60, 0.0, None) for g in range(5)]
    assert ensembles.FOREST == {"trees": 300, "depth": 7, "min_leaf": 2} and forests.setting({"depth": None}) == (300, None, 2)


def test_refit_predicts_every_row(rows, monkeypatch):
    """A winning forest predicts from its own trees, equal rows alike, whatever the parts the rows are dealt into."""
    monkeypatch.setattr(selection.E, "fit_trees", lambda *a: pytest.fail("a fit of its own"))
    best = selection.Candidate("Random Forest", "forest", {"trees": 30, "depth": None, "min_leaf": 1})
    predictor = selection.Trainer(rows, 3).refit(best)
    asked = rows.unionByName(rows).withColumn("sample_id", F.lit(None).cast("string"))
    whole = predictor.predict(asked)
    assert whole.columns == [*asked.columns, "y_pred"] and whole.count() == 600
    assert whole.select(F.corr("y", "y_pred")).first()[0] > 0.95
    want = {tuple(r["x"]): r["y_pred"] for r in whole.collect()}
    monkeypatch.setattr(forests, "TASK_CELLS", 300)
    again = predictor.predict(asked).collect()
    assert len(again) == 600 and all(r["y_pred"] == pytest.approx(want[tuple(r["x"])], rel=1e-12) for r in again)


def by_kernel(spark, records):
    """What the kernel returns for packed records, as (record, setting, held row)."""
    table = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(records)], "k int, record binary")
    found = table.select("k", F.call_function(forests.kernel(spark), "record").alias("s")).orderBy("k").collect()
    return [np.array([np.frombuffer(bytes(cell)) for cell in r["s"]]) for r in found]


def case(rng, n, m, width, kinds, trees=3):
    weight = rng.poisson(1.0, (trees, n)).astype(np.uint8)
    return rng.integers(0, 32, (width, n)), rng.integers(0, kinds, n) * 3.38, rng.integers(0, 32, (width, m)), weight


def test_kernel_grows_the_trees_of_numpy(spark):
    rng = np.random.default_rng(3)
    cases = [case(rng, *sizes) for sizes in ((400, 90, 5, 10), (37, 11, 2, 3), (50, 0, 3, 4), (1, 4, 1, 2), (200, 30, 3, 1), (300, 40, 40, 90))]
    cases[1][-1][1] = 0  # an empty bag
    cases.append((np.zeros((2, 9), int), np.arange(9.0) + 1e6, np.zeros((2, 3), int), np.ones((1, 9), np.uint8)))  # nothing to cut
    depths, leaves = [0, 2, 5, 30], [1, 2, 4, 9]
    found = by_kernel(spark, [forests.packed(b, y, h, w, depths, leaves) for b, y, h, w in cases])
    for (bins, y, held, weight), got in zip(cases, found):
        want = [sum(forests.grow(bins, y, w, held, depths, leaf) for w in weight) for leaf in leaves]
        np.testing.assert_allclose(got, np.concatenate(want), rtol=1e-10, atol=1e-10)


def test_kernel_is_much_faster_than_numpy(spark):
    """12,000 trees in NumPy, one at a time, took longer than a study may."""
    bins, y, held, weight = case(np.random.default_rng(4), 8000, 2000, 14, 10, 10)
    record = forests.packed(bins, y, held, weight, [9, 30], [1, 2])
    by_kernel(spark, [record])
    began = time.perf_counter()
    by_kernel(spark, [record])
    took = (time.perf_counter() - began) / 20
    began = time.perf_counter()
    for tree in weight[:3]:
        forests.grow(bins, y, tree, held, [9, 30], 1)
    assert took < (time.perf_counter() - began) / 3 / 2


def test_scores_are_those_of_every_tree(rows):
    """Blocks, depths and leaf sizes come back at their places: scores equal those of trees grown one by one."""
    settings = [(trees, depth, leaf) for trees in (4, 23) for depth in (3, None) for leaf in (1, 5)]
    found = forests.forest_scores(rows, 3, settings)
    fold, x, y = forests.tree_rows(rows.select(F.col("g").cast("int").alias("fold"), "x", "y").toArrow(), 3)
    for trees, depth, leaf in settings:
        for g, n, rmse, mae, _ in found[trees, depth, leaf]:
            bins, known, held = forests.fold_data(fold, x, y, g)
            total = sum(forests.grow(bins, known, w, held, [depth or 30], leaf)[0] for w in forests.bags(0, trees, len(known), forests.SEED))
            err = total / trees - y[fold == g]
            assert (n, rmse, mae) == (60, pytest.approx((err ** 2).mean() ** 0.5), pytest.approx(np.abs(err).mean()))


def test_kernel_is_known_to_every_session(spark, rows):
    other = spark.newSession()
    record = bytearray(forests.packed(*case(np.random.default_rng(1), 20, 5, 2, 3), [30], [1]))
    for session in (spark, other, other):
        table = session.createDataFrame([(record,), (None,)], "r binary")
        found = table.select(F.call_function(forests.kernel(session), "r").alias("s")).collect()
        assert sorted(r["s"] is None for r in found) == [False, True]
