"""Splits, moments, solvers, selection and bootstrap against numpy."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvecal.functions import solvers as S
from curvecal.operators import bootstrap, ensembles, gram, latent, linear, selection, strata
from curvecal.operators.linear import predict_column

# Class sizes of a lab set: concentration -> curves.
LAB = {0: 24, 2: 4, 5: 24, 7: 4, 10: 24, 12: 4, 15: 24, 20: 4, 25: 24, 50: 4, 75: 3, 100: 4, 150: 4, 200: 4}


def frame(spark, ys, group="unseen"):
    return spark.createDataFrame([(f"s{k}", group, float(y)) for k, y in enumerate(ys)],
                                 "sample_id string, dataset string, y double")


def test_lab_bins(spark):
    df = frame(spark, [c for c, n in LAB.items() for _ in range(n)])
    bins = strata.fit_bins(df, "y")
    assert bins.k == 6 and list(bins.counts.values()) == [24, 28, 28, 28, 4, 24, 19]


def test_single_zero_falls_back(spark):
    bins = strata.fit_bins(frame(spark, [0.0] + [float(v) for v in range(1, 99)]), "y")
    assert bins.k == 0 and bins.counts == {0: 99}


@pytest.mark.parametrize("ys", [[5.0] * 20, [0.0] * 20, [0.0] * 10 + [3.0] * 10])
def test_one_value_falls_back(spark, ys):
    assert strata.fit_bins(frame(spark, ys), "y").k == 0


def small_tables(monkeypatch):
    """Force finer tables: few numbers in each, few rows looked at as values, rough first cuts."""
    for name, value in (("FETCH", 30), ("CELLS", 1 << 6), ("SAMPLE", 20)):
        monkeypatch.setattr(f"curvecal.operators.tally.{name}", value)


@pytest.mark.parametrize("small", [False, True])
def test_bins_match_pandas(spark, small, monkeypatch):
    if small:
        small_tables(monkeypatch)
    ys = np.round(np.random.default_rng(4).gamma(1.0, 10.0, 400), 1)
    df = frame(spark, ys)
    bins = strata.fit_bins(df, "y", zero_bin=False)
    got = {r["sample_id"]: r["b"] for r in df.select("sample_id", bins.column(F.col("y")).alias("b")).collect()}
    want = pd.qcut(pd.Series(ys), q=bins.k, labels=False, duplicates="drop")
    assert bins.k == 7 and [got[f"s{k}"] for k in range(400)] == list(want)
    assert bins.counts == want.value_counts().sort_index().to_dict()


def test_split(spark):
    lab = frame(spark, [c for c, n in LAB.items() for _ in range(n)], "lab")
    unseen = frame(spark, np.repeat(np.arange(0, 30, 3), 11)).withColumn("sample_id", F.concat(F.lit("u"), "sample_id"))
    df = lab.unionByName(unseen)
    split = strata.fit_split(df, "y")
    rows = split.assign(df).collect()
    held = [r for r in rows if r["part"] == "hold"]
    assert len(held) == 55 and all(r["dataset"] == "unseen" for r in held)
    assert sum(split.quotas.values()) == 55
    sizes = pd.DataFrame([r.asDict() for r in rows if r["part"] == "train"]).groupby("fold").size()
    assert len(sizes) == split.folds and sizes.max() - sizes.min() <= 1
    per = pd.DataFrame([r.asDict() for r in rows if r["part"] == "train"]).groupby(["stratum", "fold"]).size().unstack()
    assert (per.max(axis=1) - per.min(axis=1)).max() <= 1
    assert sorted(map(tuple, split.assign(df.repartition(7)).collect())) == sorted(map(tuple, rows))


def test_split_does_not_depend_on_the_size_of_its_tables(spark, monkeypatch):
    """The same members from one table and from many finer ones; a continuous target with zeros."""
    y = np.round(np.random.default_rng(9).gamma(1.0, 10.0, 1500), 3) * (np.arange(1500) % 11 > 0)
    df = frame(spark, y).withColumn("dataset", F.when(F.col("y") % 2 > 1, "lab").otherwise("unseen"))
    whole = sorted(map(tuple, strata.fit_split(df, "y").assign(df).collect()))
    small_tables(monkeypatch)
    assert sorted(map(tuple, strata.fit_split(df, "y").assign(df).collect())) == whole
    ordered = {}
    for name, group, value, part, stratum, fold in whole:
        number = int(hashlib.md5(f"42:{name}".encode()).hexdigest()[:15], 16)
        if group == "unseen" and part == "hold":
            ordered.setdefault(stratum, []).append(number)
    bins = strata.fit_bins(df.where("dataset = 'unseen'"), "y")
    for s, held in ordered.items():  # the held rows of a stratum are those with the smallest hashes
        mine = [int(hashlib.md5(f"42:s{k}".encode()).hexdigest()[:15], 16) for k, v in enumerate(y)
                if v % 2 <= 1 and bins.numbers(np.array([v]))[0] == s]
        assert sorted(held) == sorted(mine)[:len(held)]


def test_quotas_and_fold_count():
    assert sum(strata.holdout_quotas({0: 99}, 0.5).values()) == 50
    assert strata.holdout_quotas({0: 3, 1: 3, 2: 5}, 0.5) == {0: 1, 1: 2, 2: 3}
    assert [strata.fold_count({0: n}) for n in (1, 2, 4, 9)] == [2, 2, 4, 5]
    sizes = strata.fold_sizes({0: 7, 1: 4}, 5)
    assert sizes == {0: [2, 2, 1, 1, 1], 1: [1, 0, 1, 1, 1]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 100.0
    y = x @ np.array([1.0, 0.5, 0.0, -0.3, 0.2, 0.0]) + rng.normal(size=300)
    rows = spark.createDataFrame([(f"s{k}", str(k % 5), float(b), [float(v) for v in a])
                                  for k, (a, b) in enumerate(zip(x, y))],
                                 "sample_id string, g string, y double, x array<double>").repartition(4)
    return x, y, rows, gram.gram_by_group(rows, 6)


def test_gram(spark, data):
    x, y, rows, per = data
    z = np.column_stack([x, y])
    for g, mom in per.items():
        part = z[np.arange(300) % 5 == int(g)]
        assert mom.n == len(part)
        np.testing.assert_allclose(mom.mean, part.mean(axis=0))
        dev = part - part.mean(axis=0)
        np.testing.assert_allclose(mom.scatter, dev.T @ dev, rtol=1e-9, atol=1e-9)
    whole = gram.add(per.values())
    rest, direct = whole - per["0"], gram.add(per[g] for g in "1234")
    np.testing.assert_allclose(rest.scatter, direct.scatter, atol=1e-8)
    np.testing.assert_allclose(rest.mean, direct.mean)
    assert (per["0"] - per["0"]).n == 0
    raw = np.column_stack([np.ones(300), z])
    table = gram.gram_table(rows.withColumn("g", F.lit("all")), 6).toPandas()
    got = np.zeros((8, 8))
    got[table["i"], table["j"]] = table["v"]
    np.testing.assert_allclose(got, raw.T @ raw, rtol=1e-9)


def test_moments_far_from_zero():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(1000, 3))
    parts = [S.Moments.of(z[k:k + 100] + 1e8) for k in range(0, 1000, 100)]
    dev = z - z.mean(axis=0)
    np.testing.assert_allclose(gram.add(parts).scatter, dev.T @ dev, rtol=1e-6, atol=1e-4)


def lstsq(x, y):
    a = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(a, y, rcond=None)[0]


def test_linear_family(data):
    x, y, _, per = data
    mom = gram.add(per.values())
    want = lstsq(x, y)
    for fit in (S.ols(mom), S.pls(mom, 6), S.pcr(mom, 6), S.ridge(mom, 1e-10), S.lasso(mom, 1e-12)):
        np.testing.assert_allclose(np.append(fit.intercept, fit.coef), want, rtol=1e-5, atol=1e-6)
    xs = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.solve(xs.T @ xs + 5.0 * np.eye(6), xs.T @ (y - y.mean()))
    np.testing.assert_allclose(S.ridge(mom, 5.0).coef * x.std(axis=0), w, rtol=1e-8)


def test_lasso_conditions(data):
    x, y, _, per = data
    fit = S.lasso(gram.add(per.values()), 0.3)
    xs = (x - x.mean(axis=0)) / x.std(axis=0)
    w = fit.coef * x.std(axis=0)
    pull = xs.T @ (y - y.mean() - xs @ w) / len(y)
    assert np.all(np.abs(pull) <= 0.3 + 1e-7)
    np.testing.assert_allclose(pull[w != 0], 0.3 * np.sign(w[w != 0]), atol=1e-7)


def nipals(x, y, count):
    """Textbook deflating PLS1 on scaled data, for comparison only."""
    xs, ys = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    e, f, ws, ps, qs = xs.copy(), ys.copy(), [], [], []
    for _ in range(count):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(w), ps.append(p), qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    return w @ np.linalg.solve(p.T @ w, np.array(qs)) * y.std(ddof=1) / x.std(0, ddof=1)


@pytest.mark.parametrize("count", [1, 2, 4])
def test_pls_and_pcr(data, count):
    x, y, _, per = data
    mom = gram.add(per.values())
    np.testing.assert_allclose(S.pls(mom, count).coef, nipals(x, y, count), rtol=1e-6, atol=1e-8)
    xc = x - x.mean(axis=0)
    axes = np.linalg.svd(xc, full_matrices=False)[2][:count].T
    t = xc @ axes
    for alpha in (0.0, 5.0):
        b = np.linalg.solve(t.T @ t + alpha * np.eye(count), t.T @ (y - y.mean()))
        np.testing.assert_allclose(S.pcr(mom, count, alpha).coef, axes @ b, rtol=1e-6, atol=1e-9)


def test_more_features_than_rows_and_constant_columns():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(12, 30)), rng.normal(size=12)
    x[:, 4] = 3.0
    mom = S.Moments.of(np.column_stack([x, y]))
    fit = S.ols(mom)
    np.testing.assert_allclose(x @ fit.coef + fit.intercept, y, atol=1e-6)
    for other in (S.pls(mom, 15), S.pcr(mom, 15), S.lasso(mom, 0.01), S.ridge(mom, 1.0)):
        assert np.isfinite(other.coef).all() and abs(other.coef[4]) < 1e-6


def test_components(spark, data):
    x, y, rows, per = data
    mom = gram.add(per.values())
    pc = S.principal_components(mom)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(pc.variance, s ** 2 / 299, rtol=1e-8)
    np.testing.assert_allclose(pc.ratio, s ** 2 / (s ** 2).sum(), rtol=1e-8)
    np.testing.assert_allclose(np.abs(pc.axes.T), np.abs(vt), atol=1e-6)
    assert (pc.axes[np.abs(pc.axes).argmax(axis=0), range(6)] > 0).all()
    got = latent.pca_scores(rows, pc, "x", ["sample_id"]).toPandas().set_index("sample_id")
    want = (x - x.mean(axis=0)) @ pc.axes
    np.testing.assert_allclose(got.loc[[f"s{k}" for k in range(300)]].values, want, atol=1e-8)
    link = latent.component_correlation(spark, mom, pc).toPandas()
    np.testing.assert_allclose(link["r"], [np.corrcoef(want[:, k], y)[0, 1] for k in range(6)], atol=1e-8)


def test_p_value():
    """Known values of the two-sided t distribution."""
    for t, dof, p in ((2.228139, 10, 0.05), (1.0, 1, 0.5), (3.169273, 10, 0.01), (1.959964, 10 ** 6, 0.05)):
        r = t / np.sqrt(dof + t * t)
        assert latent.correlation_p(r, dof + 2) == pytest.approx(p, rel=1e-4)
    assert latent.correlation_p(0.0, 30) == pytest.approx(1.0)


def test_cross_validation(data):
    x, y, rows, per = data
    trainer = selection.Trainer(rows, 6, per)
    zoo = [selection.Candidate("Linear Regression", "ols"), selection.Candidate("PLS", "pls", {"components": 2})]
    scores = trainer.cross_validate(zoo)
    fold = np.arange(300) % 5
    for model, g, n, rmse, mae, r2 in scores:
        tr, te = fold != g, fold == g
        if model == "Linear Regression":
            b = lstsq(x[tr], y[tr])
            err = b[0] + x[te] @ b[1:] - y[te]
        else:
            c = nipals(x[tr], y[tr], 2)
            err = y[tr].mean() + (x[te] - x[tr].mean(axis=0)) @ c - y[te]
        assert n == te.sum() and rmse == pytest.approx(np.sqrt((err ** 2).mean()), rel=1e-6)
        assert mae == pytest.approx(np.abs(err).mean(), rel=1e-6)
        assert r2 == pytest.approx(1 - (err ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum(), rel=1e-6)


def test_choose_tunes_only_the_winner(data):
    _, _, rows, per = data
    trainer = selection.Trainer(rows, 6, per)
    winner, best, scores = trainer.choose([selection.Candidate("Ridge", "ridge"), selection.Candidate("RBF", "rbf")])
    assert winner.family == "ridge" and best.params["alpha"] in (0.1, 1.0, 5.0, 10.0)
    assert {s[0] for s in scores} == {"Ridge", "RBF"} | {f"Ridge[alpha={a}]" for a in (0.1, 1.0, 5.0, 10.0)}
    held = trainer.refit(best).predict(rows).select(F.sqrt(F.avg((F.col("y") - F.col("y_pred")) ** 2))).first()[0]
    assert held < 1.2


def test_grids():
    sizes = {f: len(selection.expand(selection.Candidate(f, f))) for f in
             ("ols", "ridge", "lasso", "rbf", "forest", "boosted", "pcr", "pcr_ridge", "pls")}
    assert sizes == {"ols": 0, "ridge": 4, "lasso": 4, "rbf": 12, "forest": 36, "boosted": 108,
                     "pcr": 6, "pcr_ridge": 24, "pls": 6}


def test_fourier_features_approach_the_kernel(spark, data):
    x, _, rows, per = data
    mom = gram.add(per.values())
    cosines = ensembles.fourier_map(mom, 0.05, size=4000)
    got = cosines.apply(rows.where("sample_id IN ('s1', 's2', 's3')"), ["sample_id"]).collect()
    z = {r["sample_id"]: np.array(r["x"]) for r in got}
    xs = (x - x.mean(axis=0)) / x.std(axis=0)
    for a, b in ((1, 2), (2, 3), (1, 1)):
        want = np.exp(-0.05 * ((xs[a] - xs[b]) ** 2).sum())
        assert z[f"s{a}"] @ z[f"s{b}"] == pytest.approx(want, abs=0.08)


def test_landmark_map_is_the_kernel_on_its_landmarks(spark, data):
    x, _, rows, per = data
    mom = gram.add(per.values())
    pool = ensembles.candidates(rows)
    assert sorted(map(tuple, pool)) == sorted(map(tuple, x))
    kernel = ensembles.landmark_map(pool, mom, 0.05, size=40)
    unit = (x - x.mean(axis=0)) / x.std(axis=0)
    landmarks = kernel.landmarks
    z = kernel.block(landmarks * kernel.scale + kernel.mean)
    np.testing.assert_allclose(z @ z.T, ensembles.gaussian(landmarks, landmarks, 0.05), atol=1e-6)
    # any row: the projection of its kernel on the landmarks
    cross = ensembles.gaussian(unit, landmarks, 0.05)
    want = cross @ np.linalg.pinv(ensembles.gaussian(landmarks, landmarks, 0.05), hermitian=True) @ cross.T
    got = kernel.apply(rows, ["sample_id"]).toPandas().set_index("sample_id").loc[[f"s{k}" for k in range(len(x))], "x"]
    seen = np.stack(got.to_numpy())
    np.testing.assert_allclose(seen @ seen.T, want, atol=1e-5)
    assert ensembles.kernel_error(kernel, rows) == pytest.approx(1 - np.diag(want).mean(), abs=1e-6)


def test_kernel_error_falls_with_landmarks(data):
    _, _, rows, per = data
    mom, pool = gram.add(per.values()), ensembles.candidates(rows)
    errors = [ensembles.kernel_error(ensembles.landmark_map(pool, mom, 0.05, size=k), rows) for k in (5, 20, 80, 300)]
    assert errors == sorted(errors, reverse=True) and errors[0] > 0.2 and errors[-1] < 1e-6


def test_moments_of_many_tiny_partitions(spark, monkeypatch):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(1200, 3)) + 1e4
    df = spark.createDataFrame([(str(k % 2), float(r[2]), [float(r[0]), float(r[1])]) for k, r in enumerate(z)],
                               "g string, y double, x array<double>").repartition(1000)
    for fan_in in (64, 2):
        monkeypatch.setattr(gram, "FAN_IN", fan_in)
        parts = gram.gram_by_group(df, 2)
        for g in (0, 1):
            mine = z[g::2]
            assert parts[str(g)].n == len(mine)
            np.testing.assert_allclose(parts[str(g)].centre, mine.mean(axis=0))
            np.testing.assert_allclose(parts[str(g)].scatter, np.cov(mine.T, bias=True) * len(mine), rtol=1e-8)
    assert gram.merge_levels(8) == [8, 1] and gram.merge_levels(10_000) == [10_000, 157, 3, 1] and gram.merge_levels(1) == [1]


def test_trees_learn(data):
    _, _, rows, _ = data
    for est in (ensembles.forest(trees=10, depth=4), ensembles.boosted(rounds=5, depth=3)):
        out = ensembles.predict_trees(ensembles.fit_trees(est, rows), rows)
        row = out.agg(F.corr("y", "y_pred")).first()
        assert row[0] > 0.7


def test_predict_fills_holes(spark):
    fit = S.LinearFit("f", 1.0, np.array([2.0, 3.0]))
    df = spark.createDataFrame([(1.0, None), (float("nan"), 2.0)], "a double, b double")
    assert [r[0] for r in df.select(predict_column(fit, ["a", "b"])).collect()] == [3.0, 7.0]


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = gram.apply_scaler(df, gram.scaler(df, ["a", "b"])).collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_bootstrap_moments_and_mean_band(data):
    x, y, rows, per = data
    moments = bootstrap.bootstrap_moments(rows, "sample_id", 6, replicates=200)
    n = np.array([m.n for m in moments])
    assert abs(n.mean() - 300) < 6 and 12 < n.std() < 23
    again = bootstrap.bootstrap_moments(rows.repartition(9), "sample_id", 6, replicates=200)
    np.testing.assert_allclose([m.n for m in again], n)
    trainer = selection.Trainer(rows, 6, per)
    refits = bootstrap.refit(trainer, selection.Candidate("o", "ols"), rows, "sample_id", 200)
    band = bootstrap.mean_band(refits, rows, ["sample_id"]).toPandas()
    assert (band["lower"] <= band["y_pred"]).mean() > 0.97 and (band["upper"] >= band["y_pred"]).mean() > 0.97
    a = np.column_stack([np.ones(300), x])
    err = y - a @ lstsq(x, y)
    want = 1.96 * np.sqrt(np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a) * (err ** 2).sum() / 293)
    half = (band.set_index("sample_id")["upper"] - band.set_index("sample_id")["lower"]) / 2
    ratio = half.loc[[f"s{k}" for k in range(300)]].values / want
    assert 0.85 < np.median(ratio) < 1.15


def test_bootstrap_weights_are_the_same_everywhere(spark):
    keys = [f"k{i}" for i in range(200)] + [None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    out = df.select("k", bootstrap.draw_bits(7, F.col("k"), 11).alias("bits"),
                    *[bootstrap.weight_column(7, F.col("k"), b).alias(f"w{b}") for b in (0, 7, 8, 10)]).toArrow()
    packed = bootstrap.weights_of(out.column("bits").combine_chunks(), 11)
    for i, k in enumerate(keys):
        for b in (0, 7, 8, 10):
            digits = hashlib.md5(f"7:{k or ''}:{b // 8}".encode()).hexdigest()[b % 8 * 4:][:4]
            want = sum(int(digits, 16) >= limit for limit in bootstrap.LIMITS)
            assert packed[i, b] == out.column(f"w{b}")[i].as_py() == want


def noisy(spark, n, seed):
    """Rows whose errors are skewed and not normal."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 4 + x @ [2.0, -1.0, 0.5] + rng.exponential(2.0, n)
    rows = [(f"{seed}-{k}", float(y[k]), [float(v) for v in x[k]]) for k in range(n)]
    return spark.createDataFrame(rows, "sample_id string, y double, x array<double>")


@pytest.mark.parametrize("family,params", [("ols", {}), ("ridge", {"alpha": 5.0}), ("rbf", {}), ("forest", {"trees": 10, "depth": 4})])
def test_prediction_bands_cover_new_observations(spark, family, params):
    train, fresh = noisy(spark, 1500, 1).withColumn("g", F.lit("0")), noisy(spark, 1500, 2)
    trainer = selection.Trainer(train, 3)
    refits = bootstrap.refit(trainer, selection.Candidate(family, family, params), train, "sample_id", 10 if family == "forest" else None)
    residuals = bootstrap.residual_table(refits, train, "sample_id")
    assert len(residuals) == bootstrap.RESIDUALS and residuals == sorted(residuals)
    got = bootstrap.coverage(bootstrap.prediction_band(refits, residuals, fresh, "sample_id", ["sample_id", "y"]), "y").first()
    assert got.n == 1500 and abs(got.coverage - 0.95) <= (0.04 if family == "forest" else 0.02)


def test_coefficient_table(spark, data):
    fit = S.ols(gram.add(data[3].values()))
    rows = linear.coefficient_table(spark, [fit], list("abcdef")).collect()
    assert [r["term"] for r in rows] == ["intercept", *"abcdef"]
