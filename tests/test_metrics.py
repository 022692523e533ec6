"""Error and decision tables against numpy, with empty and one-class cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvecal.operators import decision, metrics
from curvecal.session import attach

SCHEMA = "model string, sample_id string, y_true double, y_pred double"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    t = np.r_[0.0, 0.0, 16.9, 16.73, 16.73, 17.07, rng.uniform(0, 24, 200)]
    p = t + rng.normal(size=len(t))
    rows = [("m", f"s{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(t, p))]
    rows += [("tiny", "z", 3.0, 4.0)]
    return t, p, spark.createDataFrame(rows, SCHEMA).repartition(3)


def one(df, model="m"):
    return df.where(F.col("model") == model).first()


def test_reg_metrics(data):
    t, p, df = data
    row = one(metrics.reg_metrics(df, ["model"]))
    assert row["rmse"] == pytest.approx(np.sqrt(((p - t) ** 2).mean()))
    assert row["r2"] == pytest.approx(1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert one(metrics.reg_metrics(df, ["model"]), "tiny")["r2"] is None


def test_outliers_inclusive(data):
    t, _, df = data
    row = one(metrics.outlier_counts(df, ["model"]))
    hit = np.abs(t - 16.9) <= 16.9 * 0.01
    assert row["removed"] == hit.sum() and row["kept"] == (~hit).sum()
    assert metrics.without_outliers(df).where("model = 'm'").count() == (~hit).sum()


def test_buckets_keep_empty_and_leave_zeros_out(data):
    t, p, df = data
    rows = {r["bucket"]: r for r in metrics.bucket_stats(df, ["model"]).where("model = 'm'").collect()}
    assert list(rows) == ["0-5", "5-10", "10-15", "15-25", ">25"]
    assert sum(r["n"] for r in rows.values()) == (t > 0).sum()
    assert rows[">25"]["n"] == 0 and rows[">25"]["rmse"] is None
    hit = (t > 5) & (t <= 10)
    assert rows["5-10"]["mae"] == pytest.approx(np.abs(p - t)[hit].mean())
    assert rows["5-10"]["cov15"] == pytest.approx((np.abs(p - t) <= 0.15 * t)[hit].mean())


def test_edges(spark):
    df = spark.createDataFrame([("m", "s", v, v) for v in (-1.0, 0.0, 5.0, 10.0, 25.0, 25.1, float("nan"))], SCHEMA)
    counts = {r["range"]: r["n"] for r in metrics.range_errors(df).collect()}
    assert counts == {"zero": 2, "low(0-10]": 2, "mid(10-25]": 1, "high(>25)": 1}
    buckets = {r["bucket"]: r["n"] for r in metrics.bucket_stats(df).collect()}
    assert buckets == {"0-5": 1, "5-10": 1, "10-15": 0, "15-25": 1, ">25": 1}


def test_coverage(data, spark):
    t, p, df = data
    row = one(metrics.coverage_pct(df, ["model"]))
    used = t > 0
    assert row["n_used"] == used.sum()
    assert row["coverage"] == pytest.approx((np.abs(p - t) <= 0.15 * t)[used].mean())
    empty = metrics.coverage_pct(spark.createDataFrame([("m", "s", 0.0, 1.0)], SCHEMA)).first()
    assert empty["coverage"] is None and empty["n_used"] == 0


def test_decision(data, spark):
    t, p, df = data
    row = one(decision.decision_metrics(df, ["model"]))
    tp, fn = ((t > 15) & (p > 15)).sum(), ((t > 15) & (p <= 15)).sum()
    assert row["tp"] == tp and row["sensitivity"] == pytest.approx(tp / (tp + fn))
    tiny = one(decision.decision_metrics(df, ["model"]), "tiny")
    assert (tiny["sensitivity"], tiny["specificity"], tiny["precision"], tiny["f1"]) == (0.0, 1.0, 0.0, 0.0)
    edge = decision.decision_metrics(spark.createDataFrame([("m", "s", 15.0, 15.0)], SCHEMA)).first()
    assert edge["tn"] == 1
    assert decision.confusion(df, ["model"]).where("model = 'tiny'").count() == 4


def test_histogram_and_centre(data):
    t, p, df = data
    err = np.abs(p - t)
    rows = {r["bin"]: r["n"] for r in decision.error_hist(df, ["model"]).where("model = 'm'").collect()}
    want, _ = np.histogram(err, bins=15)
    assert [rows.get(k, 0) for k in range(15)] == list(want)
    assert decision.error_hist(df, ["model"]).where("model = 'tiny'").first()["n"] == 1
    assert one(decision.error_centre(df, ["model"]))["median"] == pytest.approx(np.median(err))


def test_intervals(data):
    t, p, df = data
    row = decision.prediction_interval(df, ["model"]).where("sample_id = 's7'").first()
    half = 1.96 * 0.2 * p.std()
    assert row["lower"] == pytest.approx(p[7] - half) and row["upper"] == pytest.approx(p[7] + half)
    band = decision.residual_profile(df, ["model"]).where("model = 'm'").toPandas()
    inside = np.abs(p - t) <= 2 * np.sqrt(((p - t) ** 2).mean())
    assert band["within_band"].sum() == inside.sum()


def test_summary_and_delta(data):
    _, _, df = data
    rows = {r["model"]: r for r in decision.model_summary(df).collect()}
    assert rows["tiny"]["roc_auc"] is None and 0.9 < rows["m"]["roc_auc"] <= 1.0
    delta = one(metrics.rmse_delta(metrics.reg_metrics(df, ["model"]), 1.0))
    assert delta["delta"] == pytest.approx(delta["rmse"] - 1.0)
    assert one(metrics.rmse_delta(metrics.reg_metrics(df, ["model"]), None))["delta"] is None


def test_errors_listing(data):
    _, _, df = data
    rows = metrics.per_sample(df, ["model", "sample_id"]).collect()
    assert [r["y_true"] for r in rows] == sorted(r["y_true"] for r in rows)
    zero = metrics.per_sample_errors(df, ["sample_id"]).where("y_true = 0").first()
    assert zero["rel_error_pct"] is None


@pytest.mark.parametrize("limit", [10, 1])
def test_attach_beyond_its_limit_joins_without_broadcast(data, limit):
    _, _, df = data
    stats = df.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    joined = attach(df, stats, ["model"], limit=limit)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (limit == 10)
    assert joined.count() == df.count()
