"""Exact order statistics, with slices forced on small data and one hot value or group."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvecal.operators import decision
from curvecal.operators import tally as tallies
from curvecal.operators.ranking import exact_quantiles, running_counts
from curvecal.operators.traces import trace_area, trace_d1_max, trace_slope


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.normal(size=900)]
    rows += [("b", 1.5)] * 700 + [("b", float(v)) for v in rng.integers(0, 5, 300)] + [("b", float("nan"))] * 3
    return spark.createDataFrame(rows, "g string, v double").repartition(5), rows


@pytest.mark.parametrize("parts", [None, 1, 300])
def test_running_counts(values, parts):
    df, rows = values
    got = running_counts(df, "v", ["g"], {"pos": F.when(F.col("v") > 0, 1).otherwise(0)},
                         parts=parts).collect()
    by = {g: np.array([v for h, v in rows if h == g and v == v]) for g in "ab"}
    assert len(got) == sum(len(set(x)) for x in by.values())
    for r in got:
        x = by[r["g"]]
        assert r["n"] == (x == r["v"]).sum() and r["cum_n"] == (x <= r["v"]).sum()
        assert r["all_n"] == len(x) and r["cum_pos"] == ((x <= r["v"]) & (x > 0)).sum()


@pytest.mark.parametrize("parts", [None, 1, 200])
def test_quantiles(values, parts):
    df, rows = values
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, "v", probs, ["g"], parts).collect():
        x = [v for h, v in rows if h == r["g"] and v == v]
        assert [r[f"q{k}"] for k in range(len(probs))] == pytest.approx(np.quantile(x, probs))


#: (values that are looked at, numbers in a table, values that cuts come from): small ones force finer tables
BOUNDS = [(50_000, 1 << 19, 16_384), (40, 1 << 6, 30), (7, 1 << 4, 5)]


@pytest.fixture(scope="module")
def two_groups(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate((np.round(rng.normal(size=900), 1), rng.normal(size=600), np.zeros(300), [np.nan] * 5))
    rows = [(f"k{i}", bool(i % 3 == 0), float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "key string, held boolean, y double").repartition(4)
    return df, [(k, g, x) for k, g, x in rows if x == x]


def bounded(monkeypatch, bounds):
    for name, value in zip(("FETCH", "CELLS", "SAMPLE"), bounds):
        monkeypatch.setattr(tallies, name, value)


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("bits", [0, 3])
def test_order_statistics_from_the_count_table(two_groups, monkeypatch, bounds, bits):
    bounded(monkeypatch, bounds)
    df, rows = two_groups
    written = tallies.Rows.write(df, F.col("y"), F.col("held"), tallies.hash_number(42, F.col("key")))
    table = tallies.tally(written, bits)
    assert written.count == len(rows) == table.n.sum()
    assert (table.low <= table.high).all() and (table.high[:-1] < table.low[1:]).all()
    held = np.sort([x for _, g, x in rows if g])
    ranks = np.array([0, 17, 300, len(held) - 1])
    finer, found = tallies.resolve(written, table, 1, lambda t: (t.counts(1), ranks), bits)
    assert {r: found[r] for r in ranks} == {r: (held[r], (held <= held[r]).sum()) for r in ranks}
    assert finer.n.sum() == len(rows) and finer.counts(1).sum() == len(held)


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("bits", [0, 3])
def test_hash_limits(two_groups, monkeypatch, bounds, bits):
    bounded(monkeypatch, bounds)
    df, rows = two_groups
    written = tallies.Rows.write(df, F.col("y"), F.col("held"), tallies.hash_number(42, F.col("key")))
    table = tallies.tally(written, bits)
    stratum = (table.low > 0).astype(int)  # zero is a slice of its own, so no slice straddles it
    wanted = {0: [1, 200, 0], 1: [5, 100]}
    limits, above = tallies.hash_limits(written, table, 1, stratum, F.when(F.col("v") > 0, 1).otherwise(0), wanted, bits)
    for s, ranks in wanted.items():
        mine = {k: x for k, g, x in rows if g and (x > 0) == bool(s)}
        ordered = sorted((int(hashlib.md5(f"42:{k}".encode()).hexdigest()[:15], 16), x) for k, x in mine.items())
        for r in ranks:
            assert limits[s, r] == (ordered[r - 1][0] if r else -1)
            if r:
                prefix, rest = above[s, r]
                assert rest.sum() == sum(h > limits[s, r] and h >> 60 - bits == prefix for h, _ in ordered)


@pytest.mark.parametrize("parts", [1, 60])
def test_auc_and_roc(spark, parts, monkeypatch):
    whole = decision.running_counts
    monkeypatch.setattr(decision, "running_counts", lambda *args: whole(*args, parts=parts))
    rng = np.random.default_rng(1)
    t, p = rng.uniform(0, 30, 500), np.round(rng.uniform(0, 30, 500))
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(t, p)]
                               + [("one", 20.0, 3.0), ("one", 21.0, 4.0)],
                               "model string, y_true double, y_pred double")
    auc = {r["model"]: r["roc_auc"] for r in decision.roc_auc(df, ["model"]).collect()}
    hi, lo = p[t > 15], p[t <= 15]
    wins = (hi[:, None] > lo[None, :]).mean() + 0.5 * (hi[:, None] == lo[None, :]).mean()
    assert auc["m"] == pytest.approx(wins) and auc["one"] is None
    for r in decision.roc_points(df.where("model = 'm'"), ["model"]).collect():
        assert r["tpr"] == pytest.approx((hi >= r["score"]).mean())
        assert r["fpr"] == pytest.approx((lo >= r["score"]).mean())


@pytest.mark.parametrize("per_slice", [10 ** 6, 30])
def test_traces_with_one_hot_sample(spark, per_slice, monkeypatch):
    from curvecal.operators import traces
    whole = traces.with_neighbours
    monkeypatch.setattr(traces, "with_neighbours", lambda df: whole(df, per_slice))
    rng = np.random.default_rng(2)
    data = {"hot": 800, "cold": 30, "pair": 2, "single": 1}
    rows, k = [], 0
    for name, n in data.items():
        for e in rng.choice(10_000, n, replace=False):
            rows.append((name, float(e), float(rng.normal()), k))
            k += 1
    df = spark.createDataFrame(rows, "sample_id string, e double, i double, row_id bigint")
    area = {r["sample_id"]: r["area"] for r in trace_area(df).collect()}
    d1 = {r["sample_id"]: r["d1_max"] for r in trace_d1_max(df).collect()}
    slope = {r["sample_id"]: r["slope"] for r in trace_slope(df).collect()}
    for name, n in data.items():
        xy = np.array(sorted((e, i) for s, e, i, _ in rows if s == name))
        if n < 2:
            assert np.isnan(area[name]) and np.isnan(d1[name]) and np.isnan(slope[name])
            continue
        assert area[name] == pytest.approx(np.trapezoid(np.clip(xy[:, 1], 0, None), xy[:, 0]))
        assert d1[name] == pytest.approx(np.gradient(xy[:, 1], xy[:, 0]).max())
        assert slope[name] == pytest.approx(np.polyfit(xy[:, 0], xy[:, 1], 1)[0])
