"""Scan files, wide tables, grids, picks and schema checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvecal import schema
from curvecal.operators import baseline, grids, relational
from curvecal.sources import scans, tables


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("scans")
    (root / "Ac TW 10ppb.csv").write_text("0.1,5,6\n-0.1,1,2\n0.0,3,\n")
    (root / "b 5 PPB.csv").write_text("-0.1,7\n0.0,8\n0.1,9\n")
    (root / "notes.txt").write_text("not a scan")
    return str(root)


def test_scan_files(spark, folder, tmp_path):
    assert [r["source_file"] for r in scans.scan_files(spark, folder).collect()] == ["Ac TW 10ppb.csv", "b 5 PPB.csv"]
    with pytest.raises(Exception):
        scans.scan_files(spark, str(tmp_path))


def test_traces_to_curves(spark, folder):
    points = scans.read_traces(spark, folder, "*.csv")
    assert points.count() == 9
    rows = {(r["source_file"], r["replicate"]): r for r in scans.replicates_to_curves(points).collect()}
    a = rows["Ac TW 10ppb.csv", 1]
    assert a["sample_id"] == "10ppb_S1" and a["pot"] == [-0.1, 0.0, 0.1] and a["cur"] == [1.0, 3.0, 5.0]
    assert math.isnan(rows["Ac TW 10ppb.csv", 2]["cur"][1])
    assert rows["b 5 PPB.csv", 1]["concentration_ppb"] == 5.0


def test_concentration_names(spark):
    df = spark.createDataFrame([("Ac TW 10ppb.csv",), ("x 5 PPB.csv",), ("a 16.9ppb.csv",)], "name string")
    assert [r[0] for r in df.select(scans.concentration_from_name(F.col("name"))).collect()] == [10, 5, 9]
    assert df.select(scans.concentration_from_name(F.col("name"), decimals=True)).collect()[2][0] == 16.9
    with pytest.raises(Exception, match="no concentration"):
        spark.createDataFrame([("none.csv",)], "name string").select(
            scans.concentration_from_name(F.col("name"))).collect()


GRID = [-0.4507, -0.44, -0.3, -0.1]


@pytest.fixture(scope="module")
def curves(spark):
    return spark.createDataFrame(
        [("a", 0.0, "f1", GRID, [1.0, 2.0, 3.0, 4.0]),
         ("b", 10.0, "f1", [e + 5e-7 for e in GRID], [2.0, 2.0, 2.0, 2.0]),
         ("c", 12.0, "f2", [-0.44, -0.3, -0.2], [5.0, 6.0, 7.0])],
        "sample_id string, concentration_ppb double, source_file string, pot array<double>, cur array<double>")


def test_grid_check(curves):
    rows = {r["source_file"]: r["mismatched"] for r in grids.grid_check(curves).collect()}
    assert rows == {"f1": 0, "f2": 1}
    with pytest.raises(ValueError, match="f2"):
        grids.grid_check(curves, strict=True)
    grids.grid_check(curves.where("source_file = 'f1'"), strict=True)


def test_grid_fill(curves):
    rows = {r["sample_id"]: r["cur"] for r in grids.grid_fill(curves, GRID).collect()}
    assert rows["b"] == [2.0] * 4
    assert math.isnan(rows["c"][0]) and rows["c"][1:3] == [5.0, 6.0] and math.isnan(rows["c"][3])


def test_wide_round_trip(spark, curves, tmp_path):
    own = curves.where("sample_id = 'a'")
    wide = tables.curve_to_wide(own, GRID, ["sample_id", "concentration_ppb"])
    assert wide.columns[2:] == ["E_-0.4507", "E_-0.4400", "E_-0.3000", "E_-0.1000"]
    back, grid = tables.wide_to_curve(wide.select("sample_id", "`E_-0.1000`", "`E_-0.4507`"))
    assert grid == [-0.4507, -0.1] and back.first()["cur"] == [1.0, 4.0]
    with pytest.raises(ValueError, match="no potential columns"):
        tables.wide_to_curve(own)
    path = str(tmp_path / "wide")
    tables.write_csv(wide.withColumn("E_-0.3000", F.lit(float("nan"))), path)
    row = tables.read_csv(spark, path, wide.schema).first()
    assert row["E_-0.3000"] is None and row["E_-0.1000"] == 4.0


def test_normalize_names():
    assert grids.normalized_names(["concentration_ppb", "E_-0.1", "V -0.25 x"]) == {
        "E_-0.1": "V_-0.1000", "V -0.25 x": "V_-0.2500"}
    with pytest.raises(ValueError, match="no potential"):
        grids.normalized_names(["sample_id"])
    with pytest.raises(ValueError, match="two columns"):
        grids.normalized_names(["E_0.10001", "V_0.1"])


def test_normalize_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "`E_-0.9` double, concentration_ppb double, `E_-0.1` double")
    assert grids.normalize_columns(df).columns == ["concentration_ppb", "V_-0.1000", "V_-0.9000"]
    assert grids.normalize_columns(df, as_text=False).columns == ["concentration_ppb", "V_-0.9000", "V_-0.1000"]


def test_shared_grids(spark):
    assert grids.shared_positions([-0.3, -0.2, -0.1], [-0.20001, -0.1, 0.0]) == ([-0.2, -0.1], [1, 2], [0, 1])
    with pytest.raises(ValueError):
        grids.shared_positions([0.1], [0.2])
    a = spark.createDataFrame([(1.0, 2.0)], "concentration_ppb double, V_a double")
    b = spark.createDataFrame([(1.0, 2.0)], "concentration_ppb double, V_b double")
    with pytest.raises(ValueError):
        grids.align_columns(a, b)


def test_baseline(curves):
    assert baseline.baseline_index([-0.5, -0.46, -0.44]) == 1 and baseline.baseline_index([-0.46, -0.46]) == 0
    moved = baseline.baseline_subtract(curves)
    rows = {r["sample_id"]: r["cur"] for r in moved.collect()}
    assert rows["a"] == [0.0, 1.0, 2.0, 3.0] and rows["c"] == [0.0, 1.0, 2.0]
    again = {r["sample_id"]: r["cur"] for r in baseline.baseline_subtract(moved).collect()}
    assert again == rows


def test_describe(spark):
    x = np.random.default_rng(0).normal(size=101)
    df = spark.createDataFrame([("g", float(v)) for v in x], "s string, v double")
    row = baseline.describe(df, "v", ["s"]).first()
    assert [row["q25"], row["q50"], row["q75"]] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])))
    assert row["std"] == pytest.approx(x.std(ddof=1))


def test_pick(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([11.0, 9.0, 0.5, 0.0, 27.9, 33.0, 12.0])],
                               "row_id int, concentration_ppb double")
    rows = relational.sample_pick(df, "row_id", ["concentration_ppb"]).collect()
    assert [(r["target"], r["picked_order"]) for r in rows] == [(0.0, 3), (10.0, 0), (25.0, 4), (35.0, 5)]


def test_feature_columns(spark):
    a = spark.createDataFrame([("s", "f", 1.0, 2.0, 3, "lab")],
                              "sample_id string, source_file string, concentration_ppb double, b double, a int, dataset string")
    assert relational.feature_select(a) == ["b", "a"]
    assert relational.feature_align(a, a.drop("b").withColumn("c", F.lit(1))) == ["a"]
    with pytest.raises(ValueError):
        relational.feature_align(a, a.drop("a", "b"))
    assert relational.dataset_union(a, a).select("dataset").distinct().count() == 2


def test_require(spark):
    df = spark.createDataFrame([(1.0,)], "concentration_ppb double")
    with pytest.raises(ValueError, match="Ip_corr"):
        tables.require(df, ["Ip_corr"])
    with pytest.raises(ValueError, match="V_"):
        tables.require(df, prefix="V_")


def test_schemas():
    assert len(schema.feature_table().fields) == 22 and len(schema.reduced_feature_table()) == 14
