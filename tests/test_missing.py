"""Null keys, missing targets and predictions, repeated potentials, curves of wrong length, same-named scans."""

import math

import pytest
from pyspark.sql import functions as F

from curvecal.functions import arrays
from curvecal.operators import baseline, decision, gram, metrics, ranking, strata, traces
from curvecal.session import attach, drop_table, materialize
from curvecal.sources import scans, tables
from curvecal.streaming import scoring

NAN = float("nan")
SCORES = [("a", 1.0, 2.0), ("a", 20.0, 30.0), (None, 5.0, 4.0), (None, 20.0, 18.0), (None, 1.0, NAN), (None, 2.0, None)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(SCORES, "model string, y_true double, y_pred double")


def test_groups_with_a_null_key_stay(scores):
    by = ["model"]
    assert decision.prediction_interval(scores, by).count() == len(SCORES)
    assert decision.residual_profile(scores, by).count() == len(SCORES)
    assert {r.model for r in decision.error_centre(scores, by).collect()} == {"a", None}
    summary = {r.model: r for r in decision.model_summary(scores, by).collect()}
    assert summary[None].n == 2 and summary[None].undefined == 2 and summary["a"].roc_auc == 1.0
    quartiles = {r.model: r.q50 for r in baseline.describe(scores.where("y_pred IS NOT NULL AND NOT isnan(y_pred)"), "y_pred", by).collect()}
    assert quartiles == {"a": 16.0, None: 11.0}


@pytest.mark.parametrize("limit", [0, 100])
def test_attach_is_the_same_beyond_its_limit(scores, limit):
    sums = scores.groupBy("model").agg(F.count("*").alias("n"))
    got = attach(scores, sums, ["model"], limit=limit).groupBy("model", "n").count().collect()
    assert {(r["model"], r["n"], r["count"]) for r in got} == {("a", 2, 2), (None, 4, 4)}


@pytest.mark.parametrize("per_slice", [None, 5])
def test_readings_without_a_sample_stay_at_any_size(spark, per_slice):
    rows = [(None if k % 2 else "s", float(k // 2), 1.0 * k, k) for k in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, e double, i double, row_id int")
    got = traces.with_neighbours(df, per_slice).collect()
    assert len(got) == 60 and sum(r.prev is None for r in got) == 2 and sum(r.next is None for r in got) == 2


def test_missing_predictions_leave_all_metrics(scores):
    whole = metrics.reg_metrics(scores.where("model IS NULL")).first()
    assert whole.n == 2 and math.isclose(whole.mae, 1.5) and math.isclose(whole.r2, 1 - 5 / (112.5))
    cells = decision.decision_metrics(scores.where("model IS NULL")).first()
    assert (cells.tp, cells.tn, cells.fp, cells.fn, cells.undefined) == (1, 1, 0, 0, 2)


def test_curves_of_wrong_length_raise(spark):
    df = spark.createDataFrame([("0", 1.0, [1.0, 2.0]), ("0", 2.0, [1.0, 2.0, 3.0, 4.0]), ("0", 3.0, [1.0, 2.0, 3.0])], "g string, y double, x array<double>")
    with pytest.raises(Exception, match="3 are needed"):
        gram.gram_by_group(df, 3)


def test_missing_target_raises_in_fits_and_has_no_part_in_splits(spark):
    rows = spark.createDataFrame([("0", None, [1.0]), ("0", 1.0, [1.0])], "g string, y double, x array<double>")
    with pytest.raises(Exception, match="no target"):
        gram.gram_by_group(rows, 1)
    df = spark.createDataFrame([(str(k), "unseen", None if k % 5 == 0 else NAN if k % 7 == 0 else float(k % 9)) for k in range(100)],
                               "sample_id string, dataset string, y double")
    split = strata.fit_split(df, "y")
    parts = {r.part: r.n for r in split.assign(df).withColumn("lost", F.col("y").isNull() | F.isnan("y"))
             .groupBy("part", "lost").agg(F.count("*").alias("n")).where("lost = (part IS NULL)").collect()}
    assert sum(parts.values()) == 100 and parts[None] == 32 and parts["hold"] == sum(split.quotas.values())


def test_repeated_potential_gives_a_value(spark):
    df = spark.createDataFrame([([0.0, 1.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0, 3.0, 9.0])], "pot array<double>, cur array<double>")
    assert df.select(arrays.finite_max(arrays.gradient(F.col("pot"), F.col("cur")))).first()[0] == 6.0


def test_same_named_scans_stay_apart(spark, tmp_path):
    for folder, value in (("a", 1), ("b", 9)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x 5ppb.csv").write_text(f"-0.3,{value}\n-0.2,{value}\n")
    curves = scans.replicates_to_curves(scans.read_traces(spark, str(tmp_path))).collect()
    assert sorted(list(c.cur) for c in curves) == [[1.0, 1.0], [9.0, 9.0]]
    assert len({c.scan for c in curves}) == 2 and {c.source_file for c in curves} == {"x 5ppb.csv"}


def test_csv_doubles_quotes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\\'), (2, None)], "n int, t string")
    tables.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert '"a ""b"", c\\"' in text
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out"), df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.range(5).write.parquet(source)
    read = lambda: spark.readStream.schema("id bigint").parquet(source)
    assert scoring.drain(read(), "x", out, progress).count() == 5
    spark.range(5, 8).write.mode("append").parquet(source)
    assert sorted(r.id for r in scoring.drain(read(), "x", out, progress).collect()) == list(range(8))


def test_tables_can_be_removed(spark):
    df = materialize(spark.range(3), "x")
    files = df.inputFiles()
    drop_table(df)
    import os
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_running_counts_keep_null_groups(scores):
    assert {r.model for r in ranking.running_counts(scores.where("y_pred > 0"), "y_pred", ["model"], {"one": F.lit(1)}).collect()} == {"a", None}
