"""Streams against their batch forms."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvecal.functions.solvers import LinearFit
from curvecal.sources.adapters import GRID
from curvecal.streaming import scoring

FIT = LinearFit("f", 1.0, np.array([30.0, -2.0]))


def test_scores_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"s{k}", [float(v) for v in rng.normal(size=64)]) for k in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, cur array<double>")
    path = str(tmp_path / "in")
    df.repartition(6).write.parquet(path)
    stream = scoring.stream_parquet(spark, path, "*.parquet", df.schema, files_per_trigger=2)
    got = scoring.drain(scoring.score_curves(stream, GRID, FIT, ["sample_id"], ["Ip_corr", "FWHM"]), "t")
    want = scoring.score_curves(df, GRID, FIT, ["sample_id"], ["Ip_corr", "FWHM"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


BASE = dt.datetime(2024, 1, 1)
READINGS = "ts timestamp, value double, site string"


def add(spark, path, minutes, site="a"):
    """One more file of readings; even minutes are above the threshold."""
    rows = [(None if m is None else BASE + dt.timedelta(minutes=m), 1.0 if m is None or m % 2 else 20.0, site) for m in minutes]
    spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(str(path))
    time.sleep(1.1)  # files are read in order of modification time


def counted(rows):
    start = F.unix_timestamp("window_start") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    return sorted((r["s"] // 3600, r["n"], r["alerts"]) for r in rows.select(start.alias("s"), "n", "alerts").collect())


def alert_log(tmp_path, **how):
    return scoring.AlertLog(str(tmp_path / "out"), str(tmp_path / "progress"), **how)


def readings(spark, path):
    schema = spark.createDataFrame([], READINGS).schema
    return scoring.stream_parquet(spark, str(path), "*.parquet", schema, files_per_trigger=1)


@pytest.mark.parametrize("close", [False, True])
def test_late_readings_are_dropped(spark, tmp_path, close):
    for minutes in ([1, 30, 200], [190, 400], [2, 1000, None]):
        add(spark, tmp_path / "in", minutes)
    log = alert_log(tmp_path)
    got = counted(log.run(readings(spark, tmp_path / "in"), close))
    # Minute 2 arrives after the watermark has passed 190 and is dropped, whether or not the last window is closed.
    assert got == [(0, 2, 1), (3, 2, 2), (6, 1, 1)] + ([(16, 1, 1)] if close else [])
    # what is kept: the open window, or after closing the tick behind it
    assert log.seen[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_runs_go_on_where_the_last_one_stopped(spark, tmp_path):
    source = tmp_path / "in"
    add(spark, source, [1, 30, 100])
    first = counted(alert_log(tmp_path).run(readings(spark, source)))
    add(spark, source, [110, 3, 300])  # 3 is late by now
    second = counted(alert_log(tmp_path).run(readings(spark, source)))
    closed = counted(alert_log(tmp_path).run(readings(spark, source), close=True))
    again = counted(alert_log(tmp_path).run(readings(spark, source), close=True))
    add(spark, source, [302, 400])  # 302 belongs to a window that was closed
    last = counted(alert_log(tmp_path).run(readings(spark, source), close=True))
    assert first == [(0, 2, 1)]
    assert second == [(0, 2, 1), (1, 2, 2)]
    assert closed == again == [(0, 2, 1), (1, 2, 2), (5, 1, 1)]
    assert last == closed + [(6, 1, 1)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = scoring.write_batch(str(tmp_path / "out"))
    rows = spark.createDataFrame([(1,), (2,)], "n int")
    for number in (0, 1, 1, 0):
        write(rows, number)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_state_does_not_grow_with_the_stream(spark, tmp_path):
    for day in range(4):
        add(spark, tmp_path / "in", range(day * 1440, (day + 1) * 1440, 20))
    log = alert_log(tmp_path, by=("site",))
    got = log.run(readings(spark, tmp_path / "in"), close=True)
    assert got.count() == 96 and got.agg(F.sum("n")).first()[0] == 288 and got.columns == ["window_start", "site", "n", "alerts"]
    assert log.seen[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_no_readings(spark, tmp_path):
    add(spark, tmp_path / "in", [])
    assert alert_log(tmp_path).run(readings(spark, tmp_path / "in"), close=True).collect() == []


def test_predictions_meet_their_times(spark, tmp_path):
    scores = spark.createDataFrame([("a", 20.0), ("b", 3.0), ("c", float("nan")), ("d", None)], "sample_id string, y_pred double")
    rows = [(s, BASE + dt.timedelta(minutes=m)) for s, m in [("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), ("lost", 6), ("a", 70)]]
    times = spark.createDataFrame(rows, "sample_id string, ts timestamp")
    times.write.parquet(str(tmp_path / "in"))
    stream = scoring.stream_parquet(spark, str(tmp_path / "in"), "*.parquet", times.schema)
    got = counted(alert_log(tmp_path, value="y_pred").run(scoring.timed_scores(stream, scores), close=True))
    assert got == [(0, 5, 2), (1, 1, 1)]
