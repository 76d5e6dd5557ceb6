from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedgework.functions.series import deviations, grow, run_lengths
from sedgework.operators import spikes

SCHEMA = "measurement_id bigint, runner string, metric string, measured_at timestamp_ntz, arrived_at timestamp_ntz, x double, y double, reason string"
T0 = datetime(2024, 1, 1)


def frame(spark, values, runner="r", start=0, others=None):
    rows = [(start + i, runner, "m", T0 + timedelta(hours=5 * i), T0 + timedelta(hours=5 * i + 1), v, (others or values)[i], "clash") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def normal(n, level=1.0, spread=0.03, seed=1):
    noise = np.clip(np.random.default_rng(seed).normal(0, 1, n), -3.5, 3.5)
    return [float(x) for x in level * (1 + spread * noise)]


def found(df, rows):
    return rows(spikes.cases(df, ["x"]), "measurement_id")


def test_spikes_stuck_and_impossible(spark, rows):
    values = normal(120)
    values[20], values[60], values[61] = 1.5, 40.0, 0.6
    values[80:85] = [1.01] * 5
    values[100:104] = [0.99] * 4
    values[30], values[31], values[32], values[33] = 0.0, -1.0, float("inf"), float("nan")
    values[40] = None
    assert found(frame(spark, values), rows) == sorted([(i,) for i in (20, 30, 31, 32, 33, 60, 61, 80, 81, 82, 83, 84)], key=str)


def test_change_of_level_is_no_case(spark, rows):
    values = normal(60) + normal(60, level=1.4, seed=2) + normal(40, level=0.2, spread=0.05, seed=3)
    assert found(frame(spark, values), rows) == []
    values[70] = 1.0  # the former level, but not the level there
    assert found(frame(spark, values), rows) == [(70,)]


def test_nulls_dont_break_a_stuck_run(spark, rows):
    values = normal(50)
    values[10:16] = [1.0, 1.0, None, 1.0, 1.0, 1.0]
    assert found(frame(spark, values), rows) == sorted([(i,) for i in (10, 11, 13, 14, 15)], key=str)


def test_fields_repeats_and_small_series(spark, rows):
    a, b = normal(50), normal(50, level=100, seed=4)
    b[7] = 300.0
    df = frame(spark, a, others=b)
    again = df.where("measurement_id = 7").withColumn("arrived_at", F.col("arrived_at") + F.expr("interval 90 days"))
    df = df.unionByName(again).unionByName(again).unionByName(frame(spark, [1.0, 9.0], runner="tiny", start=500)).unionByName(frame(spark, [1.0, 0.0, None], runner=None, start=600))
    assert rows(spikes.cases(df, ["x", "y"])) == sorted([(7, "y"), (601, "x"), (601, "y")], key=str)
    every = spikes.judged(df, ["x", "y"])
    assert every.count() == 2 * (50 + 2 + 2)
    assert every.where("reason is null and score is null").count() == 0


def test_empty(spark, rows):
    assert found(frame(spark, [1.0]).limit(0), rows) == []


def test_long_series_in_chunks(spark, rows, monkeypatch):
    values = normal(700)
    values[99] = values[101] = values[350] = 2.0
    values[298:304] = [1.0] * 6
    df = frame(spark, values).unionByName(frame(spark, normal(30, seed=9), runner="short", start=5000))
    whole = found(df, rows)
    assert len(whole) == 9
    monkeypatch.setattr(spikes, "CHUNK", 100)
    monkeypatch.setattr(spikes, "MARGIN", 30)
    assert found(df, rows) == whole


def test_many_copies_in_a_long_series(spark, rows, monkeypatch):
    """Copies of one measurement fill no chunks, more of them than the margin."""
    values = normal(300)
    values[120], values[202] = 0.0, 40.0
    df = frame(spark, values)
    copies = df.where("measurement_id in (120, 202)").crossJoin(spark.range(700).withColumnRenamed("id", "n")).withColumn("arrived_at", F.expr("arrived_at + make_dt_interval(0, 1 + n * 389 % 701)")).drop("n")
    late = df.where("measurement_id = 50").withColumns({"arrived_at": F.lit(None).cast("timestamp_ntz"), "x": F.lit(-1.0)})
    df = df.unionByName(copies).unionByName(late)
    whole = found(df, rows)
    assert whole == [(120,), (202,)]
    monkeypatch.setattr(spikes, "CHUNK", 100)
    monkeypatch.setattr(spikes, "MARGIN", 30)
    assert found(df, rows) == whole
    assert spikes.judged(df, ["x"]).count() == 300


def test_margin_counts_readings_of_the_field(spark, rows, monkeypatch):
    """A field with a reading in every twentieth row has as wide a margin as the others."""
    values = [v if i % 20 == 0 else None for i, v in enumerate(normal(1000))]
    for i in range(40, 140, 20):
        values[i] = 1.0
    df = frame(spark, values, others=normal(1000, seed=5))
    every = lambda: rows(spikes.cases(df, ["x", "y"]))
    whole = every()
    assert whole == sorted([(i, "x") for i in range(40, 140, 20)], key=str)
    monkeypatch.setattr(spikes, "CHUNK", 100)
    monkeypatch.setattr(spikes, "MARGIN", 30)
    assert every() == whole


def test_run_lengths():
    assert list(run_lengths(np.array([1.0, 1.0, 2.0, np.nan, np.nan, 2.0]))) == [2, 2, 1, 1, 1, 1]
    assert list(run_lengths(np.array([]))) == []


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_short_input(n):
    z, _, _ = deviations(np.ones(n), np.ones(n, dtype=bool))
    assert len(z) == n
    assert {len(x) for x in spikes.featured(np.ones(n), np.zeros(n), np.zeros(n, dtype=int)).values()} == {n}


def scores(x, source=None):
    source = np.zeros(len(x), dtype=int) if source is None else source
    return grow(x, source, int(source.max(initial=0)) + 1, [1] * x.shape[1], 4.0, 32).scores(x, source)


def test_forest_scores_outliers_above_average():
    x = np.random.default_rng(0).normal(0, 1, (400, 2))
    x[5] = [8, 8]
    found = scores(x)
    assert found.argmax() == 5 and found[5] > 0.6 > np.median(found)
    assert list(scores(np.zeros((1, 2)))) == [0.5]


def test_a_forest_doesnt_depend_on_the_others():
    x = np.random.default_rng(0).normal(0, 1, (256, 2))
    both = scores(np.concatenate([x, 9 * x]), np.repeat([0, 1], 256))
    assert np.allclose(both[:256], scores(x))


def test_the_score_decides(spark):
    """Every spike is above its source's threshold and no other reading is; without the forest's scores no spike comes out."""
    values = normal(200)
    values[50], values[90] = 1.4, 0.55
    found = {r["measurement_id"]: r for r in spikes.judged(frame(spark, values), ["x"]).collect()}
    assert {i for i, r in found.items() if r["score"] > r["threshold"]} == {50, 90} == {i for i, r in found.items() if r["reason"]}


@pytest.mark.parametrize("together", [1, 3])
def test_windows_at_production_parameters(spark, rows, together):
    """Three windows of the real size and a backfill under one time: as many cases as were put in."""
    values = normal(9000)
    at = [100, 4090, 4095, 4096, 4100, 8192, 8800]
    for i in at:
        values[i] = 1.6
    df = frame(spark, values)
    if together > 1:
        df = df.withColumn("measured_at", F.when(F.col("measurement_id").between(3000, 6000), F.lit(T0 + timedelta(hours=15000)).cast("timestamp_ntz")).otherwise(F.col("measured_at")))
    assert found(df, rows) == sorted([(i,) for i in at], key=str)
