from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from data import START, series
from tidemark.functions.student import t_quantile
from tidemark.operators import anomaly
from tidemark.operators.forecast import forecast, forecast_series, with_band
from tidemark.operators.rca import Analysis
from tidemark.operators.timeseries import prepare_series
from tidemark.plans.requests import AnomalyRequest, ForecastRequest, RCARequest
from tidemark.sources import store


def frame(spark, rows):
    return spark.createDataFrame(rows, "day date, energy double")


def test_spike(spark):
    rows = series(75, slope=-0.2, bumps={52: 640.0})
    found = anomaly.detect_anomalies(frame(spark, rows), AnomalyRequest("day", "energy")).collect()
    big = [r for r in found if r["value"] > 400]
    assert [r["bucket"] for r in big] == [START + timedelta(52)] and big[0]["severity"] in ("critical", "high")
    forest = anomaly.isolation_anomalies(frame(spark, rows), AnomalyRequest("day", "energy", sensitivity="low"))
    assert START + timedelta(52) in {r["bucket"] for r in forest.collect()}


def test_flat_and_short_series_have_none(spark):
    flat = [(START + timedelta(k), 7.5) for k in range(26)]
    assert anomaly.detect_anomalies(frame(spark, flat), AnomalyRequest("day", "energy")).count() == 0
    assert anomaly.isolation_anomalies(frame(spark, flat), AnomalyRequest("day", "energy")).count() == 0
    with pytest.raises(ValueError, match="periods"):
        anomaly.detect_anomalies(frame(spark, series(9, bumps={8: 500.0})), AnomalyRequest("day", "energy"))


def test_gaps(spark):
    rows = [(date(2024, 1, 1), 10.0), (date(2024, 1, 4), 40.0)]
    assert [r["value"] for r in prepare_series(frame(spark, rows), "day", "energy", "mean").orderBy("bucket").collect()] == [10.0, 20.0, 30.0, 40.0]
    assert [r["value"] for r in prepare_series(frame(spark, rows), "day", "energy", "sum").orderBy("bucket").collect()] == [10.0, 0.0, 0.0, 40.0]


def test_forecast(spark):
    rows = forecast(frame(spark, series(84, slope=1.5)), ForecastRequest("day", "energy", horizon=10)).orderBy("step").collect()
    assert len(rows) == 10 and all(r["lower"] <= r["predicted"] <= r["upper"] for r in rows)
    assert abs(rows[0]["predicted"] - 209.0) < 1e-3 and abs(rows[6]["predicted"] - 216.0) < 1e-3
    with pytest.raises(ValueError):
        forecast(frame(spark, series(9)), ForecastRequest("day", "energy", horizon=10))


def test_forecast_may_go_below_zero_if_history_does(spark):
    rows = [(d, 60 - v) for d, v in series(45)]
    assert forecast(frame(spark, rows), ForecastRequest("day", "energy", horizon=5)).agg(F.max("lower")).first()[0] < 0


def test_t_quantile():
    for p, df, value in ((0.975, 1, 12.7062), (0.975, 10, 2.2281), (0.975, 62, 1.9990), (0.95, 30, 1.6973)):
        assert abs(t_quantile(p, df) - value) < 1e-4


def rca(spark, rows, **more):
    df = spark.createDataFrame(rows, "date date, cat string, val double")
    return Analysis(df, RCARequest("date", "val", **more))


def test_prior_window_and_step_shift(spark):
    rows = [(date(2023, 9, d), "A", 6.0 if d < 14 else 21.0) for d in range(10, 18)]
    rows += [(d, "B", 2.0) for d, *_ in rows]
    a = rca(spark, rows, event_start=date(2023, 9, 14), event_end=date(2023, 9, 17))
    assert (a.base_start, a.base_end, a.mode) == (date(2023, 9, 10), date(2023, 9, 13), "prior_period")
    s = {r["segment"]: r for r in a.segments().collect()}
    assert s["A"]["baseline_std"] == 0.0 and s["A"]["z_score"] is None and s["A"]["significant"] and s["A"]["delta"] == 60.0
    assert a.reconciliation().first()["reconciled"] and "cat=A" in a.narrative().first()[0]


def test_zero_net_change(spark):
    moved = {"P": (40.0, 70.0), "Q": (90.0, 75.0), "R": (20.0, 5.0)}
    rows = [(date(2023, 9, 10 + k), c, v[k]) for c, v in moved.items() for k in (0, 1)]
    a = rca(spark, rows, event_start=date(2023, 9, 11), event_end=date(2023, 9, 11))
    assert a.totals().first()["status"] == "undefined_zero_net_change"
    assert {(r["segment"], r["delta"], r["contribution_pct"]) for r in a.drivers().collect()} == {("P", 30.0, None), ("Q", -15.0, None), ("R", -15.0, None)}


def test_many_categories_become_21_segments(spark):
    rows = [(date(2023, 9, d), f"part{k}", 3.0 * k + d) for k in range(33) for d in (1, 2)]
    a = rca(spark, rows, event_start=date(2023, 9, 2), event_end=date(2023, 9, 2))
    r = a.reconciliation().first()
    assert r["n_segments"] == 21 and r["reconciled"]


def test_windows_of_unequal_length_are_scaled(spark):
    rows = [(date(2022, 7, d), c, v) for d, c, v in ((4, "north", 9.0), (5, "north", 8.0), (5, "south", 4.0), (6, "south", 6.0), (9, "north", 7.0), (10, "south", 4.0), (10, "north", 2.5))]
    a = rca(spark, rows, event_start=date(2022, 7, 9), event_end=date(2022, 7, 10), baseline_start=date(2022, 7, 4), baseline_end=date(2022, 7, 6), dimensions=["cat"])
    t = a.totals().first()
    assert (t["event"], t["baseline"], t["delta"], t["change_pct"]) == (13.5, 18.0, -4.5, -25.0)
    with pytest.raises(ValueError):
        rca(spark, rows, event_start=date(2022, 7, 4), event_end=date(2022, 7, 5))


def test_deviation_far_from_zero_and_of_segments_that_miss_days(spark):
    """A billion on top of every value changes no deviation; days without rows count as 0."""
    shape = {1: 4.0, 2: 6.0, 3: 5.0, 4: 4.5}
    for base in (0.0, 1e9):
        rows = [(date(2022, 7, d), "north", base + v) for d, v in shape.items()] + [(date(2022, 7, d), "south", 3.0) for d in (1, 4)]
        found = rca(spark, rows, event_start=date(2022, 7, 4), event_end=date(2022, 7, 4), baseline_start=date(2022, 7, 1), baseline_end=date(2022, 7, 3), dimensions=["cat"]).segments()
        got = {r["segment"]: r for r in found.collect()}
        assert got["north"]["baseline_std"] == 1.0 and got["north"]["z_score"] == -0.5 and not got["north"]["significant"]
        assert got["south"]["baseline_std"] == round(3**0.5, 4) and got["south"]["z_score"] == round(2 / 3**0.5, 4)


def test_series_of_many_keys_are_forecast_as_one_by_one(spark):
    """Long, short and unkeyed series in one plan; those too short are left out."""
    rows = [(k, d, v) for k, n in (("long", 60), ("cut", 15), ("short", 9), (None, 40)) for d, v in series(n, 0.7)]
    df = spark.createDataFrame([(k, "x", d, v) for k, d, v in rows], "shop string, kind string, day date, v double")
    found = forecast_series(df, ForecastRequest("day", "v", horizon=5), ["shop", "kind"])
    got = {}
    for r in found.orderBy("step").collect():
        got.setdefault(r["shop"], []).append(tuple(r)[2:])
    assert set(got) == {"long", "cut", None}
    for key, made in got.items():
        one = forecast(df.filter(F.col("shop").eqNullSafe(F.lit(key))), ForecastRequest("day", "v", horizon=5)).orderBy("step").collect()
        assert [r[:2] for r in made] == [tuple(r)[:2] for r in one]
        assert [x for r in made for x in r[2:]] == pytest.approx([x for r in one for x in tuple(r)[2:]], abs=1e-3)
    bands = with_band(found).filter("shop = 'long'").collect()
    assert all(r["band"] == pytest.approx(r["upper"] - r["lower"], abs=1e-4) and r["band"] >= 0 for r in bands)


def test_null_category_is_other_unless_frequent(spark):
    rows = [(date(2024, 1, d), c, 1.0) for d in (1, 2) for c in (None, "A", "B")]
    a = rca(spark, rows, event_start=date(2024, 1, 2), event_end=date(2024, 1, 2), dimensions=["cat"])
    assert {r["segment"] for r in a.segments().collect()} == {"A", "B", "Other"}


def test_replace_scopes(spark):
    schema = "org_id string, dataset_id string, metric string, bucket date, value double"
    old = spark.createDataFrame([("o", "d", "m", date(2024, 1, k), 1.0) for k in range(1, 8)] + [("p", "d", "m", date(2024, 1, 1), 1.0)], schema)
    new = spark.createDataFrame([("o", "d", "m", date(2024, 1, k), 2.0) for k in (3, 4)], schema)
    assert store.replace(old, new, store.in_scope("o", "d", "m")).count() == 3
    assert store.replace_range(old, new, "o", "d", "m").count() == 8
    assert store.replace_range(old, new.limit(0), "o", "d", "m").count() == 8
    assert store.listed(old, "o", limit=2).first()["bucket"] == date(2024, 1, 7)
