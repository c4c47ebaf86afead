import random
import statistics
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from data import GAUGES, GAUGES_SCHEMA
from tidemark.functions.quantiles import below, medians, quantiles
from tidemark.operators import aggregate as agg
from tidemark.operators import timeseries
from tidemark.operators.filters import apply_filters, date_window
from tidemark.plans.requests import AggregationQuery, BreakdownQuery, CrossTabQuery, Filter, Metric, TimeSeriesQuery


@pytest.fixture(scope="module")
def gauges(spark):
    return spark.createDataFrame(GAUGES, GAUGES_SCHEMA)


def test_overview(gauges):
    got = {r["column"]: r for r in agg.overview_numeric(gauges).collect()}
    assert got["depth"]["sum"] == 16.5 and got["silt"]["median"] == 50.0
    assert agg.overview_temporal(gauges).first().asDict() == {"date_column": "taken", "min_date": date(2022, 11, 3), "max_date": date(2023, 2, 2), "range_days": 91}


def test_scalar(gauges):
    q = AggregationQuery([Metric("depth", "sum", "s"), Metric("silt", "mean", "m"), Metric("river", "count", "n"), Metric("silt", "median", "half")])
    assert agg.aggregate(gauges, q).collect() == [(16.5, 73.75, 9.0, 50.0)]
    assert agg.total_rows(gauges, q).first()[0] == 1


def test_groups_are_sorted(gauges):
    rows = agg.aggregate(gauges, AggregationQuery([Metric("silt", "sum", "s")], ["river"])).collect()
    assert [tuple(r) for r in rows] == [("Tees", 300.0), ("Aire", 255.0), ("Exe", 20.0), ("Wye", 15.0)]


def test_filters(gauges):
    q = AggregationQuery([Metric("depth", "sum", "s")], [], [Filter("river", "eq", "Tees"), Filter("silt", "gt", 50)])
    assert agg.aggregate(gauges, q).first()[0] == 6.0
    assert agg.aggregate(gauges, AggregationQuery([Metric("depth", "sum"), Metric("depth", "median")], [], [Filter("river", "eq", "Moon")])).count() == 0


def test_filters_reach_the_scan(spark, gauges, tmp_path):
    gauges.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = apply_filters(t, [Filter("silt", "eq", 60), Filter("depth", "gt", 1.5)]).select("river")._jdf.queryExecution().toString()
    assert "EqualTo(silt,60)" in plan and "GreaterThan(depth,1.5)" in plan


def test_neq_keeps_nulls_and_bad_values_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("b", 5.0)], "x string, y double")
    assert apply_filters(df, [Filter("x", "neq", "a")]).count() == 2
    assert apply_filters(df, [Filter("y", "eq", "5.0")]).count() == 1
    assert apply_filters(df, [Filter("y", "between", [9, 1])]).count() == 2 - 0
    for f in (Filter("y", "gt", "many"), Filter("x", "in", []), Filter("z", "eq", 1)):
        with pytest.raises(ValueError):
            apply_filters(df, [f])


def test_page(gauges):
    rows = agg.aggregate(gauges, AggregationQuery([Metric("depth", "max", "m")], ["river"], limit=2)).collect()
    assert [r["river"] for r in rows] == ["Tees", "Aire"]
    with pytest.raises(ValueError):
        AggregationQuery([Metric("a", "sum")], limit=5000)
    with pytest.raises(ValueError):
        agg.aggregate(gauges, AggregationQuery([Metric("river", "sum")]))


def test_months(gauges):
    q = TimeSeriesQuery("taken", Metric("depth", "sum"), "month", rolling=2, cumulative=True, growth=True)
    rows = timeseries.time_series(gauges, q).orderBy("timestamp").collect()
    assert [(r["timestamp"].month, r["value"]) for r in rows] == [(11, 4.5), (12, 2.0), (1, 8.5), (2, 1.5)]
    assert rows[-1]["cumulative"] == 16.5 and rows[0]["growth_pct"] is None and [r["rolling_avg"] for r in rows[1:3]] == [3.25, 5.25]


def test_weeks_end_on_monday(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-16", 4.0)], "d string, v double")
    rows = timeseries.time_series(df, TimeSeriesQuery("d", Metric("v", "sum"), "week")).orderBy("timestamp").collect()
    assert [(str(r[0]), r[1]) for r in rows] == [("2024-01-01", 1.0), ("2024-01-08", 2.0), ("2024-01-15", 0.0), ("2024-01-22", 4.0)]


def test_breakdown(gauges):
    rows = agg.breakdown(gauges, BreakdownQuery("river", Metric("silt", "sum"), 1, True)).collect()
    assert {(r["category"], r["value"]) for r in rows} == {("Tees", 300.0), ("Other", 290.0)}


def test_crosstab(spark, gauges):
    cells = {(r["row"], r["column"]): r["value"] for r in agg.crosstab(gauges, CrossTabQuery("river", "flood")).collect()}
    assert len(cells) == 6 and cells["Aire", "true"] == 2.0 and cells["Wye", "true"] == 0.0
    halves = {(r["row"], r["column"]): r["value"] for r in agg.crosstab(gauges, CrossTabQuery("river", "flood", Metric("silt", "median"))).collect()}
    assert halves["Aire", "true"] == 107.5 and halves["Wye", "false"] == 15.0
    many = spark.range(60).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    with pytest.raises(ValueError):
        agg.crosstab(many, CrossTabQuery("a", "b"))


def test_correlation_without_variance(spark):
    df = spark.createDataFrame([(float(k), 5.0 - 3 * k, 0.25) for k in (2, 9, 4, 11, 6)], "x double, y double, const double")
    for method in ("pearson", "spearman"):
        got = {(r["x"], r["y"]): r["value"] for r in agg.correlation(df, method=method).collect()}
        assert got["x", "y"] == -1.0 and got["x", "x"] == 1.0 and got["const", "const"] is None and got["x", "const"] is None
    with pytest.raises(ValueError):
        agg.correlation(df, ["x"])


def test_date_window(gauges):
    assert date_window(gauges, "taken", date(2023, 1, 1), date(2023, 1, 31)).count() == 4


def test_medians_of_groups_of_any_size(spark):
    """Groups above the bound are counted and dealt by range, the others are held; null keys are a group."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randint(0, 40)), rng.random()])) for _ in range(3000)] + [("one", 4.5), ("none", None)]
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    df = spark.createDataFrame([((k,), v) for k, v in rows], "k struct<x: string>, value double")
    for large in (0, 500, 10**6):
        got = {r["k"]["x"]: r["median"] for r in medians(df, ["k"], large).collect()}
        assert got == {k: statistics.median(v) for k, v in want.items()}
    many = spark.range(1_000_000).select(F.lit("all").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("double").alias("value"))
    assert medians(many, ["k"], 1000).first()["median"] == many.agg(F.median("value")).first()[0]
    grouped = agg.aggregate(spark.createDataFrame(rows, "k string, v double"), AggregationQuery([Metric("v", "median", "m"), Metric("v", "count", "n")], ["k"], limit=10)).collect()
    assert {r["k"]: (r["m"], r["n"]) for r in grouped} == {k: (round(statistics.median(v), 4), len(v)) for k, v in want.items()} | {"none": (None, 0)}


def _ranks(values):
    order = sorted(values)
    return [(order.index(v) + len(order) - 1 - order[::-1].index(v)) / 2 for v in values]


def test_rank_correlation_of_many_columns(spark):
    """Columns that lack different rows, ties, and fifty columns, which are planned at once."""
    rng = random.Random(5)
    rows = [[rng.choice([None, rng.randint(0, 9)]) if i == 2 else None if i == 3 and k % 5 == 0 else rng.randint(0, 6) + (k if i % 3 else 0) for i in range(6)] for k in range(150)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(6)))
    got = {(r["x"], r["y"]): r["value"] for r in agg.correlation(df, method="spearman").collect()}
    for i in range(6):
        for j in range(6):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            want = statistics.correlation(*(_ranks(c) for c in zip(*both, strict=True))) if i != j else 1.0
            assert got[f"c{i}", f"c{j}"] == pytest.approx(want, abs=6e-5)
    wide = spark.range(40).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)).alias(f"c{i}") for i in range(50)])
    began = time.monotonic()
    planned = agg.correlation(wide, method="spearman")
    planned._jdf.queryExecution().executedPlan()
    assert time.monotonic() - began < 30 and planned.count() == 2500


def test_no_job_runs_to_plan_quantiles(spark):
    group = "plan-only"
    spark.sparkContext.setJobGroup(group, "quantiles")
    quantiles(spark.range(100).select(F.col("id").alias("v")), ["v"], [0.5])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ranks_hold_when_ranges_are_worked_out_twice_from_rows_in_another_order(spark):
    def mixed(batches):
        import pyarrow as pa

        rows = pa.Table.from_batches(list(batches)).combine_chunks().to_pylist()
        random.SystemRandom().shuffle(rows)
        yield pa.RecordBatch.from_pylist(rows)

    session = spark.newSession()
    session.conf.set("spark.sql.exchange.reuse", "false")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    rows = session.range(0, 120_000, 1, 1).select(F.lit("x").alias("column"), (F.hash("id") / F.lit(100.0)).alias("value"), F.lit(1).cast("long").alias("n"))
    placed = below(rows.mapInArrow(mixed, "column string, value double, n long"), ["column"]).select("value", "below")
    got = [r["below"] for r in placed.sort("value").collect()]
    assert got == list(range(120_000))
