"""Root causes in combinations of dimensions against plain sums over every combination."""

import random
from datetime import date
from itertools import combinations

import pytest

from tidemark.operators import rca_lattice
from tidemark.operators.rca import Analysis
from tidemark.plans.requests import RCARequest

SCHEMA = "day date, amount double, colour string, size string, shop boolean"
DIMS = ["colour", "size", "shop"]
REQUEST = {"event_start": date(2024, 5, 11), "event_end": date(2024, 5, 12), "baseline_start": date(2024, 5, 7), "baseline_end": date(2024, 5, 10), "dimensions": DIMS}


def data(negative: bool, n: int = 3000):
    rng = random.Random(6)
    out = []
    for _ in range(n):
        day, colour, size, shop = rng.randint(7, 12), rng.choice(["red", "blue", "green", None, "a", "a1"]), rng.choice([str(k) for k in range(30)]), rng.choice([True, False, None])
        amount = rng.gammavariate(0.4, 5) * (25 if day > 10 and colour == "red" and size == "3" else 1)
        out.append((date(2024, 5, day), -amount if negative and rng.random() < 0.5 else amount, colour, size, shop))
    return out


def plain(rows, how):
    found = {}
    for day, amount, *values in rows:
        values = ["Unknown" if v is None else str(v) for v in values]
        moved = (amount if how == "sum" else 1) * (1 if day.day > 10 else -0.5)
        for d in (1, 2, 3):
            for own in combinations(range(3), d):
                key = (d, tuple(DIMS[i] for i in own), tuple(values[i] for i in own))
                found[key] = found.get(key, 0) + moved
    return found


@pytest.mark.parametrize(("negative", "how"), [(False, "sum"), (True, "sum"), (False, "count")])
def test_best_segments_are_those_of_all_combinations(spark, negative, how):
    rows = data(negative)
    every = plain(rows, how)
    want = sorted(every.items(), key=lambda x: (-abs(round(x[1], 4)), x[0]))[:12]
    lattice = rca_lattice.search(Analysis(spark.createDataFrame(rows, SCHEMA), RCARequest("day", "amount", aggregation=how, **REQUEST)), 3, 12)
    got = [((r["depth"], tuple(r["dimensions"]), tuple(r["segment"])), r["delta"]) for r in lattice.segments.orderBy("rank").collect()]
    assert [k for k, _ in got] == [k for k, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-4)
    assert [r["rank"] for r in lattice.segments.orderBy("rank").collect()] == list(range(1, 13))
    if not negative:
        made, there = sum(x.made for x in lattice.levels), len(every)
        assert made < 0.6 * there, (made, there)  # combinations that can't reach the top are never made
    assert all(x.open <= x.made for x in lattice.levels)


def test_bounds_and_refusals(spark):
    df = spark.createDataFrame(data(False, 200), SCHEMA)
    few = rca_lattice.search(Analysis(df, RCARequest("day", "amount", **(REQUEST | {"dimensions": ["shop"]}))), 3, 50)
    assert few.segments.count() == 3 and len(few.levels) == 1
    with pytest.raises(ValueError, match="average"):
        rca_lattice.search(Analysis(df, RCARequest("day", "amount", aggregation="avg", **REQUEST)))
    with pytest.raises(ValueError, match="at least 1"):
        rca_lattice.search(Analysis(df, RCARequest("day", "amount", **REQUEST)), 0)
    assert rca_lattice.search(Analysis(df, RCARequest("day", "amount", **REQUEST)), 2, 5).levels[-1].depth == 2


def test_open_segments_joined_by_shuffle_give_the_same(spark, monkeypatch):
    analysis = Analysis(spark.createDataFrame(data(True, 800), SCHEMA), RCARequest("day", "amount", **REQUEST))
    want = [tuple(r) for r in rca_lattice.search(analysis, 3, 15).segments.orderBy("rank").collect()]
    monkeypatch.setattr(rca_lattice, "BROADCAST_ROWS", -1)
    assert [tuple(r) for r in rca_lattice.search(analysis, 3, 15).segments.orderBy("rank").collect()] == want
