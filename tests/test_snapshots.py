"""Versioned result tables: scopes, failures between write and publish, two writers, and what is deleted."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.sources import store
from tidemark.sources.snapshots import Conflict, ResultTable

SCHEMA = "org_id string, dataset_id string, metric string, bucket date, value double"
SALES, VISITS, OTHER = ("a", "d", "sales"), ("a", "d", "visits"), ("b", "d", "sales")


def rows(spark, *items):
    return spark.createDataFrame([(*scope, date(2024, 3, day) if day else None, float(v)) for scope, day, v in items], SCHEMA)


def content(table, **which):
    return sorted(((r["org_id"], r["metric"], r["bucket"] and r["bucket"].day, r["value"]) for r in table.read(**which).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    t = ResultTable(spark, str(tmp_path / "results"), SCHEMA)
    assert t.read().count() == 0 and t.versions() == []
    t.replace_all(rows(spark, (SALES, 1, 10), (SALES, 2, 20), (SALES, None, 5), (VISITS, 1, 7), (OTHER, 1, 3)))
    return t


def test_scopes_are_replaced_also_by_nothing(spark, table):
    table.replace_all(rows(spark, (SALES, 9, 90)))
    assert content(table) == [("a", "sales", 9, 90.0), ("a", "visits", 1, 7.0), ("b", "sales", 1, 3.0)]
    table.replace_all(rows(spark), [SALES])
    assert content(table) == [("a", "visits", 1, 7.0), ("b", "sales", 1, 3.0)]
    assert content(table, org="b") == [("b", "sales", 1, 3.0)] and content(table, version=1)[0] == ("a", "sales", 1, 10.0)
    with pytest.raises(ValueError, match="other scopes"):
        table.replace_all(rows(spark, (VISITS, 1, 1)), [SALES])
    assert table.versions() == [1, 2, 3]


def test_ranges_keep_what_lies_outside_and_what_has_no_date(spark, table):
    table.replace_range(rows(spark, (SALES, 2, 21), (SALES, 4, 40)), SALES)
    assert content(table, org="a") == [("a", "sales", 1, 10.0), ("a", "sales", 2, 21.0), ("a", "sales", 4, 40.0), ("a", "sales", None, 5.0), ("a", "visits", 1, 7.0)]
    assert table.replace_range(rows(spark), SALES) is None
    table.replace_range(rows(spark), SALES, date(2024, 3, 2), date(2024, 3, 4))
    assert content(table, org="a") == [("a", "sales", 1, 10.0), ("a", "sales", None, 5.0), ("a", "visits", 1, 7.0)]


def test_a_failure_before_publishing_leaves_the_old_rows(spark, table):
    before = content(table)

    def fail():
        raise RuntimeError("lost")

    for change in (lambda: table.replace_all(rows(spark, (SALES, 9, 90)), before_publish=fail), lambda: table.replace_range(rows(spark, (SALES, 1, 90)), SALES, before_publish=fail), lambda: table.append(rows(spark, (SALES, 9, 90)), before_publish=fail)):
        with pytest.raises(RuntimeError, match="lost"):
            change()
        assert content(table) == before and table.versions() == [1]
    assert table.vacuum(keep=1) == 3 and content(table) == before  # what was written and never published goes


def test_the_later_of_two_writers_loses(spark, table):
    other = ResultTable(spark, table.path, SCHEMA)
    with pytest.raises(Conflict):
        table.replace_all(rows(spark, (SALES, 9, 90)), before_publish=lambda: other.append(rows(spark, (VISITS, 2, 8))))
    assert ("a", "visits", 2, 8.0) in content(table) and ("a", "sales", 1, 10.0) in content(table) and len(content(table)) == 6


def test_readers_of_an_old_version_go_on_until_it_is_vacuumed(spark, table):
    old = table.read()
    table.replace_all(rows(spark), [SALES])
    table.replace_all(rows(spark, (OTHER, 5, 4)))
    assert old.count() == 5
    assert table.vacuum(keep=1) == 2 and table.versions() == [3]
    assert content(table) == [("a", "visits", 1, 7.0), ("b", "sales", 5, 4.0)]


def test_only_an_organisations_folders_are_read(spark, table):
    files = {f.rsplit("/", 2)[1] for f in table.read("b").inputFiles()}
    assert len(files) == 1 and len({f.rsplit("/", 2)[1] for f in table.read().inputFiles()}) == 3


def test_saved_results_are_those_of_the_newest_version(spark, tmp_path):
    path = str(tmp_path / "saved")
    store.save(rows(spark, (SALES, 1, 1), (VISITS, 1, 2)), path)
    store.save(rows(spark, (SALES, 2, 3)), path)
    store.save(rows(spark).filter(F.lit(False)), path, [VISITS])
    assert [r["value"] for r in store.load(spark, path, SCHEMA).collect()] == [3.0]
    with pytest.raises(ValueError, match="lacks"):
        ResultTable(spark, path, "org_id string, bucket date")
