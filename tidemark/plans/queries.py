"""The engine's queries over the test tables, each beside the SQL that says what it should give.

Defects that the tables lack (nulls, odd spellings, unreadable text) are put in by expressions that
both sides share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import json_ready, slug
from tidemark.operators import aggregate as agg
from tidemark.operators import anomaly, clean, isolation, neighbours, profile, rca_lattice, references, relational, timeseries
from tidemark.operators import filters as filt
from tidemark.operators.file_profiles import FileProfiles
from tidemark.operators.heavy_hitters import heavy_hitters
from tidemark.operators.forecast import fit, forecast, forecast_series, with_band
from tidemark.operators.rca import Analysis
from tidemark.operators.rca import date_column as rca_date_column
from tidemark.plans.requests import AggregationQuery, AnomalyRequest, BreakdownQuery, CrossTabQuery, Filter, ForecastRequest, Metric, RCARequest, TimeSeriesQuery
from tidemark.sources import store
from tidemark.sources.scratch import folder
from tidemark.sources.snapshots import ResultTable
from tidemark.sources.tables import ingest, open_dataset, read_csv, read_table, read_workbooks, write_clean, write_raw
from tidemark.streaming import windows as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Select lists that Spark and the oracle share.
ORDERS = (
    "o_orderkey AS order_id, o_custkey AS customer_id, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderstatus END AS status, o_orderpriority AS priority, "
    "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_totalprice END AS total_amount, CAST(o_orderdate AS DATE) AS order_date"
)
DIRTY = (
    "o_orderkey AS order_id, CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN upper(o_orderpriority) WHEN o_orderkey % 7 = 0 THEN concat(' ', lower(o_orderpriority), ' ') ELSE o_orderpriority END AS priority, "
    "CASE WHEN o_orderkey % 47 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 'about ten' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS amount_text, "
    "CASE WHEN o_orderkey % 59 = 0 THEN 'no date' WHEN o_orderkey % 61 = 0 THEN '1800-01-01' WHEN o_orderkey % 2 = 0 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/') ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date, "
    "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 67 = 0 THEN 'CUST9999' WHEN o_orderkey % 71 = 0 THEN NULL ELSE concat('CUST', CAST(o_custkey AS STRING)) END AS customer_id, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'No' END AS gift"
)
EVENTS = "event_id, ts, event_type, CAST(user_id % 40 AS STRING) AS cohort, value, CAST(user_id AS DOUBLE) AS load"
PARTS = "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_size END AS size, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_retailprice END AS price, CAST(p_partkey AS DOUBLE) AS part, 0.1 AS flat"


def _columns(select: str) -> list[str]:
    """The expressions of a select list, split at commas outside brackets."""
    out, depth, now = [], 0, ""
    for ch in select:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def _orders(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "orders").selectExpr(*_columns(ORDERS))


def _dirty(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "orders").selectExpr(*_columns(DIRTY))


def _events(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "events").selectExpr(*_columns(EVENTS))


def _parts(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "part").selectExpr(*_columns(PARTS)).withColumn("flat", F.lit(0.1).cast("double"))


def _lineitem(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "lineitem")


def add(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql.replace("{O}", f"(SELECT {ORDERS} FROM orders)").replace("{D}", f"(SELECT {DIRTY} FROM orders)").replace("{E}", f"(SELECT {EVENTS} FROM events)").replace("{P}", f"(SELECT {PARTS} FROM part)")


# --- filters: all rows that match, as keys
_MATCHES = {
    "eq": (Filter("status", "eq", "F"), "status = 'F'"),
    "neq": (Filter("status", "neq", "F"), "status <> 'F' OR status IS NULL"),
    "gt": (Filter("total_amount", "gt", 200000), "total_amount > 200000"),
    "gte": (Filter("total_amount", "gte", "200000.5"), "total_amount >= 200000.5"),
    "lt": (Filter("total_amount", "lt", 50000), "total_amount < 50000"),
    "lte": (Filter("total_amount", "lte", 50000), "total_amount <= 50000"),
    "in": (Filter("priority", "in", ["1-URGENT", "5-LOW"]), "priority IN ('1-URGENT', '5-LOW')"),
    "between": (Filter("total_amount", "between", [90000, 50000]), "total_amount BETWEEN 50000 AND 90000"),
}
for _op, (_f, _where) in _MATCHES.items():
    add(f"filt_{_op}", lambda s, d, f=_f: filt.apply_filters(_orders(s, d), [f]), f"SELECT * FROM {{O}} WHERE {_where}")
add("filt_datewin", lambda s, d: filt.date_window(_orders(s, d), "order_date", date(1997, 3, 1), date(1997, 9, 30)), "SELECT * FROM {O} WHERE order_date BETWEEN DATE '1997-03-01' AND DATE '1997-09-30'")
add(
    "filt_valid",
    lambda s, d: filt.valid_rows(_dirty(s, d), "order_date", "amount_text").select("order_id"),
    "SELECT order_id FROM {D} WHERE TRY_CAST(replace(order_date, '/', '-') AS DATE) IS NOT NULL AND TRY_CAST(amount_text AS DOUBLE) IS NOT NULL",
)
add(
    "filt_conjunction",
    lambda s, d: filt.apply_filters(_orders(s, d), [Filter("status", "eq", "O"), Filter("total_amount", "gt", 100000), Filter("priority", "neq", "5-LOW")]),
    "SELECT * FROM {O} WHERE status = 'O' AND total_amount > 100000 AND (priority <> '5-LOW' OR priority IS NULL)",
)

# --- aggregation
_FUNCS = [Metric("l_quantity", "sum"), Metric("l_extendedprice", "mean"), Metric("l_extendedprice", "median"), Metric("l_extendedprice", "min"), Metric("l_extendedprice", "max"), Metric("l_quantity", "std"), Metric("l_tax", "count")]
_FUNCS_SQL = "round(sum(l_quantity), 4) AS l_quantity_sum, round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(median(l_extendedprice), 4) AS l_extendedprice_median, round(min(l_extendedprice), 4) AS l_extendedprice_min, round(max(l_extendedprice), 4) AS l_extendedprice_max, round(stddev_samp(l_quantity), 4) AS l_quantity_std, "
add("agg_scalar", lambda s, d: agg.aggregate(_lineitem(s, d), AggregationQuery(_FUNCS)), f"SELECT {_FUNCS_SQL} CAST(count(l_tax) AS DOUBLE) AS l_tax_count FROM lineitem")
add("agg_all_functions", lambda s, d: agg.aggregate(_lineitem(s, d), AggregationQuery(_FUNCS, ["l_returnflag"])), f"SELECT l_returnflag, {_FUNCS_SQL} count(l_tax) AS l_tax_count FROM lineitem GROUP BY l_returnflag")
add(
    "agg_group_2d",
    lambda s, d: agg.aggregate(_lineitem(s, d), AggregationQuery([Metric("l_extendedprice", "sum", "revenue")], ["l_returnflag", "l_linestatus"], [Filter("l_discount", "gte", 0.05)])),
    "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 4) AS revenue FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL",
)
add(
    "agg_null_group",
    lambda s, d: agg.aggregate(_orders(s, d), AggregationQuery([Metric("total_amount", "sum"), Metric("total_amount", "count")], ["status"])),
    "SELECT status, round(coalesce(sum(total_amount), 0), 4) AS total_amount_sum, count(total_amount) AS total_amount_count FROM {O} GROUP BY status",
)
add("agg_text_count", lambda s, d: agg.aggregate(_orders(s, d), AggregationQuery([Metric("status", "count")], ["priority"])), "SELECT priority, count(status) AS status_count FROM {O} GROUP BY priority")
add(
    "agg_text_minmax",
    lambda s, d: agg.aggregate(_dirty(s, d), AggregationQuery([Metric("amount_text", "min"), Metric("amount_text", "max")], ["gift"])),
    "SELECT gift, round(min(TRY_CAST(amount_text AS DOUBLE)), 4) AS amount_text_min, round(max(TRY_CAST(amount_text AS DOUBLE)), 4) AS amount_text_max FROM {D} GROUP BY gift",
)
add("agg_empty", lambda s, d: agg.aggregate(_orders(s, d), AggregationQuery([Metric("total_amount", "sum")], [], [Filter("status", "eq", "none")])), "SELECT round(sum(total_amount), 4) AS total_amount_sum FROM {O} WHERE status = 'none' HAVING count(*) > 0")
_BY_CUSTOMER = [Metric("total_amount", "sum"), Metric("order_id", "count")]
add(
    "page_offset_limit",
    lambda s, d: agg.aggregate(_orders(s, d), AggregationQuery(_BY_CUSTOMER, ["customer_id"], limit=50, offset=25)),
    "SELECT customer_id, round(coalesce(sum(total_amount), 0), 4) AS total_amount_sum, count(order_id) AS order_id_count FROM {O} GROUP BY customer_id ORDER BY 2 DESC NULLS LAST, customer_id LIMIT 50 OFFSET 25",
)
add(
    "sort_asc_nulls_last",
    lambda s, d: agg.aggregate(_orders(s, d), AggregationQuery([Metric("total_amount", "max")], ["status", "priority"], sort_by="status", descending=False, limit=7)),
    "SELECT status, priority, round(max(total_amount), 4) AS total_amount_max FROM {O} GROUP BY ALL ORDER BY status ASC NULLS LAST, priority ASC NULLS LAST LIMIT 7",
)
add("total_rows", lambda s, d: agg.total_rows(_orders(s, d), AggregationQuery(_BY_CUSTOMER, ["customer_id"])), "SELECT count(DISTINCT customer_id) AS total_rows FROM {O}")
add(
    "rollup",
    lambda s, d: agg.rollup(_lineitem(s, d), ["l_returnflag", "l_linestatus"], [Metric("l_quantity", "sum")]),
    "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, round(sum(l_quantity), 4) AS l_quantity_sum FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
add(
    "cube",
    lambda s, d: agg.rollup(_lineitem(s, d), ["l_returnflag", "l_linestatus"], [Metric("l_quantity", "sum")], cube=True),
    "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, round(sum(l_quantity), 4) AS l_quantity_sum FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)

# --- overview
def _overview_sql(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(coalesce(sum({c}), 0), 4)::DOUBLE AS sum, round(avg({c}), 4) AS mean, round(median({c}), 4)::DOUBLE AS median, round(min({c}), 4)::DOUBLE AS min, round(max({c}), 4)::DOUBLE AS max, round(coalesce(stddev_samp({c}), 0), 4) AS std FROM {table}" for c in names
    )


add("overview_numeric", lambda s, d: agg.overview_numeric(_orders(s, d)), _overview_sql("{O}", ["order_id", "customer_id", "total_amount"]))
add("overview_temporal", lambda s, d: agg.overview_temporal(_orders(s, d)), "SELECT 'order_date' AS date_column, min(order_date) AS min_date, max(order_date) AS max_date, CAST(max(order_date) - min(order_date) AS INTEGER) AS range_days FROM {O}")
_TOP_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {{T}} WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("status", "priority"))
add(
    "overview_top_dims",
    lambda s, d: agg.top_categories(_orders(s, d), agg.categorical_columns(_orders(s, d))),
    f"WITH c AS ({_TOP_SQL.replace('{T}', '{O}')}), r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY \"column\") * 100, 2) AS pct, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 10",
)

# --- breakdown
_BREAK = "WITH g AS (SELECT CAST({k} AS STRING) AS category, round(CAST({v} AS DOUBLE), 4) AS value FROM {t} WHERE {k} IS NOT NULL GROUP BY 1), t AS (SELECT sum(value) AS total FROM g), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, category) AS k FROM g), "
_BREAK_TOP = _BREAK + "o AS (SELECT category, value FROM r WHERE k <= {n}) SELECT category, value, round(value / greatest(1e-9, total) * 100, 2) AS pct FROM o, t"
_BREAK_OTHER = _BREAK + "o AS (SELECT CASE WHEN k <= {n} THEN category ELSE 'Other' END AS category, round(sum(value), 4) AS value FROM r GROUP BY 1) SELECT category, value, round(value / greatest(1e-9, total) * 100, 2) AS pct FROM o, t"


def _break(sql: str, k: str, v: str, t: str, n: int) -> str:
    return sql.replace("{k}", k).replace("{v}", v).replace("{t}", t).replace("{n}", str(n))


add("breakdown_count", lambda s, d: agg.breakdown(_orders(s, d), BreakdownQuery("status")), _break(_BREAK_TOP, "status", "count(*)", "{O}", 10))
add("breakdown_sum", lambda s, d: agg.breakdown(_orders(s, d), BreakdownQuery("priority", Metric("total_amount", "sum"), top_n=3)), _break(_BREAK_TOP, "priority", "sum(total_amount)", "{O}", 3))
add("breakdown_other", lambda s, d: agg.breakdown(_orders(s, d), BreakdownQuery("customer_id", Metric("total_amount", "sum"), top_n=20, include_other=True)), _break(_BREAK_OTHER, "customer_id", "coalesce(sum(total_amount), 0)", "{O}", 20))
add("breakdown_mean", lambda s, d: agg.breakdown(_lineitem(s, d), BreakdownQuery("l_returnflag", Metric("l_extendedprice", "mean"))), _break(_BREAK_TOP, "l_returnflag", "avg(l_extendedprice)", "lineitem", 10))

# --- crosstab
def _cross_sql(v: str, t: str, r: str, c: str) -> str:
    return f"WITH k AS (SELECT * FROM {t} WHERE {r} IS NOT NULL AND {c} IS NOT NULL), v AS (SELECT {r} AS \"row\", {c} AS \"column\", round(CAST({v} AS DOUBLE), 4) AS value FROM k GROUP BY 1, 2) SELECT a.\"row\", b.\"column\", coalesce(value, 0.0) AS value FROM (SELECT DISTINCT {r} AS \"row\" FROM k) a CROSS JOIN (SELECT DISTINCT {c} AS \"column\" FROM k) b LEFT JOIN v USING (\"row\", \"column\")"


add("crosstab_count", lambda s, d: agg.crosstab(_orders(s, d), CrossTabQuery("status", "priority")), _cross_sql("count(*)", "{O}", "status", "priority"))
add("crosstab_sum", lambda s, d: agg.crosstab(_lineitem(s, d), CrossTabQuery("l_returnflag", "l_linestatus", Metric("l_extendedprice", "sum"))), _cross_sql("sum(l_extendedprice)", "lineitem", "l_returnflag", "l_linestatus"))
add("crosstab_mean", lambda s, d: agg.crosstab(_orders(s, d), CrossTabQuery("status", "priority", Metric("total_amount", "mean"))), _cross_sql("avg(total_amount)", "{O}", "status", "priority"))

# --- correlation
def _corr_sql(table: str, names: list[str], spearman: bool = False) -> str:
    rows = []
    for x in names:
        for y in names:
            if x == y:
                rows.append(f"SELECT '{x}' AS x, '{x}' AS y, CASE WHEN max({x}) <> min({x}) THEN 1.0::DOUBLE END AS value FROM {table}")
                continue
            src = f"(SELECT {x}::DOUBLE AS a, {y}::DOUBLE AS b FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
            if spearman:
                src = f"(SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS b FROM {src})"
            rows.append(f"SELECT '{x}', '{y}', CASE WHEN max(a) <> min(a) AND max(b) <> min(b) THEN round(covar_samp(a, b) / sqrt(var_samp(a) * var_samp(b)), 4) END FROM {src}")
    return " UNION ALL ".join(rows)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add("corr_pearson", lambda s, d: agg.correlation(_lineitem(s, d), _LINE), _corr_sql("lineitem", _LINE))
add("corr_pairwise_nulls", lambda s, d: agg.correlation(_parts(s, d), ["size", "price", "part"]), _corr_sql("{P}", ["size", "price", "part"]))
add("corr_zero_variance", lambda s, d: agg.correlation(_parts(s, d), ["part", "flat"]), _corr_sql("{P}", ["part", "flat"]))
add("corr_spearman", lambda s, d: agg.correlation(_parts(s, d), ["size", "price", "part"], "spearman"), _corr_sql("{P}", ["size", "price", "part"], True))

# --- time series
_LABEL = {"day": "order_date", "week": "CAST(date_trunc('week', order_date - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE)", **{g: f"CAST(date_trunc('{g}', order_date) AS DATE)" for g in ("month", "quarter", "year")}}


def _series_sql(granularity: str, how: str = "sum(total_amount)", table: str = "{O}") -> str:
    every = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}[granularity]
    return f"b AS (SELECT {_LABEL[granularity]} AS bucket, {how} AS v FROM {table} GROUP BY 1), z AS (SELECT CAST(unnest(generate_series((SELECT min(bucket) FROM b)::TIMESTAMP, (SELECT max(bucket) FROM b)::TIMESTAMP, INTERVAL {every})) AS DATE) AS bucket), p AS (SELECT bucket AS timestamp, CAST(coalesce(v, 0) AS DOUBLE) AS v FROM z LEFT JOIN b USING (bucket))"


for _g in ("day", "week", "month", "quarter", "year"):
    add(f"ts_{_g}", lambda s, d, g=_g: timeseries.time_series(_orders(s, d), TimeSeriesQuery("order_date", Metric("total_amount", "sum"), g)), f"WITH {_series_sql(_g)} SELECT timestamp, round(v, 4) AS value FROM p")
add(
    "ts_rolling",
    lambda s, d: timeseries.time_series(_orders(s, d), TimeSeriesQuery("order_date", Metric("total_amount", "sum"), "week", rolling=4)),
    f"WITH {_series_sql('week')} SELECT timestamp, round(v, 4) AS value, round(avg(v) OVER (ORDER BY timestamp ROWS 3 PRECEDING), 4) AS rolling_avg FROM p",
)
add(
    "ts_cumulative",
    lambda s, d: timeseries.time_series(_orders(s, d), TimeSeriesQuery("order_date", Metric("total_amount", "sum"), "month", cumulative=True)),
    f"WITH {_series_sql('month')} SELECT timestamp, round(v, 4) AS value, round(sum(v) OVER (ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM p",
)
add(
    "ts_growth",
    lambda s, d: timeseries.time_series(_orders(s, d), TimeSeriesQuery("order_date", Metric("order_id", "count"), "day", growth=True)),
    f"WITH {_series_sql('day', 'count(order_id)')} SELECT timestamp, round(v, 4) AS value, round((v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) * 100, 2) AS growth_pct FROM p WINDOW w AS (ORDER BY timestamp)",
)
add("ts_text_dates", lambda s, d: timeseries.time_series(_dirty(s, d), TimeSeriesQuery("order_date", Metric("price", "mean"), "year")), "WITH " + _series_sql("year", "avg(price)", "(SELECT price, TRY_CAST(replace(order_date, '/', '-') AS DATE) AS order_date FROM {D} WHERE TRY_CAST(replace(order_date, '/', '-') AS DATE) IS NOT NULL)") + " SELECT timestamp, round(v, 4) AS value FROM p")
add("prep_sum_zero_fill", lambda s, d: timeseries.prepare_series(_orders(s, d), "order_date", "total_amount").withColumn("value", F.round("value", 4)), f"WITH {_series_sql('day', 'sum(total_amount)', '(SELECT * FROM {O} WHERE total_amount IS NOT NULL)')} SELECT timestamp AS bucket, round(v, 4) AS value FROM p")
_MEAN_DAYS = _series_sql("day", "avg(total_amount)", "(SELECT * FROM {O} WHERE total_amount IS NOT NULL)").replace("CAST(coalesce(v, 0) AS DOUBLE)", "v")
add(
    "prep_mean_interpolate",
    lambda s, d: timeseries.prepare_series(_orders(s, d), "order_date", "total_amount", "mean").withColumn("value", F.round("value", 6)),
    f"WITH {_MEAN_DAYS}, k AS (SELECT timestamp, v, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN v IS NOT NULL THEN timestamp END IGNORE NULLS) OVER b AS d0, first_value(CASE WHEN v IS NOT NULL THEN timestamp END IGNORE NULLS) OVER a AS d1 FROM p WINDOW b AS (ORDER BY timestamp ROWS UNBOUNDED PRECEDING), a AS (ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT timestamp AS bucket, round(coalesce(v, v0 + (v1 - v0) * (timestamp - d0) / (d1 - d0)), 6) AS value FROM k",
)

# --- profile
_KINDS = {"order_id": "identifier", "priority": "categorical", "amount_text": "numeric", "order_date": "datetime", "price": "numeric", "customer_id": "identifier", "gift": "boolean"}
add(
    "prof_base",
    lambda s, d: profile.profile_columns(_dirty(s, d)),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS classification, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, count(DISTINCT {c}) AS distinct_count, round(count(DISTINCT {c}) / count({c}) * 100, 2) AS distinct_pct FROM {{D}}" for c, k in _KINDS.items()
    ),
)
_N = "TRY_CAST({c} AS DOUBLE)"
add(
    "prof_numeric",
    lambda s, d: profile.profile_numeric(_dirty(s, d), ["amount_text", "price"]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(min(n), 4) AS min, round(max(n), 4) AS max, round(avg(n), 4) AS mean, round(median(n), 4) AS median, round(stddev_samp(n), 4) AS std, round(quantile_cont(n, 0.25), 4) AS p25, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.75), 4) AS p75, bool_and(n = floor(n)) AS is_integer, count({c}) - count(n) AS inconsistent FROM (SELECT {c}, TRY_CAST({c} AS DOUBLE) AS n FROM {{D}})"
        for c in ("amount_text", "price")
    ),
)
add("prof_categorical", lambda s, d: profile.profile_categories(_dirty(s, d), ["priority"]), "WITH c AS (SELECT 'priority' AS \"column\", priority AS value, count(*) AS n FROM {D} WHERE priority IS NOT NULL GROUP BY priority), r AS (SELECT *, round(n / sum(n) OVER () * 100, 2) AS pct, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
add(
    "prof_datetime",
    lambda s, d: profile.profile_datetime(_dirty(s, d), "order_date"),
    "SELECT 'order_date' AS \"column\", min(x) AS min_date, max(x) AS max_date, CAST(max(x) - min(x) AS INTEGER) AS range_days, count(order_date) - count(x) AS invalid FROM (SELECT order_date, CASE WHEN year(y) BETWEEN 1900 AND 2099 THEN y END AS x FROM (SELECT order_date, TRY_CAST(replace(order_date, '/', '-') AS DATE) AS y FROM {D}))",
)
add(
    "prof_suspicious",
    lambda s, d: profile.suspicious(read_table(s, d, "customer").withColumn("account_balance", F.col("c_acctbal")), ["c_acctbal", "account_balance"]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({neg} AS BIGINT) AS negatives, count(*) FILTER (abs(c_acctbal - m) > 5 * s) AS extremes, CAST({neg} AS BIGINT) + count(*) FILTER (abs(c_acctbal - m) > 5 * s) AS suspicious FROM customer, (SELECT round(avg(c_acctbal), 4) AS m, round(stddev_samp(c_acctbal), 4) AS s FROM customer)"
        for c, neg in (("c_acctbal", "0"), ("account_balance", "count(*) FILTER (c_acctbal < 0)"))
    ),
)
add("prof_duplicates", lambda s, d: profile.duplicate_rows(_orders(s, d).select("status", "priority", "order_date")), "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) / sum(n) * 100, 2) AS duplicate_pct FROM (SELECT count(*) AS n FROM {O} GROUP BY status, priority, order_date)")
add(
    "prof_score",
    lambda s, d: profile.quality_score(_dirty(s, d)),
    "WITH n AS (SELECT count(*) AS r, 7 * count(*) AS cells, " + " + ".join(f"(count(*) - count({c}))" for c in _KINDS) + " AS missing, count(amount_text) - count(a) AS odd, count(order_date) AS dates, count(order_date) - count(CASE WHEN year(y) BETWEEN 1900 AND 2099 THEN 1 END) AS bad, count(a) + count(price) AS numbers, count(*) FILTER (a < 0) + count(*) FILTER (price < 0) + count(*) FILTER (abs(a - ma) > 5 * sa) + count(*) FILTER (abs(price - mp) > 5 * sp) AS far FROM (SELECT *, TRY_CAST(amount_text AS DOUBLE) AS a, TRY_CAST(replace(order_date, '/', '-') AS DATE) AS y FROM {D}), (SELECT round(avg(TRY_CAST(amount_text AS DOUBLE)), 4) AS ma, round(stddev_samp(TRY_CAST(amount_text AS DOUBLE)), 4) AS sa, round(avg(price), 4) AS mp, round(stddev_samp(price), 4) AS sp FROM {D})), "
    "c AS (SELECT 100 * (1 - missing / cells) AS a, 100.0::DOUBLE AS b, 100 * (1 - odd / cells) AS t, 100 * (1 - bad / dates) AS v, 100 * (1 - far / numbers) AS w FROM n), s AS (SELECT *, round(0.30 * a + 0.25 * b + 0.20 * t + 0.15 * v + 0.10 * w, 1) AS score FROM c) "
    "SELECT score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 50 THEN 'Fair' ELSE 'Poor' END AS grade, round(a, 1) AS completeness, b AS uniqueness, round(t, 1) AS type_consistency, round(v, 1) AS date_validity, round(w, 1) AS reasonableness FROM s",
)

# --- cleaning
add("clean_dedup", lambda s, d: clean.drop_duplicates(_orders(s, d).select("status", "priority")), "SELECT DISTINCT status, priority FROM {O}")
for _how, _value in (("median", "(SELECT round(median(price), 4) FROM {D})"), ("mean", "(SELECT round(avg(price), 4) FROM {D})"), ("zero", "0.0::DOUBLE")):
    add(f"clean_{_how}", lambda s, d, how=_how: clean.impute_number(_dirty(s, d).select("order_id", "price"), "price", how), f"SELECT order_id, coalesce(price, {_value}) AS price FROM {{D}}")
add("clean_mode", lambda s, d: clean.impute_category(_dirty(s, d).select("order_id", "priority"), "priority", "mode"), "SELECT order_id, coalesce(priority, (SELECT priority FROM {D} WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM {D}")
add("clean_unknown", lambda s, d: clean.impute_category(_dirty(s, d).select("order_id", "priority"), "priority", "unknown"), "SELECT order_id, coalesce(priority, 'Unknown') AS priority FROM {D}")
add(
    "clean_casing",
    lambda s, d: clean.normalize_categories(_dirty(s, d).select("order_id", "priority"), "priority"),
    "WITH f AS (SELECT lower(trim(priority)) AS k, trim(priority) AS form, count(*) AS n FROM {D} WHERE priority IS NOT NULL GROUP BY 1, 2), b AS (SELECT k, first(form ORDER BY n DESC, form) AS best FROM f GROUP BY k) SELECT order_id, best AS priority FROM {D} LEFT JOIN b ON lower(trim(priority)) = k",
)
add("clean_date_iso", lambda s, d: clean.iso_dates(_dirty(s, d).select("order_id", "order_date"), "order_date"), "SELECT order_id, CAST(TRY_CAST(replace(order_date, '/', '-') AS DATE) AS STRING) AS order_date FROM {D}")
add("clean_numcast", lambda s, d: clean.cast_report(_dirty(s, d), "amount_text", "number"), "SELECT 'amount_text' AS \"column\", count(TRY_CAST(amount_text AS DOUBLE)) AS success, count(amount_text) - count(TRY_CAST(amount_text AS DOUBLE)) AS failure FROM {D}")
add("clean_datecast", lambda s, d: clean.cast_report(_dirty(s, d), "order_date", "date"), "SELECT 'order_date' AS \"column\", count(TRY_CAST(replace(order_date, '/', '-') AS DATE)) AS success, count(order_date) - count(TRY_CAST(replace(order_date, '/', '-') AS DATE)) AS failure FROM {D}")
_BOUNDS = "(SELECT round(q1 - (q3 - q1) * 1.5, 4) AS lo, round(q3 + (q3 - q1) * 1.5, 4) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"
add("clean_outlier_report", lambda s, d: clean.outlier_report(read_table(s, d, "events"), "value"), f"SELECT 'value' AS \"column\", max(lo) AS lower, max(hi) AS upper, count(*) FILTER (value < lo OR value > hi) AS outliers, count(*) FILTER (value < 0) AS negatives, count(*) FILTER (value < 0) AS invalid FROM events, {_BOUNDS.replace('{c}', 'value').replace('{t}', 'events')}")
add("clean_cap", lambda s, d: clean.cap_outliers(read_table(s, d, "events").select("event_id", "value"), "value").withColumn("value", F.round("value", 4)), f"SELECT event_id, round(least(greatest(value, lo), hi), 4) AS value FROM events, {_BOUNDS.replace('{c}', 'value').replace('{t}', 'events')}")
add("clean_negative", lambda s, d: clean.outlier_report(read_table(s, d, "supplier"), "s_acctbal").select("column", "negatives"), "SELECT 's_acctbal' AS \"column\", count(*) FILTER (s_acctbal < 0) AS negatives FROM supplier")
add("clean_ref_audit", lambda s, d: clean.reference_audit(_dirty(s, d), "customer_id"), "SELECT 'customer_id' AS \"column\", count(*) - count(customer_id) AS missing, count(*) FILTER (regexp_matches(customer_id, '(9999|unknown|dummy|temp|null|test)', 'i')) AS placeholders FROM {D}")
add("clean_preview", lambda s, d: clean.preview(_dirty(s, d)).select("column", "missing", "missing_pct"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct FROM {{D}}" for c in _KINDS))
add(
    "clean_preview_actions",
    lambda s, d: clean.preview(_dirty(s, d)).select("column", "actions"),
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, concat_ws(',', {acts}) AS actions FROM {{D}} HAVING count(*) >= 0"
        for c, kind in _KINDS.items()
        for filled in [f"CASE WHEN count(*) > count({c}) THEN 'impute' END"]
        for acts in [{"numeric": f"{filled}, {chr(39) + 'convert' + chr(39) if c.endswith('text') else 'NULL'}", "categorical": f"{filled}, 'unify'", "datetime": "'convert'"}.get(kind, "NULL")]
    ),
)
_WITH_REPEATS = "(SELECT * FROM {D} UNION ALL SELECT * FROM {D} WHERE order_id % 50 = 3)"


def _repeated(s: SparkSession, d: str) -> DataFrame:
    return _dirty(s, d).unionByName(_dirty(s, d).filter("order_id % 50 = 3"))


add(
    "clean_preview_summary",
    lambda s, d: clean.preview_summary(_repeated(s, d)).withColumn("columns_to_modify", F.array_join("columns_to_modify", ",")),
    f"SELECT count(*) AS rows_before, (SELECT count(*) FROM {{D}}) AS rows_after, count(*) - (SELECT count(*) FROM {{D}}) AS duplicates, round((count(*) - (SELECT count(*) FROM {{D}})) / count(*) * 100, 2) AS duplicate_pct, 'amount_text,order_date,price,priority' AS columns_to_modify FROM {_WITH_REPEATS}",
)


def _clean_saved(s: SparkSession, d: str) -> DataFrame:
    """The report of a cleaning that was written, and how many rows are there."""
    base = _folder(s, "cleaned")
    told = clean.clean_and_save(_repeated(s, d), base, "org1", "ds1")
    there = s.read.parquet(f"{base}/org1/ds1/clean").agg(F.count(F.lit(1)).alias("written"))
    return told.join(F.broadcast(there)).select("rows_before", "rows_after", "duplicates_removed", F.array_join("columns_modified", ",").alias("columns_modified"), (F.col("elapsed_ms") > 0).alias("timed"), "location", "written")


add(
    "clean_apply",
    _clean_saved,
    f"SELECT count(*) AS rows_before, (SELECT count(*) FROM {{D}}) AS rows_after, count(*) - (SELECT count(*) FROM {{D}}) AS duplicates_removed, 'amount_text,order_date,price,priority' AS columns_modified, true AS timed, 'org1/ds1/clean' AS location, (SELECT count(*) FROM {{D}}) AS written FROM {_WITH_REPEATS}",
)
add(
    "clean_report",
    lambda s, d: clean.clean(_dirty(s, d))[1].filter("step <> 'outliers'"),
    "WITH t AS (SELECT count(*) AS n, count(priority) AS p, count(amount_text) AS k, count(TRY_CAST(amount_text AS DOUBLE)) AS a, count(price) AS c, count(order_date) AS o, count(TRY_CAST(replace(order_date, '/', '-') AS DATE)) AS d, count(customer_id) AS i, count(*) FILTER (regexp_matches(customer_id, '9999')) AS r, count(*) FILTER (regexp_matches(CAST(order_id AS VARCHAR), '9999')) AS q FROM {D}) "
    "SELECT 'dedup' AS step, NULL::VARCHAR AS column, 'exact duplicates dropped' AS detail UNION ALL SELECT 'convert', 'amount_text', a || ' numbers, ' || (k - a) || ' failures' FROM t UNION ALL SELECT 'nulls', 'amount_text', (n - a) || ' filled by median' FROM t UNION ALL SELECT 'nulls', 'price', (n - c) || ' filled by median' FROM t UNION ALL SELECT 'nulls', 'priority', (n - p) || ' filled by mode' FROM t "
    "UNION ALL SELECT 'categories', 'priority', 'spellings unified' UNION ALL SELECT 'convert', 'order_date', d || ' dates, ' || (o - d) || ' failures' FROM t UNION ALL SELECT 'nulls', 'customer_id', (n - i) || ' nulls left in identifier' FROM t UNION ALL SELECT 'references', 'order_id', '0 missing, ' || q || ' placeholders' FROM t UNION ALL SELECT 'references', 'customer_id', (n - i) || ' missing, ' || r || ' placeholders' FROM t",
)
add(
    "clean_pipeline",
    lambda s, d: clean.clean(_dirty(s, d))[0],
    "WITH m AS (SELECT priority AS best FROM {D} WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1), p AS (SELECT d.* REPLACE (coalesce(priority, m.best) AS priority) FROM {D} d, m), "
    "f AS (SELECT lower(trim(priority)) AS k, trim(priority) AS form, count(*) AS n FROM p GROUP BY 1, 2), b AS (SELECT k, first(form ORDER BY n DESC, form) AS best FROM f GROUP BY k), "
    "n AS (SELECT round(median(TRY_CAST(amount_text AS DOUBLE)), 4) AS a, round(median(price), 4) AS p FROM {D}) "
    "SELECT order_id, best AS priority, coalesce(TRY_CAST(amount_text AS DOUBLE), n.a) AS amount_text, CAST(TRY_CAST(replace(order_date, '/', '-') AS DATE) AS STRING) AS order_date, coalesce(price, n.p) AS price, customer_id, gift FROM p JOIN b ON lower(trim(priority)) = k CROSS JOIN n",
)

# --- anomalies: one series for each event type
_Z = """
    b AS (SELECT event_type, CAST(ts AS DATE) AS bucket, sum(value) AS v FROM {E} GROUP BY 1, 2),
    z AS (SELECT event_type, CAST(unnest(generate_series(min(bucket)::TIMESTAMP, max(bucket)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS bucket FROM b GROUP BY event_type),
    p AS (SELECT event_type, bucket, coalesce(v, 0) AS v FROM z LEFT JOIN b USING (event_type, bucket)),
    w AS (SELECT *, CASE WHEN count(v) OVER k >= 3 THEN avg(v) OVER k END AS m, CASE WHEN count(v) OVER k >= 3 THEN stddev_samp(v) OVER k END AS s, stddev_samp(v) OVER (PARTITION BY event_type) AS o, count(*) OVER (PARTITION BY event_type) AS n
        FROM p WINDOW k AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    x AS (SELECT *, first_value(m IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e, greatest(coalesce(s, o), 1e-4) AS d FROM w),
    y AS (SELECT event_type, bucket, round(v, 4) AS value, round(e, 4) AS expected, round((v - e) / d, 4) AS z_score, round((v - e) / greatest(abs(e), 1e-6) * 100, 2) AS deviation_pct, (v - e) / d AS z, (v - e) / greatest(abs(e), 1e-6) * 100 AS dev FROM x WHERE n >= 14 AND o >= 1e-9)
    SELECT event_type, bucket, value, expected, z_score, deviation_pct, CASE WHEN abs(z) >= 4 OR abs(dev) >= 75 THEN 'critical' WHEN abs(z) >= 3 OR abs(dev) >= 50 THEN 'high' WHEN abs(z) >= 2.5 OR abs(dev) >= 25 THEN 'medium' ELSE 'low' END AS severity FROM y
"""
for _level, _limit in anomaly.THRESHOLDS.items():
    add(f"anomaly_z_{_level}", lambda s, d, v=_level: anomaly.detect_anomalies(_events(s, d), AnomalyRequest("ts", "value", sensitivity=v), ["event_type"]), f"WITH {_Z} WHERE abs(z) >= {_limit}")
add("anomaly_zero_variance", lambda s, d: anomaly.detect_anomalies(_events(s, d).dropDuplicates(["event_type", "ts"]).withColumn("value", F.lit(5.0)), AnomalyRequest("ts", "value", "mean")), "SELECT bucket, value, value AS expected, value AS z_score, value AS deviation_pct, '' AS severity FROM (SELECT CAST(ts AS DATE) AS bucket, 5.0::DOUBLE AS value FROM events) WHERE value <> 5.0")
add("anomaly_isolation_forest", lambda s, d: anomaly.isolation_anomalies(_events(s, d), AnomalyRequest("ts", "value", sensitivity="high"), ["event_type"]), None)


add("anomaly_forest_rows", lambda s, d: isolation.isolation_scores(_lineitem(s, d), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), None)


# --- forecasts
def _t(v: str) -> str:
    """The 0.975 quantile of Student's t for v degrees, as a series in 1 / v around the normal one."""
    z = 1.959963984540054
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    series = f"({z} + " + " + ".join(f"{c!r} / pow({v}, {k})" for k, c in enumerate(g, 1)) + ")"
    return f"(CASE {v} WHEN 22 THEN 2.0738730679040147 WHEN 67 THEN 1.996008354025297 ELSE {series} END)"  # few degrees: a table's values


def _forecast_sql(granularity: str, horizon: int, season: str | None, p: int, clamp: bool = True, how: str = "sum(total_amount)") -> str:
    every = {"day": "1 DAY", "month": "1 MONTH"}[granularity]
    of = season.replace("{x}", "timestamp") if season else "0"
    ahead = season.replace("{x}", "bucket") if season else "0"
    source = _series_sql(granularity, how, "(SELECT * FROM {O} WHERE total_amount IS NOT NULL)")
    lower = "CASE WHEN lowest >= 0 THEN greatest(0, y - w) ELSE y - w END" if clamp else "y - w"
    return (
        f"WITH {source}, k AS (SELECT timestamp, v, row_number() OVER (ORDER BY timestamp) - 1.0::DOUBLE AS t, {of} AS q FROM p), m AS (SELECT q, count(*) AS n, avg(t) AS t, avg(v) AS y FROM k GROUP BY q), "
        "c AS (SELECT sum((k.t - m.t) ** 2) AS sxx, sum((k.t - m.t) * (k.v - m.y)) AS sxy, sum((k.v - m.y) ** 2) AS syy, count(*) AS n, max(timestamp) AS last, min(v) AS lowest FROM k JOIN m USING (q)), "
        f"h AS (SELECT CAST(i AS INTEGER) AS step, CAST(last + i * INTERVAL {every} AS DATE) AS bucket, n - 1 + i AS t, sxx, sxy / sxx AS b, syy - sxy * sxy / sxx AS sse, n - {p} AS df, lowest FROM c, (SELECT unnest(range(1, {horizon} + 1)) AS i)), "
        f"f AS (SELECT step, bucket, m.y + b * (h.t - m.t) AS y, {_t('df')} * sqrt(greatest(1e-12, sse / df)) * sqrt(1 + 1.0 / m.n + (h.t - m.t) ** 2 / sxx) AS w, lowest FROM h JOIN m ON m.q = ({ahead})) "
        f"SELECT step, bucket, round(y, 1) AS predicted, round({lower}, 1) AS lower, round(y + w, 1) AS upper FROM f"
    )


def _forecast(s: SparkSession, d: str, **how) -> DataFrame:
    made = forecast(_orders(s, d), ForecastRequest("order_date", "total_amount", **how))
    return made.withColumns({c: F.round(c, 1) for c in ("predicted", "lower", "upper")})


add("forecast_seasonal_day", lambda s, d: _forecast(s, d, horizon=30), _forecast_sql("day", 30, "(isodow({x}) - 1)", 8))
add("forecast_seasonal_month", lambda s, d: _forecast(s, d, horizon=12, cadence="month"), _forecast_sql("month", 12, "(month({x}) - 1)", 13))
add("forecast_unclamped", lambda s, d: _forecast(s, d, horizon=14, allow_negative=True), _forecast_sql("day", 14, "(isodow({x}) - 1)", 8, False))


def _forecast_trend(s: SparkSession, d: str) -> DataFrame:
    """The trend of all events by day, without seasons, as a line's parameters."""
    return fit(timeseries.prepare_series(_events(s, d), "ts", "value"), "day", False)[1].select(F.round("slope", 4).alias("slope"), F.round("sxx", 4).alias("sxx"), F.round("sse", 2).alias("sse"))


add(
    "forecast_trend",
    _forecast_trend,
    f"WITH {_series_sql('day', 'sum(value)', '(SELECT value, CAST(ts AS DATE) AS order_date FROM {E} WHERE value IS NOT NULL)')}, k AS (SELECT row_number() OVER (ORDER BY timestamp) - 1.0::DOUBLE AS t, v FROM p) SELECT round(regr_slope(v, t), 4) AS slope, round(regr_sxx(v, t), 4) AS sxx, round(regr_syy(v, t) - regr_slope(v, t) * regr_sxy(v, t), 2) AS sse FROM k",
)


def _series_forecasts(source: str, key: str, horizon: int) -> str:
    """Forecasts of a table (key, dt, value) by day, for every key at once; weekly seasons where there are two weeks."""
    return (
        f"b AS (SELECT {key} AS key, dt, sum(value) AS v FROM {source} WHERE value IS NOT NULL GROUP BY ALL), e AS (SELECT key, min(dt) AS lo, max(dt) AS hi FROM b GROUP BY key), "
        "x AS (SELECT key, CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS dt FROM e), z AS (SELECT x.key, x.dt, coalesce(v, 0) AS v FROM x LEFT JOIN b ON x.key IS NOT DISTINCT FROM b.key AND x.dt = b.dt), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dt) - 1.0::DOUBLE AS t, count(*) OVER (PARTITION BY key) AS n FROM z), k AS (SELECT *, CASE WHEN n >= 14 THEN isodow(dt) - 1 ELSE 0 END AS q, CASE WHEN n >= 14 THEN 8 ELSE 2 END AS p FROM n), "
        "m AS (SELECT key, q, count(*) AS n, avg(t) AS t, avg(v) AS y FROM k GROUP BY key, q), "
        "c AS (SELECT k.key, sum((k.t - m.t) ** 2) AS sxx, sum((k.t - m.t) * (k.v - m.y)) AS sxy, sum((k.v - m.y) ** 2) AS syy, count(*) AS n, max(p) AS p, max(dt) AS last, min(v) AS lowest FROM k JOIN m ON k.key IS NOT DISTINCT FROM m.key AND k.q = m.q GROUP BY k.key), "
        f"h AS (SELECT key, CAST(i AS INTEGER) AS step, CAST(last + i * INTERVAL 1 DAY AS DATE) AS bucket, n - 1 + i AS t, sxx, sxy / sxx AS b, syy - sxy * sxy / sxx AS sse, n - p AS df, p, lowest FROM c, (SELECT unnest(range(1, {horizon} + 1)) AS i) WHERE n >= greatest(14, 2 * {horizon}) AND n > p), "
        f"f AS (SELECT h.key, step, bucket, m.y + b * (h.t - m.t) AS y, {_t('df')} * sqrt(greatest(1e-12, sse / df)) * sqrt(1 + 1.0 / m.n + (h.t - m.t) ** 2 / sxx) AS w, lowest FROM h JOIN m ON m.key IS NOT DISTINCT FROM h.key AND m.q = CASE WHEN p > 2 THEN isodow(bucket) - 1 ELSE 0 END)"
    )


_EVENT_FORECASTS = f"WITH {_series_forecasts('(SELECT *, CAST(ts AS DATE) AS dt FROM {E})', 'event_type', 10)}"
add(
    "forecast_by_series",
    lambda s, d: forecast_series(_events(s, d), ForecastRequest("ts", "value", horizon=10), ["event_type"]),
    _EVENT_FORECASTS + " SELECT key AS event_type, step, bucket, round(y, 4) AS predicted, round(CASE WHEN lowest >= 0 THEN greatest(0, y - w) ELSE y - w END, 4) AS lower, round(y + w, 4) AS upper FROM f",
)
add(
    "forecast_band",
    lambda s, d: with_band(forecast_series(_events(s, d), ForecastRequest("ts", "value", horizon=10), ["event_type"])).select("event_type", "step", F.round("band", 3).alias("band")),
    _EVENT_FORECASTS + " SELECT key AS event_type, step, round(greatest(0, round(y + w, 4) - round(CASE WHEN lowest >= 0 THEN greatest(0, y - w) ELSE y - w END, 4)), 3) AS band FROM f",
)

# --- root causes
_RCA = {"event_start": date(2024, 1, 20), "event_end": date(2024, 1, 22)}


def _analysis(s: SparkSession, d: str, **more) -> Analysis:
    return Analysis(_events(s, d), RCARequest("ts", "value", **(_RCA | {"dimensions": ["event_type", "cohort"]} | more)))


_WINDOWS = "r AS (SELECT *, CAST(ts AS DATE) AS dt FROM {E} WHERE value IS NOT NULL), u AS (SELECT *, dt BETWEEN DATE '2024-01-20' AND DATE '2024-01-22' AS ev, dt BETWEEN DATE '2024-01-17' AND DATE '2024-01-19' AS ba FROM r)"
_TOTAL = "t AS (SELECT sum(value) FILTER (ba) AS b, sum(value) FILTER (ev) AS e FROM u)"
_SEGMENTS = (
    f"WITH {_WINDOWS}, {_TOTAL}, l AS (SELECT 'event_type' AS dimension, event_type AS raw, * FROM u UNION ALL SELECT 'cohort', cohort, * FROM u), "
    "k AS (SELECT dimension, raw, row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, raw) AS rk FROM l GROUP BY 1, 2), "
    "g AS (SELECT l.*, CASE WHEN rk <= 20 THEN l.raw ELSE 'Other' END AS segment FROM l JOIN k ON l.dimension = k.dimension AND l.raw = k.raw), "
    "a AS (SELECT dimension, segment, coalesce(sum(value) FILTER (ba), 0) AS b, coalesce(sum(value) FILTER (ev), 0) AS e FROM g WHERE ba OR ev GROUP BY 1, 2), "
    "n AS (SELECT count(DISTINCT dt) AS days FROM u WHERE ba), y AS (SELECT dimension, segment, dt, sum(value) AS v FROM g WHERE ba GROUP BY 1, 2, 3), "
    "f AS (SELECT a.dimension, a.segment, x.dt, coalesce(y.v, 0) AS v FROM (SELECT DISTINCT dimension, segment FROM y) a CROSS JOIN (SELECT DISTINCT dt FROM u WHERE ba) x LEFT JOIN y ON y.dimension = a.dimension AND y.segment = a.segment AND y.dt = x.dt), "
    "q AS (SELECT dimension, segment, avg(v) AS m, stddev_samp(v) AS s FROM f GROUP BY 1, 2), "
    "o AS (SELECT a.dimension, a.segment, round(a.b, 4) AS baseline, round(a.e, 4) AS event, round(a.e - a.b, 4) AS delta, round((a.e - a.b) / greatest(abs(a.b), 1e-6) * 100, 2) AS growth_pct, round((a.e - a.b) / (t.e - t.b) * 100, 2) AS contribution_pct, round(coalesce(m, 0), 4) AS baseline_mean, round(s, 4) AS baseline_std, round((a.e - m) / s, 4) AS z_score, coalesce(abs((a.e - m) / s) >= 2, false) AS significant FROM a CROSS JOIN t LEFT JOIN q ON q.dimension = a.dimension AND q.segment = a.segment) "
)
add("rca_totals", lambda s, d: _analysis(s, d).totals(), f"WITH {_WINDOWS}, {_TOTAL} SELECT round(b, 4) AS baseline, round(e, 4) AS event, round(e - b, 4) AS delta, round((e - b) / greatest(abs(b), 1e-6) * 100, 2) AS change_pct, 'ok' AS status, (SELECT count(*) FROM u WHERE ev) AS event_rows, (SELECT count(*) FROM u WHERE ba) AS baseline_rows FROM t")
add("rca_segments", lambda s, d: _analysis(s, d).segments(), _SEGMENTS + "SELECT * FROM o")
add("rca_zscore", lambda s, d: _analysis(s, d).segments().select("dimension", "segment", "baseline_mean", "baseline_std", "z_score", "significant"), _SEGMENTS + "SELECT dimension, segment, baseline_mean, baseline_std, z_score, significant FROM o")
add("rca_ranking", lambda s, d: _analysis(s, d).drivers().select("dimension", "segment", "delta", "rank"), _SEGMENTS + "SELECT * FROM (SELECT dimension, segment, delta, CAST(row_number() OVER (PARTITION BY dimension, delta > 0 ORDER BY abs(delta) DESC, segment) AS INTEGER) AS rank FROM o WHERE delta <> 0) WHERE rank <= 5")
add("rca_primary", lambda s, d: _analysis(s, d).primary().select("dimension", "segment", "delta"), _SEGMENTS + "SELECT dimension, segment, delta FROM o ORDER BY abs(delta) DESC, dimension, segment LIMIT 10")
add("rca_coverage", lambda s, d: _analysis(s, d).coverage(), _SEGMENTS + "SELECT dimension, round(sum(abs(contribution_pct)), 2) AS coverage_pct FROM (SELECT dimension, contribution_pct, row_number() OVER (PARTITION BY dimension, delta > 0 ORDER BY abs(delta) DESC, segment) AS rk FROM o WHERE delta <> 0) WHERE rk <= 5 GROUP BY dimension")
add("rca_reconciliation", lambda s, d: _analysis(s, d).reconciliation(), _SEGMENTS + "SELECT round(sum(delta), 4) AS sum_of_deltas, round(max(t.e - t.b), 4) AS total_delta, round(abs(max(t.e - t.b) - sum(delta)), 4) AS discrepancy, round(abs(max(t.e - t.b) - sum(delta)), 4) <= greatest(1e-4, 0.0005 * abs(max(t.e - t.b))) AS reconciled, count(*) AS n_segments FROM o CROSS JOIN t WHERE dimension = 'event_type'")
add(
    "rca_secondary",
    lambda s, d: _analysis(s, d, secondary=["load"]).secondary(),
    f"WITH {_WINDOWS}, {_TOTAL}, v AS (SELECT sum(load) FILTER (ba) AS lb, sum(load) FILTER (ev) AS le FROM u) SELECT 'load' AS metric, round(lb, 4) AS baseline, round(le, 4) AS event, round(le - lb, 4) AS delta, round((le - lb) / greatest(abs(lb), 1e-6) * 100, 2) AS growth_pct, CASE WHEN sign(le - lb) = sign(e - b) THEN 'concordant' ELSE 'divergent' END AS direction, round((le - lb) / abs(lb) * 100 / ((e - b) / abs(b) * 100), 4) AS elasticity, 'ok' AS elasticity_status FROM v, t",
)
_SHIFT = 1e9


def _shifted(s: SparkSession, d: str) -> DataFrame:
    """Averages of values far from zero, whose daily spread is small beside them."""
    found = Analysis(_events(s, d).withColumn("value", F.col("value") + F.lit(_SHIFT)), RCARequest("ts", "value", **_RCA, aggregation="avg", dimensions=["event_type"])).segments()
    return found.select("segment", F.round("baseline_std", 2).alias("baseline_std"), F.round("z_score", 2).alias("z_score"), "significant")


add(
    "rca_zscore_shifted",
    _shifted,
    f"WITH {_WINDOWS}, y AS (SELECT event_type, dt, avg(value) AS v FROM u WHERE ba GROUP BY ALL), q AS (SELECT event_type, avg(v) AS m, stddev_samp(v) AS s FROM y GROUP BY 1), a AS (SELECT event_type, avg(value) AS e FROM u WHERE ev GROUP BY 1) SELECT event_type AS segment, round(s, 2) AS baseline_std, round((e - m) / s, 2) AS z_score, abs((e - m) / s) >= 2 AS significant FROM a JOIN q USING (event_type)",
)
_CELLS = [["event_type"], ["cohort"], ["place"], ["event_type", "cohort"], ["event_type", "place"], ["cohort", "place"], ["event_type", "cohort", "place"]]


def _intersections(s: SparkSession, d: str) -> DataFrame:
    rows = _events(s, d).withColumn("place", F.concat(F.lit("p"), (F.col("load") % 7).cast("int").cast("string")))
    found = rca_lattice.search(Analysis(rows, RCARequest("ts", "value", **_RCA, dimensions=["event_type", "cohort", "place"])), 3, 25).segments
    return found.select("rank", "depth", F.array_join("dimensions", "+").alias("dimensions"), F.array_join("segment", "+").alias("segment"), "baseline", "event", "delta", "contribution_pct", "event_rows", "baseline_rows")


add(
    "rca_intersections",
    _intersections,
    f"WITH {_WINDOWS}, {_TOTAL}, w AS (SELECT *, 'p' || CAST(CAST(load AS BIGINT) % 7 AS VARCHAR) AS place FROM u WHERE ba OR ev), g AS ("
    + " UNION ALL ".join(f"SELECT {len(c)} AS depth, {c} AS dims, [{', '.join(c)}] AS vals, coalesce(sum(value) FILTER (ba), 0) AS b, coalesce(sum(value) FILTER (ev), 0) AS e, count(*) FILTER (ev) AS event_rows, count(*) FILTER (ba) AS baseline_rows FROM w GROUP BY {', '.join(c)}" for c in _CELLS)
    + "), o AS (SELECT *, row_number() OVER (ORDER BY abs(round(e - b, 4)) DESC, depth, dims, vals) AS rank FROM g) SELECT CAST(rank AS INTEGER) AS rank, depth, array_to_string(dims, '+') AS dimensions, array_to_string(vals, '+') AS segment, round(o.b, 4) AS baseline, round(o.e, 4) AS event, round(o.e - o.b, 4) AS delta, round((o.e - o.b) / (t.e - t.b) * 100, 2) AS contribution_pct, event_rows, baseline_rows FROM o, t WHERE rank <= 25",
)
add("rca_narrative", lambda s, d: _analysis(s, d).narrative(), None)


# --- result tables
def _found(s: SparkSession, d: str) -> DataFrame:
    return anomaly.detect_anomalies(_events(s, d), AnomalyRequest("ts", "value", sensitivity="high"), ["event_type"]).select(F.lit("org1").alias("org_id"), F.lit("ds1").alias("dataset_id"), F.col("event_type").alias("metric"), "bucket", "value", "severity")


_FOUND = f"a AS (SELECT 'org1' AS org_id, 'ds1' AS dataset_id, event_type AS metric, bucket, value, severity FROM (WITH {_Z} WHERE abs(z) >= 2.0))"
_OLD = "o AS (SELECT 'org1' AS org_id, 'ds1' AS dataset_id, event_type AS metric, CAST(ts AS DATE) AS bucket, round(max(value), 4) AS value, 'low' AS severity FROM events GROUP BY event_type, CAST(ts AS DATE))"


def _old(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).groupBy(F.lit("org1").alias("org_id"), F.lit("ds1").alias("dataset_id"), F.col("event_type").alias("metric"), F.to_date("ts").alias("bucket")).agg(F.round(F.max("value"), 4).alias("value"), F.lit("low").alias("severity"))


_M = "click"
_SAVED = "org_id string, dataset_id string, metric string, bucket date, value double"


def _folder(s: SparkSession, tag: str) -> str:
    return folder(s, f"{tag}-{uuid.uuid4().hex}")


add("persist_replace_all", lambda s, d: store.replace(_old(s, d), _found(s, d).filter(F.col("metric") == _M), store.in_scope("org1", "ds1", _M)), f"WITH {_FOUND}, {_OLD} SELECT * FROM o WHERE metric <> '{_M}' UNION ALL SELECT * FROM a WHERE metric = '{_M}'")
add("persist_replace_range", lambda s, d: store.replace_range(_old(s, d), _found(s, d).filter(F.col("metric") == _M), "org1", "ds1", _M), f"WITH {_FOUND}, {_OLD}, e AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM a WHERE metric = '{_M}') SELECT o.* FROM o, e WHERE NOT coalesce(metric = '{_M}' AND bucket BETWEEN lo AND hi, false) UNION ALL SELECT * FROM a WHERE metric = '{_M}'")
_RESULTS = "org_id string, dataset_id string, metric string, bucket date, value double, severity string"


def _results(s: SparkSession, d: str) -> ResultTable:
    """A result table that holds the old rows."""
    table = ResultTable(s, _folder(s, "results"), _RESULTS)
    table.replace_all(_old(s, d))
    return table


def _persist_empty(s: SparkSession, d: str) -> DataFrame:
    """Nothing found for a metric, so all its old rows go; those of the others stay."""
    table = _results(s, d)
    table.replace_all(_found(s, d).filter("false"), [("org1", "ds1", _M)])
    return table.read("org1")


def _persist_range(s: SparkSession, d: str) -> DataFrame:
    """One metric's days are replaced from the first to the last found, in the written table."""
    table = _results(s, d)
    table.replace_range(_found(s, d).filter(F.col("metric") == _M), ("org1", "ds1", _M))
    return table.read("org1")


def _persist_horizon(s: SparkSession, d: str) -> DataFrame:
    """Forecasts of all metrics, made anew a week later for one of them: the overlap of the horizons is replaced, the days before it stay."""
    made = forecast_series(_events(s, d), ForecastRequest("ts", "value", horizon=10), ["event_type"])
    rows = made.select(F.lit("org1").alias("org_id"), F.lit("ds1").alias("dataset_id"), F.col("event_type").alias("metric"), "bucket", F.col("predicted").alias("value"))
    table = ResultTable(s, _folder(s, "forecasts"), _SAVED)
    table.replace_all(rows)
    later = rows.filter(F.col("metric") == _M).withColumns({"bucket": F.date_add("bucket", 7), "value": F.round(F.col("value") + 1, 4)})
    table.replace_range(later, ("org1", "ds1", _M))
    return store.listed_forecasts(table.read("org1"), "org1", limit=1000)


def _persist_audit(s: SparkSession, d: str) -> DataFrame:
    """A record for every metric whose anomalies were looked for, in a table that only grows."""
    table = ResultTable(s, _folder(s, "audit"), "org_id string, dataset_id string, metric string, bucket date, action string, n long")
    for action, rows in (("detected", _found(s, d)), ("listed", _old(s, d))):
        table.append(rows.groupBy("org_id", "dataset_id", "metric").agg(F.max("bucket").alias("bucket"), F.lit(action).alias("action"), F.count(F.lit(1)).alias("n")))
    return table.read("org1")


add("persist_empty", _persist_empty, f"WITH {_OLD} SELECT * FROM o WHERE metric <> '{_M}'")
add("persist_date_range", _persist_range, ORACLE_SQL["persist_replace_range"])
add(
    "persist_horizon",
    _persist_horizon,
    _EVENT_FORECASTS + f", r AS (SELECT 'org1' AS org_id, 'ds1' AS dataset_id, key AS metric, bucket, round(y, 4) AS value FROM f) SELECT * FROM r WHERE NOT (metric = '{_M}' AND bucket >= (SELECT min(bucket) + 7 FROM r WHERE metric = '{_M}')) UNION ALL SELECT org_id, dataset_id, metric, CAST(bucket + 7 AS DATE), round(value + 1, 4) FROM r WHERE metric = '{_M}'",
)
add("persist_audit", _persist_audit, f"WITH {_FOUND}, {_OLD} SELECT org_id, dataset_id, metric, max(bucket) AS bucket, 'detected' AS action, count(*) AS n FROM a GROUP BY 1, 2, 3 UNION ALL SELECT org_id, dataset_id, metric, max(bucket), 'listed', count(*) FROM o GROUP BY 1, 2, 3")
_EXPECTED = "CASE WHEN metric = 'view' THEN NULL WHEN metric = 'cart' THEN 0 ELSE 100 END"
add(
    "list_anomalies_deviation",
    lambda s, d: store.listed_anomalies(_old(s, d).withColumn("expected", F.expr(_EXPECTED).cast("double")), "org1", "ds1", severity="low"),
    f"WITH {_OLD} SELECT *, CAST({_EXPECTED} AS DOUBLE) AS expected, round((value - {_EXPECTED}) / greatest(abs({_EXPECTED}), 1e-6) * 100, 2) AS deviation_pct FROM o WHERE severity = 'low'",
)
add(
    "list_datasets",
    lambda s, d: store.listed_datasets(read_table(s, d, "orders").selectExpr("CASE WHEN o_orderkey % 2 = 0 THEN 'org1' ELSE 'org2' END AS org_id", "o_orderkey AS dataset_id", "o_orderdate AS created_at"), "org1", limit=30, offset=12),
    "SELECT 'org1' AS org_id, o_orderkey AS dataset_id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 12",
)
_CATALOG = "SELECT o_orderkey AS id, 'd' || CAST(o_orderkey AS VARCHAR) AS dataset_id, 'uploaded' AS status, CAST(NULL AS BIGINT) AS row_count, CAST(NULL AS BIGINT) AS n_columns FROM orders"


def _synced(s: SparkSession, d: str) -> DataFrame:
    """A catalogue of many datasets, of which one is profiled."""
    catalog = read_table(s, d, "orders").selectExpr("o_orderkey AS id", "concat('d', o_orderkey) AS dataset_id", "'uploaded' AS status", "CAST(NULL AS BIGINT) AS row_count", "CAST(NULL AS BIGINT) AS n_columns")
    return store.sync_dataset(catalog, "d7", profile.profile_columns(_dirty(s, d)), _dirty(s, d).count()).drop("id")


add("sync_dataset", _synced, f"SELECT dataset_id, CASE WHEN dataset_id = 'd7' THEN 'ready' ELSE status END AS status, CASE WHEN dataset_id = 'd7' THEN (SELECT count(*) FROM orders) END AS row_count, CASE WHEN dataset_id = 'd7' THEN 7 END AS n_columns FROM ({_CATALOG})")
add(
    "anomaly_run_facts",
    lambda s, d: anomaly.run_facts(timeseries.prepare_series(_events(s, d), "ts", "value"), AnomalyRequest("ts", "value"), F.lit(date(2024, 6, 1))),
    "SELECT *, DATE '2024-06-01' - end_date AS recency_lag_days, 'day' AS cadence, 'sum' AS aggregation, 'rolling_z' AS method, 2.5 AS threshold FROM (SELECT min(CAST(ts AS DATE)) AS start_date, max(CAST(ts AS DATE)) AS end_date, max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS observations FROM events WHERE value IS NOT NULL)",
)
add("list_anomalies", lambda s, d: store.listed(_old(s, d), "org1", severity="low", limit=12, offset=3), f"WITH {_OLD} SELECT * FROM o WHERE severity = 'low' ORDER BY bucket DESC, metric LIMIT 12 OFFSET 3")
add("ml_summary", lambda s, d: store.summary(_found(s, d), _old(s, d), "org1"), f"WITH {_FOUND}, {_OLD} SELECT (SELECT count(*) FROM a) AS anomalies, (SELECT count(*) FROM a WHERE severity = 'critical') AS critical, (SELECT count(*) FROM a WHERE severity = 'high') AS high, (SELECT count(*) FROM a WHERE severity = 'medium') AS medium, (SELECT count(*) FROM a WHERE severity = 'low') AS low, (SELECT count(*) FROM o) AS forecasts, (SELECT count(*) FROM (SELECT metric FROM a UNION SELECT metric FROM o)) AS metrics")
add("audit_append", lambda s, d: store.audit(_old(s, d).groupBy("org_id").agg(F.lit("load").alias("action"), F.lit("{}").alias("details"), F.max("bucket").alias("at")), "org1", "rca_run", F.to_json(F.struct(F.lit("value").alias("metric"))), F.lit(date(2024, 2, 1))), f"WITH {_OLD} SELECT org_id, 'load' AS action, '{{}}' AS details, max(bucket) AS at FROM o GROUP BY org_id UNION ALL SELECT 'org1', 'rca_run', '{{\"metric\":\"value\"}}', DATE '2024-02-01'")

add(
    "catalog_sync",
    lambda s, d: store.sync_columns(s.createDataFrame([("ds1", "gone", "text", True), ("ds2", "stays", "text", False)], "dataset_id string, column string, classification string, nullable boolean"), profile.profile_columns(_dirty(s, d)), "ds1"),
    "SELECT 'ds2' AS dataset_id, 'stays' AS \"column\", 'text' AS classification, false AS nullable UNION ALL " + " UNION ALL ".join(f"SELECT 'ds1', '{c}', '{k}', count(*) > count({c}) FROM {{D}}" for c, k in _KINDS.items()),
)
add(
    "prof_samples",
    lambda s, d: profile.samples(_dirty(s, d)).select("column", F.array_join("samples", "|").alias("samples")),
    " UNION ALL ".join(f"SELECT '{c}' AS column, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {text} AS v FROM {{D}} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples" for c in _KINDS if c != "price" for text in [f"CAST({c} AS VARCHAR)"]) + " UNION ALL SELECT 'price', (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST(price AS VARCHAR) AS v FROM {D} WHERE price IS NOT NULL ORDER BY v LIMIT 5))",
)
add(
    "prof_memory",
    lambda s, d: profile.memory(_orders(s, d)),
    " UNION ALL ".join(f"SELECT '{c}' AS column, CAST({size} AS BIGINT) AS bytes FROM {{O}}" for c, size in (("order_id", "8 * count(order_id)"), ("customer_id", "8 * count(customer_id)"), ("status", "sum(octet_length(encode(status)))"), ("priority", "sum(octet_length(encode(priority)))"), ("total_amount", "8 * count(total_amount)"), ("order_date", "4 * count(order_date)"))),
)
add(
    "corr_default_columns",
    lambda s, d: agg.correlation(_lineitem(s, d), agg.default_correlation_columns(_lineitem(s, d))).filter("x < y"),
    " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 4) AS value FROM lineitem" for x, y in combinations(sorted(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 2)),
)
add("rca_date_column", lambda s, d: s.createDataFrame([(rca_date_column(_dirty(s, d)),)], "date_column string"), "SELECT 'order_date' AS date_column")


# --- files: a table is written, read back through the reader, and compared with what was written
def _scan_csv(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "csv")
    texts = read_table(s, d, "supplier").select("s_suppkey", F.concat(F.lit('a "'), "s_name", F.lit('"\n, x')).alias("note"), F.when(F.col("s_suppkey") % 7 == 0, F.lit("NA")).otherwise(F.round("s_acctbal", 2).cast("string")).alias("balance"))
    texts.write.options(header=True, escape='"', quoteAll=True).csv(path)
    return read_csv(s, path)


add("scan_csv", _scan_csv, "SELECT s_suppkey, 'a \"' || s_name || '\"' || chr(10) || ', x' AS note, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS balance FROM supplier")


def _ingest(s: SparkSession, d: str) -> DataFrame:
    lines = [f"{r['n_nationkey']},{r['n_name']}" for r in read_table(s, d, "nation").select("n_nationkey", "n_name").collect()]  # 25 rows
    return ingest(s, ("key,name\n" + "\n".join(lines) + "\n").encode(), _folder(s, "uploads"), "org1", "ds1", "nations 1.csv", "text/csv").select("kind", "size_bytes", "rows")


add("ingest_csv", _ingest, "SELECT 'csv' AS kind, CAST(9 + sum(length(CAST(n_nationkey AS VARCHAR)) + length(n_name) + 2) AS BIGINT) AS size_bytes, count(*) AS rows FROM nation")


def _sink_clean(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(write_clean(_orders(s, d), _folder(s, "clean"), "org1", "ds1"))


add("sink_clean", _sink_clean, "SELECT * FROM {O}")


def _ingest_then_clean(s: SparkSession, d: str) -> DataFrame:
    """An upload with odd headers is taken in and cleaned under one base: what was uploaded is still there, and the dataset opens as the cleaned rows under the upload's headers."""
    base = _folder(s, "datasets")
    lines = [f"{r['s_suppkey']},{r['s_name']} ,{r['s_nationkey']}" for r in read_table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey").collect()]  # an upload is small
    made = ingest(s, ("Supp Key,Supp Name,Nation\n" + "\n".join(lines + lines[:5]) + "\n").encode(), base, "org1", "ds1", "supplier.csv").first()
    raw, was_clean = open_dataset(s, base, "org1", "ds1")
    named, _ = clean.normalize_names(raw)
    write_clean(clean.drop_duplicates(named).withColumn("supp_name", F.trim("supp_name")), base, "org1", "ds1")
    opened, is_clean = open_dataset(s, base, "org1", "ds1")
    raw_rows = s.read.option("header", True).csv(f"{base}/org1/ds1/raw/supplier.csv").count()
    return opened.select("Supp Key", "Supp Name", "Nation", F.lit(made["rows"] == raw_rows).alias("raw_stays"), F.lit(is_clean and not was_clean).alias("cleaned"))


add("ingest_then_clean", _ingest_then_clean, """SELECT s_suppkey AS "Supp Key", trim(s_name) AS "Supp Name", s_nationkey AS "Nation", true AS raw_stays, true AS cleaned FROM supplier""")


def _forecasts(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).groupBy(F.lit("org1").alias("org_id"), F.lit("ds1").alias("dataset_id"), F.col("event_type").alias("metric"), F.to_date("ts").alias("bucket")).agg(F.round(F.sum("value"), 2).alias("value"))


def _persisted(s: SparkSession, d: str) -> DataFrame:
    """All metrics saved, one of them saved again: its rows are replaced, the others stay."""
    path = _folder(s, "forecasts")
    store.save(_forecasts(s, d), path)
    store.save(_forecasts(s, d).filter("metric = 'click'").withColumn("value", F.col("value") + 1), path)
    return store.listed_forecasts(store.load(s, path, _SAVED), "org1", limit=40, offset=5)


add(
    "forecast_persist_list",
    _persisted,
    "SELECT * FROM (SELECT 'org1' AS org_id, 'ds1' AS dataset_id, event_type AS metric, CAST(ts AS DATE) AS bucket, round(sum(value), 2) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS value FROM events GROUP BY 3, 4) ORDER BY bucket, metric LIMIT 40 OFFSET 5",
)


def _looked_up(s: SparkSession, d: str) -> DataFrame:
    """The first anomaly found is looked up by its id and organisation, and its day is explained."""
    found = store.with_id(_found(s, d))
    key = found.orderBy("bucket", "metric").select("id").first()["id"]
    one = store.by_id(found, "org1", key).first()
    day = one["bucket"]
    rows = _events(s, d).filter(F.col("event_type") == one["metric"])
    totals = Analysis(rows, RCARequest("ts", "value", event_start=day, event_end=day, dimensions=["cohort"])).totals()
    return totals.select(F.lit(one["metric"]).alias("metric"), F.lit(day).alias("bucket"), "event", "baseline", F.lit(store.by_id(found, "org2", key).count()).alias("found_by_others"))


add(
    "anomaly_lookup_rca",
    _looked_up,
    f"WITH {_FOUND}, f AS (SELECT metric, bucket FROM a ORDER BY bucket, metric LIMIT 1) SELECT f.metric, f.bucket, round(coalesce(sum(value) FILTER (CAST(ts AS DATE) = f.bucket), 0), 4) AS event, round(coalesce(sum(value) FILTER (CAST(ts AS DATE) = f.bucket - 1), 0), 4) AS baseline, CAST(0 AS BIGINT) AS found_by_others FROM events, f WHERE event_type = f.metric GROUP BY 1, 2",
)
_TOTALS = "CASE WHEN o_orderkey % 3 = 0 THEN 'cleaned' ELSE 'ready' END AS status, o_custkey AS row_count"
add(
    "dataset_totals",
    lambda s, d: store.totals(read_table(s, d, "orders").selectExpr("'org1' AS org_id", "o_orderkey AS dataset_id", *_columns(_TOTALS)), "org1"),
    f"SELECT count(*) AS datasets, count(*) FILTER (status = 'cleaned') AS cleaned, round(count(*) FILTER (status = 'cleaned') / count(*) * 100, 2) AS cleaned_pct, CAST(sum(row_count) AS BIGINT) AS rows FROM (SELECT {_TOTALS} FROM orders)",
)
add(
    "default_columns",
    lambda s, d: store.default_columns(profile.profile_columns(_dirty(s, d)).join(s.createDataFrame(list(zip(_KINDS, range(9))), "column string, position int"), "column")),
    "SELECT 'order_date' AS date_column, 'amount_text' AS metric_column, 'priority' AS dimension",
)
add("clean_dedup_report", lambda s, d: clean.duplicate_report(_orders(s, d).select("status", "priority")), "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT status, priority FROM {O})) AS duplicates, round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT status, priority FROM {O}))) / count(*) * 100, 2) AS duplicate_pct, (SELECT count(*) FROM (SELECT DISTINCT status, priority FROM {O})) AS rows_after FROM {O}")
add("clean_outlier_samples", lambda s, d: clean.outlier_samples(read_table(s, d, "events"), "value"), f"SELECT value FROM events, {_BOUNDS.replace('{c}', 'value').replace('{t}', 'events')} WHERE value < lo OR value > hi GROUP BY value, lo, hi ORDER BY greatest(lo - value, value - hi) DESC, value LIMIT 5")
add("scalar_slug", lambda s, d: read_table(s, d, "part").select("p_partkey", slug(F.concat(F.lit(" Part: "), "p_name", F.lit("!"))).alias("slug")), "SELECT p_partkey, trim(regexp_replace(lower(' Part: ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
add(
    "proj_json",
    lambda s, d: json_ready(_orders(s, d).select("order_id", "order_date", F.when(F.col("order_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("total_amount")).alias("amount"))),
    "SELECT order_id, CAST(order_date AS VARCHAR) AS order_date, CASE WHEN order_id % 5 = 0 THEN NULL ELSE total_amount END AS amount FROM {O}",
)

_COUNTED = {"lineitem": ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"], "events": ["user_id", "event_type"]}


def _heavy_hitters(s: SparkSession, d: str) -> DataFrame:
    parts = [heavy_hitters(read_table(s, d, t), names, 15).rows for t, names in _COUNTED.items()]
    return parts[0].unionByName(parts[1])


add(
    "heavy_hitters",
    _heavy_hitters,
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, {text} AS value, count(*) AS n, (SELECT count({c}) FROM {t}) AS total, CAST(row_number() OVER (ORDER BY count(*) DESC, {text}) AS INTEGER) AS rank FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
        for t, names in _COUNTED.items()
        for c in names
        for text in [f"CAST({c} AS VARCHAR)"]
    )
    + ") WHERE rank <= 15",
)


def _file_profiles(s: SparkSession, d: str) -> DataFrame:
    """A table of orders grows by a year at a time; its profile comes from the sketches of its files, distinct counts are told by how far off they may be."""
    table, profiles = _folder(s, "growing"), None
    for low, high in ((1990, 1994), (1995, 1996), (1997, 2010)):
        _orders(s, d).filter(F.year("order_date").between(low, high)).write.mode("append").parquet(table)
        profiles = profiles or FileProfiles(s, table, _folder(s, "sketches"))
        profiles.update()
    exact = _orders(s, d).agg(*[F.count_distinct(c).alias(c) for c in ("order_id", "customer_id", "status", "priority", "total_amount", "order_date")])
    told = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in exact.columns])))
    close = F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.04 * F.col("exact"))
    return profiles.profile().join(F.broadcast(told), "column").select("column", "rows", "null_count", "null_pct", F.round("mean", 2).alias("mean"), F.when(F.col("mean").isNull(), F.col("min")).alias("least"), F.when(F.col("mean").isNull(), F.col("max")).alias("most"), "exact", close.alias("close"))


add(
    "profile_growing_table",
    _file_profiles,
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, {mean} AS mean, {least} AS least, {most} AS most, count(DISTINCT {c}) AS exact, true AS close FROM {{O}}"
        for c, number in (("order_id", True), ("customer_id", True), ("total_amount", True), ("status", False), ("priority", False), ("order_date", False))
        for mean, least, most in [(f"round(avg({c}), 2)", "NULL::VARCHAR", "NULL::VARCHAR") if number else ("NULL::DOUBLE", f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)")]
    ),
)

_TABLES = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}
_REFERENCES = [("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("supplier", "s_nationkey", "nation", "n_nationkey")]


def _references(s: SparkSession, d: str) -> DataFrame:
    """References between the tables, orders with a part of its rows left out, so that items are orphaned."""
    tables = {t: read_table(s, d, t) for t in _TABLES}
    tables["orders"] = tables["orders"].filter("o_orderkey % 40 <> 7")
    return references.discover(tables, 0.2, by_name=True)[1].drop("distinct_pct")


add(
    "discover_references",
    _references,
    "WITH orders2 AS (SELECT * FROM orders WHERE o_orderkey % 40 <> 7) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS child, '{x}' AS child_column, '{p}' AS parent, '{k}' AS parent_column, count({x}) AS known, count(*) FILTER ({x} IS NOT NULL AND {x} NOT IN (SELECT {k} FROM {source(p)})) AS orphans, round(count(*) FILTER ({x} IS NOT NULL AND {x} NOT IN (SELECT {k} FROM {source(p)})) / count({x}) * 100, 2) AS orphan_pct FROM {source(c)}"
        for source in [lambda t: "orders2" if t == "orders" else t]
        for c, x, p, k in _REFERENCES
    ),
)

# --- relational
add("join_inner", lambda s, d: read_table(s, d, "nation").join(read_table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add(
    "join_star_revenue",
    lambda s, d: _lineitem(s, d).join(read_table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read_table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")),
    "SELECT c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
)
add("join_anti_orphans", lambda s, d: relational.orphans(read_table(s, d, "orders"), _lineitem(s, d), "o_orderkey", "l_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
add("join_semi", lambda s, d: relational.with_parent(read_table(s, d, "orders"), _lineitem(s, d), "o_orderkey", "l_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
add("join_full_zero", lambda s, d: _events(s, d).groupBy("event_type").agg(F.round(F.coalesce(F.sum(F.when(F.to_date("ts") < F.lit(date(2024, 1, 16)), F.col("value"))), F.lit(0.0)), 4).alias("before"), F.round(F.coalesce(F.sum(F.when(F.to_date("ts") >= F.lit(date(2024, 1, 16)), F.col("value"))), F.lit(0.0)), 4).alias("after")), "WITH a AS (SELECT event_type, sum(value) AS v FROM events WHERE ts < DATE '2024-01-16' GROUP BY 1), b AS (SELECT event_type, sum(value) AS v FROM events WHERE ts >= DATE '2024-01-16' GROUP BY 1) SELECT event_type, round(coalesce(a.v, 0), 4) AS before, round(coalesce(b.v, 0), 4) AS after FROM a FULL JOIN b USING (event_type)")
add("set_union_distinct", lambda s, d: read_table(s, d, "customer").select(F.col("c_nationkey").alias("nation")).union(read_table(s, d, "supplier").select("s_nationkey")).distinct(), "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
add("set_except", lambda s, d: read_table(s, d, "orders").select(F.col("o_orderkey").alias("k")).subtract(_lineitem(s, d).select("l_orderkey")), "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
add("set_intersect", lambda s, d: read_table(s, d, "orders").select(F.col("o_orderkey").alias("k")).intersect(_lineitem(s, d).select("l_orderkey")), "SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
_Q = [round(((i * 37) % 64 - 32) / 32, 4) for i in range(64)]
_QSQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _Q) + "]"
add("vector_topk_cosine", lambda s, d: relational.nearest(read_table(s, d, "embeddings"), _Q, "vec_id", "embedding", 10), f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QSQL}), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10")


def _neighbours(s: SparkSession, d: str, exact: bool) -> DataFrame:
    """The ten nearest of every fiftieth vector among all."""
    vectors = read_table(s, d, "embeddings")
    index = neighbours.build(vectors, _folder(s, "vectors"))
    return neighbours.search(index, vectors.filter("vec_id % 50 = 0"), 10, len(index.centroids) if exact else None)


add(
    "vector_neighbours_exact",
    lambda s, d: _neighbours(s, d, True),
    "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10",
)
add("vector_neighbours", lambda s, d: _neighbours(s, d, False), None)
add("window_tumbling", lambda s, d: streams.tumbling(_events(s, d), "ts", "event_type", "value").withColumn("window_start", F.to_date("window_start")), "SELECT CAST(ts AS DATE) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    like, name = read_table(s, d, "events"), f"tumbling_{uuid.uuid4().hex}"
    stream = streams.read_stream(s, f"{d}/events.parquet*", like)
    path = folder(s, f"{name}-rows")
    streams.run_to_path(streams.tumbling(stream, "ts", "event_type", "value"), path, folder(s, name))
    return s.read.parquet(path).withColumn("window_start", F.to_date("window_start"))


add("streaming_tumbling", _streamed, ORACLE_SQL["window_tumbling"])


def _streamed_sessions(s: SparkSession, d: str) -> DataFrame:
    like, name = read_table(s, d, "events"), f"sessions_{uuid.uuid4().hex}"
    path = folder(s, f"{name}-rows")
    streams.run_to_path(streams.sessions(streams.read_stream(s, f"{d}/events.parquet*", like), "ts", "user_id", "12 hours", "60 days"), path, folder(s, name))
    return s.read.parquet(path).select("key", F.unix_micros("session_start").alias("first"), (F.unix_micros("session_end") - 12 * 3600 * 1000000).alias("last"), "n")


add(
    "streaming_sessions",
    _streamed_sessions,
    "WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL), g AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, before NULLS FIRST) AS k FROM o) SELECT user_id AS key, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM g GROUP BY user_id, k",
)


def _xlsx(rows: list[tuple]) -> bytes:
    """A workbook of one sheet with these rows of numbers and texts."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else "<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def _scan_xlsx(s: SparkSession, d: str) -> DataFrame:
    """Suppliers of each region as an upload of their own; the workbooks are read as one table."""
    base = _folder(s, "workbooks")
    nations = read_table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = read_table(s, d, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "s_suppkey", "n_name", F.when(F.col("s_suppkey") % 9 > 0, F.round("s_acctbal", 2)).alias("balance")).collect()  # an upload is small
    for region in sorted({r[0] for r in rows}):
        own = [tuple(r)[1:] for r in rows if r[0] == region]
        head = ("Supplier", "Nation", "Balance") if region % 2 else ("Nation", "Supplier", "Balance")
        write_raw(s, _xlsx([head, *(own if region % 2 else [(b, a, c) for a, b, c in own])]), base, "org1", "books", f"region {region}.xlsx")
    return read_workbooks(s, f"{base}/org1/books/raw").select("Supplier", "Nation", "Balance")


add("scan_xlsx", _scan_xlsx, 'SELECT s_suppkey AS "Supplier", n_name AS "Nation", CASE WHEN s_suppkey % 9 > 0 THEN round(s_acctbal, 2) END AS "Balance" FROM supplier JOIN nation ON s_nationkey = n_nationkey')
