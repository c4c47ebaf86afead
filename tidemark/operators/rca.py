"""Root causes of a metric's change between two windows of days: who moved, by how much, and is that unusual.

All dimensions are unpivoted and summed in one pass: each row counts towards its window's sums, so a
change needs no join of baseline and event.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import day, is_moment, is_numeric, kind, number, r2, r4
from tidemark.operators.filters import require
from tidemark.operators.heavy_hitters import heavy_hitters
from tidemark.plans.requests import RCARequest

#: Fixed values of the interface; so are the texts of status, direction and elasticity_status below.
TOP, MAX_DRIVERS, NO_CHANGE, SMALL, SIGNIFICANT = 20, 50, 1e-6, 1e-6, 2.0


def windows(df: DataFrame, request: RCARequest) -> tuple[date, date, date, date, str]:
    """Event and baseline: the given one, else as many days right before the event, which the data must reach back to."""
    start, end = request.event_start, request.event_end
    if request.baseline_start and request.baseline_end:
        return start, end, request.baseline_start, request.baseline_end, "custom"
    days = (end - start).days + 1
    first = df.agg(F.min(day(df, request.date_column))).first()[0]
    if first is None or start - timedelta(days) < first:
        raise ValueError(f"no {days} days of data before {start}")
    return start, end, start - timedelta(days), start - timedelta(1), "prior_period"


def dimensions(df: DataFrame, request: RCARequest) -> list[str]:
    """The asked for, or the first text and boolean columns with 2 to 500 values."""
    if request.dimensions:
        require(df, request.dimensions)
        return request.dimensions
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in (request.date_column, request.metric_column)]
    if not names:
        return []
    counts = df.agg(*[F.count_distinct(F.col(f"`{n}`")).alias(n) for n in names]).first()
    return [n for n in names if 2 <= counts[n] <= 500][: request.max_dimensions]


def date_column(df: DataFrame) -> str | None:
    """The first column that reads as a date in at least two rows and half of all; numbers are no dates."""
    names = [f.name for f in df.schema if is_moment(f.dataType) or isinstance(f.dataType, T.StringType)]
    if not names:
        return None
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(day(df, n)).alias(n) for n in names]).first()
    return next((n for n in names if one[n] >= max(2, one["_rows"] / 2)), None)


class Analysis:
    """The windows' rows and the figures that all results share."""

    def __init__(self, df: DataFrame, request: RCARequest) -> None:
        require(df, [request.date_column, request.metric_column])
        self.df, self.request = df, request
        self.event_start, self.event_end, self.base_start, self.base_end, self.mode = windows(df, request)
        self.scale = ((self.event_end - self.event_start).days + 1) / ((self.base_end - self.base_start).days + 1)
        self.dims = dimensions(df, request)
        when, metric = day(df, request.date_column), number(df, request.metric_column)
        self.known = df.withColumns({"_day": when, "_metric": metric}).filter(F.col("_day").isNotNull() & F.col("_metric").isNotNull())
        event, base = F.col("_day").between(F.lit(self.event_start), F.lit(self.event_end)), F.col("_day").between(F.lit(self.base_start), F.lit(self.base_end))
        self.rows = self.known.withColumns({"_event": event, "_base": base}).filter(F.col("_event") | F.col("_base"))
        self._totals: dict | None = None

    def of(self, window: str, value: Column) -> Column:
        """The aggregate over one window, the baseline scaled to the event's length unless it is an average."""
        inside = F.when(F.col(f"_{window}"), value)
        if self.request.aggregation == "avg":
            return F.coalesce(F.avg(inside), F.lit(0.0))
        made = F.coalesce(F.sum(inside), F.lit(0.0)) if self.request.aggregation == "sum" else F.count(inside).cast("double")
        return made * self.scale if window == "base" else made

    def totals(self) -> DataFrame:
        """baseline, event, delta, change_pct, status, event_rows, baseline_rows."""
        one = self.rows.agg(self.of("base", F.col("_metric")).alias("b"), self.of("event", F.col("_metric")).alias("e"), F.count(F.when(F.col("_event"), 1)).alias("event_rows"), F.count(F.when(F.col("_base"), 1)).alias("baseline_rows"))
        delta = F.col("e") - F.col("b")
        status = F.when(F.abs(delta) < NO_CHANGE, "undefined_zero_net_change").otherwise("ok")
        return one.select(
            r4(F.col("b")).alias("baseline"), r4(F.col("e")).alias("event"), r4(delta).alias("delta"), r2(delta / F.greatest(F.abs("b"), F.lit(SMALL)) * 100).alias("change_pct"), status.alias("status"), "event_rows", "baseline_rows"
        )

    def total(self) -> dict:
        if self._totals is None:
            one = self.rows.agg(self.of("base", F.col("_metric")).alias("base"), self.of("event", F.col("_metric")).alias("event"), F.count(F.when(F.col("_event"), 1)).alias("ne"), F.count(F.when(F.col("_base"), 1)).alias("nb")).first().asDict()
            if not one["ne"] or not one["nb"]:
                raise ValueError("a window holds no rows")
            self._totals = one | {"delta": one["event"] - one["base"], "pct": (one["event"] - one["base"]) / max(abs(one["base"]), SMALL) * 100}
        return self._totals

    def _segmented(self) -> DataFrame:
        """The windows' rows once for each dimension, with segment: one of the 20 largest of all known rows, else Other."""
        def named(name: str) -> Column:
            c = F.col(f"`{name}`")
            text = F.when(c, "True").otherwise("False") if isinstance(kind(self.df, name), T.BooleanType) else c.cast("string")
            return F.struct(F.lit(name).alias("dimension"), F.when(c.isNotNull(), text).alias("raw"))

        every = F.explode(F.array(*[named(n) for n in self.dims])).alias("d")
        named_values = self.known.select(*[F.coalesce(named(n)["raw"], F.lit("nan")).alias(n) for n in self.dims])
        top = heavy_hitters(named_values, self.dims, TOP).rows.select(F.col("column").alias("dimension"), F.col("value").alias("segment"), F.lit(True).alias("_top"))
        long = self.rows.select("_day", "_metric", "_event", "_base", every).select("_day", "_metric", "_event", "_base", F.col("d.dimension").alias("dimension"), F.coalesce("d.raw", F.lit("Unknown")).alias("segment"))
        marked = long.join(F.broadcast(top), ["dimension", "segment"], "left")  # at most 20 for each dimension
        return marked.withColumn("segment", F.when(F.col("_top"), F.col("segment")).otherwise("Other")).drop("_top")

    def segments(self) -> DataFrame:
        """dimension, segment, baseline, event, delta, growth_pct, contribution_pct, baseline_mean, baseline_std, z_score, significant."""
        if not self.dims:
            raise ValueError("there are no dimensions to explain by")
        total, long = self.total(), self._segmented()
        made = long.groupBy("dimension", "segment").agg(self.of("base", F.col("_metric")).alias("b"), self.of("event", F.col("_metric")).alias("e"))
        how = {"sum": F.sum, "avg": F.avg, "count": F.count}[self.request.aggregation]
        daily = long.filter("_base").groupBy("dimension", "segment", "_day").agg(how("_metric").cast("double").alias("v"))
        days = self.rows.filter("_base").select("_day").distinct().agg(F.count(F.lit(1)).alias("days"))
        # days of the baseline without rows of a segment count as 0: they widen the spread of those there are by its distance from 0
        sums = daily.groupBy("dimension", "segment").agg(F.sum("v").alias("s"), F.avg("v").alias("m"), F.var_pop("v").alias("var"), F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("seen"))
        scored = made.join(sums, ["dimension", "segment"], "left").join(F.broadcast(days))  # one row
        n, mean = F.col("days"), F.col("s") / F.col("days")
        flat = (F.col("least") == F.col("most")) & ((F.col("seen") == n) | (F.col("most") == 0))
        std = F.when(F.col("s").isNotNull() & (n >= 2), F.when(flat, 0.0).otherwise(F.sqrt(F.col("seen") * (F.col("var") + F.col("m") * F.col("m") * (n - F.col("seen")) / n) / (n - 1))))
        tight = std < 1e-6
        z = F.when(std.isNull(), None).when(tight & (F.abs(F.col("e") - mean) < 1e-6), 0.0).when(tight, None).otherwise((F.col("e") - mean) / std)
        shifted = F.coalesce(tight & (F.abs(F.col("e") - mean) >= 1e-6), F.lit(False))
        delta = F.col("e") - F.col("b")
        share = F.lit(None).cast("double") if abs(total["delta"]) < NO_CHANGE else r2(delta / F.lit(total["delta"]) * 100)
        return scored.select(
            "dimension",
            "segment",
            r4(F.col("b")).alias("baseline"),
            r4(F.col("e")).alias("event"),
            r4(delta).alias("delta"),
            r2(delta / F.greatest(F.abs("b"), F.lit(SMALL)) * 100).alias("growth_pct"),
            share.alias("contribution_pct"),
            r4(F.coalesce(mean, F.lit(0.0))).alias("baseline_mean"),
            r4(std).alias("baseline_std"),
            r4(z).alias("z_score"),
            (shifted | F.coalesce(F.abs(z) >= SIGNIFICANT, F.lit(False))).alias("significant"),
        )

    def drivers(self) -> DataFrame:
        """The segments with rank within their dimension and sign, up to top_k."""
        by = Window.partitionBy("dimension", F.col("delta") > 0).orderBy(F.desc(F.abs("delta")), "segment")
        return self.segments().filter("delta <> 0").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= self.request.top_k)

    def primary(self) -> DataFrame:
        return self.segments().orderBy(F.desc(F.abs("delta")), "dimension", "segment").limit(min(MAX_DRIVERS, 2 * self.request.top_k))

    def coverage(self) -> DataFrame:
        """dimension, coverage_pct: how much of the change the listed drivers account for, regardless of sign."""
        return self.drivers().groupBy("dimension").agg(r2(F.sum(F.abs(F.coalesce("contribution_pct", F.lit(0.0))))).alias("coverage_pct"))

    def reconciliation(self) -> DataFrame:
        """sum_of_deltas, total_delta, discrepancy, reconciled, n_segments of the first dimension."""
        total = self.total()["delta"]
        one = self.segments().filter(F.col("dimension") == self.dims[0]).agg(F.sum("delta").alias("s"), F.count(F.lit(1)).alias("n_segments"))
        gap = F.round(F.abs(F.lit(total) - F.col("s")), 4)
        return one.select(r4(F.col("s")).alias("sum_of_deltas"), r4(F.lit(total)).alias("total_delta"), gap.alias("discrepancy"), (gap <= max(1e-4, 0.0005 * abs(total))).alias("reconciled"), "n_segments")

    def secondary(self) -> DataFrame:
        """metric, baseline, event, delta, growth_pct, direction, elasticity, elasticity_status of the other numeric columns."""
        names = self.request.secondary
        if names is None:
            names = [f.name for f in self.df.schema if is_numeric(f.dataType) and f.name not in (self.request.metric_column, self.request.date_column)][:3]
        total = self.total()
        if not names:
            return self.df.sparkSession.createDataFrame([], "metric string, baseline double, event double, delta double, growth_pct double, direction string, elasticity double, elasticity_status string")
        one = self.rows.agg(*[self.of(w, number(self.df, n)).alias(f"{w}{i}") for i, n in enumerate(names) for w in ("base", "event")])
        long = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"base{i}").alias("b"), F.col(f"event{i}").alias("e")) for i, n in enumerate(names)])))
        delta = F.col("e") - F.col("b")
        growth = delta / F.greatest(F.abs("b"), F.lit(SMALL)) * 100
        still = abs(total["pct"]) < 1e-6 or abs(total["base"]) < 1e-6
        status = F.lit("undefined_zero_primary_change") if still else F.when(F.abs("b") < SMALL, "undefined_zero_secondary_baseline").otherwise("ok")
        elasticity = F.lit(None).cast("double") if still else F.when(F.abs("b") >= SMALL, r4(growth / F.lit(total["pct"])))
        direction = F.when(F.abs(delta) < 1e-6, "neutral").when(F.signum(delta) == F.lit(float((total["delta"] > 0) - (total["delta"] < 0))), "concordant").otherwise("divergent")
        return long.select("metric", r4(F.col("b")).alias("baseline"), r4(F.col("e")).alias("event"), r4(delta).alias("delta"), r2(growth).alias("growth_pct"), direction.alias("direction"), elasticity.alias("elasticity"), status.alias("elasticity_status"))

    def narrative(self) -> DataFrame:
        """One row: what happened, in words, from the few rows of the other results."""
        t, top = self.total(), self.primary().collect()  # at most 40 rows
        said = [
            f"{self.request.metric_column} ({self.request.aggregation}) went from {t['base']:,.2f} in {self.base_start} to {self.base_end} to {t['event']:,.2f} in {self.event_start} to {self.event_end}: {t['delta']:+,.2f} ({t['pct']:+.2f}%)."
        ]
        if abs(t["delta"]) < NO_CHANGE:
            said.append("Rises and falls of segments cancel out.")
        if top:
            share = "" if top[0]["contribution_pct"] is None else f", {top[0]['contribution_pct']:+.1f}% of the change"
            said.append(f"The largest move is {top[0]['dimension']}={top[0]['segment']} with {top[0]['delta']:+,.2f}{share}.")
        unusual = [f"{r['dimension']}={r['segment']}" for r in top if r["significant"]][:3]
        if unusual:
            said.append(f"Unusual against the baseline's days: {', '.join(unusual)}.")
        if top and top[0]["z_score"] is not None:
            said.append(f"It lies {top[0]['z_score']:+.2f} deviations off the baseline's daily mean.")
        for r in self.secondary().collect():  # a row for each named metric
            said.append(f"{r['metric']} moved {r['growth_pct']:+.2f}% ({r['direction']}).")
        if self.dims:
            r = self.reconciliation().first()
            said.append(f"Segments of {self.dims[0]} add up to {r['sum_of_deltas']:+,.2f} of {r['total_delta']:+,.2f} ({'reconciled' if r['reconciled'] else 'not reconciled'}).")
        return self.df.sparkSession.createDataFrame([(" ".join(said),)], "narrative string")
