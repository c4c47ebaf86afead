"""Column expressions that the operators share: coercions, canonical text, calendar buckets, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as null in CSV text.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Date layouts, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy"]
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
GRANULARITIES = ("day", "week", "month", "quarter", "year")


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def number(df: DataFrame, name: str) -> Column:
    """The column as double; what is no number is null, NaN too."""
    dtype, c = kind(df, name), F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def moment(df: DataFrame, name: str) -> Column:
    """The column as timestamp without zone; text is tried in DATE_FORMATS, numbers are no dates."""
    dtype, c = kind(df, name), F.col(f"`{name}`")
    if is_moment(dtype):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        # a failed attempt is dear, so only short text with a year and a separator is tried, and no decimal numbers
        likely = ~c.rlike(_NUMBER) & c.rlike(r"^\s*[A-Za-z0-9][A-Za-z0-9 ,./:-]{6,28}\s*$") & c.rlike(r"[0-9]{4}") & c.rlike(r"[-/., :]")
        return F.when(likely, F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]))
    return F.lit(None).cast("timestamp_ntz")


def day(df: DataFrame, name: str) -> Column:
    return moment(df, name).cast("date")


def canonical(df: DataFrame, name: str) -> Column:
    """The text by which equality filters compare."""
    c = F.col(f"`{name}`")
    if isinstance(kind(df, name), T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def bucket(when: Column, granularity: str) -> Column:
    """The label of the period that holds a date. Weeks run Tuesday to Monday and are named by that Monday."""
    if granularity == "day":
        return when.cast("date")
    if granularity == "week":
        return F.next_day(F.date_sub(when.cast("date"), 1), "MON")
    return F.trunc(when.cast("date"), granularity)


def step(granularity: str) -> Column:
    months = {"month": 1, "quarter": 3, "year": 12}
    if granularity in months:
        return F.make_interval(months=F.lit(months[granularity]))
    return F.make_dt_interval(days=F.lit(7 if granularity == "week" else 1))


def r4(value: Column) -> Column:
    return F.round(value, 4)


def r2(value: Column) -> Column:
    return F.round(value, 2)


def percent_change(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before) * 100


def aggregate_of(value: Column, how: str) -> Column:
    known = {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}
    return known[how](value)


def slug(name: Column) -> Column:
    """Lower case, every run of other signs than letters and digits one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def json_ready(df: DataFrame) -> DataFrame:
    """df with values that JSON can hold: no NaN or infinity, four decimals, dates and times as ISO text, decimals as doubles, bytes as base64."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.round(c, 4))
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        out.append(c.alias(f.name))
    return df.select(*out)
