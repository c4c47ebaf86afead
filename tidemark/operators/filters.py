"""Predicates. Clauses AND together; typed comparisons are used where they say the same, so they reach the scan."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import canonical, day, kind, number
from tidemark.plans.requests import Filter


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; there are {df.columns}")


def _literal(df: DataFrame, name: str, text: str):
    """text as a value of the column's own type if exactly that value prints as text, else None."""
    dtype = kind(df, name)
    if isinstance(dtype, T.StringType):
        return text
    try:
        if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            return int(text) if str(int(text)) == text else None
        if isinstance(dtype, T.DoubleType):
            value = float(text)
            return value if str(value) == text and 1e-3 <= abs(value) < 1e7 else None
    except ValueError:
        pass
    return None


def _equal(df: DataFrame, name: str, value) -> Column:
    text = str(value)
    typed = _literal(df, name, text)
    if typed is not None:
        return F.col(f"`{name}`") == F.lit(typed)
    return canonical(df, name) == F.lit(text)


def _double(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise ValueError(f"{value!r} is no number") from None


def predicate(df: DataFrame, f: Filter) -> Column:
    """eq and in compare text, neq too but keeps nulls; the rest compare numbers, and what is none never matches."""
    require(df, [f.column])
    if f.op == "eq":
        return _equal(df, f.column, f.value)
    if f.op == "neq":
        return ~_equal(df, f.column, f.value) | F.col(f"`{f.column}`").isNull()
    if f.op == "in":
        if not isinstance(f.value, (list, tuple)) or not f.value:
            raise ValueError("in needs a list with a value at least")
        typed = [_literal(df, f.column, str(v)) for v in f.value]
        if all(t is not None for t in typed):
            return F.col(f"`{f.column}`").isin(typed)
        return canonical(df, f.column).isin([str(v) for v in f.value])
    c = F.col(f"`{f.column}`") if isinstance(kind(df, f.column), (T.IntegralType, T.DoubleType)) else number(df, f.column)
    if f.op == "between":
        if not isinstance(f.value, (list, tuple)) or len(f.value) != 2:
            raise ValueError("between needs two values")
        low, high = sorted(map(_double, f.value))
        return c.between(low, high)
    value = _double(f.value)
    return {"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[f.op]


def apply_filters(df: DataFrame, filters: list[Filter]) -> DataFrame:
    for f in filters:
        df = df.filter(predicate(df, f))
    return df


def date_window(df: DataFrame, name: str, start: date, end: date) -> DataFrame:
    """Rows whose calendar date lies in the window, both ends included."""
    return df.filter(day(df, name).between(F.lit(start), F.lit(end)))


def valid_rows(df: DataFrame, date_column: str, metric_column: str) -> DataFrame:
    return df.filter(day(df, date_column).isNotNull() & number(df, metric_column).isNotNull())
