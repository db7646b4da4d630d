"""A JSON filter language over tables, compiled to one Column that Catalyst pushes into the scan."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TRUE, _FALSE = {"true", "1", "yes"}, {"false", "0", "no"}


def coerce(value: Any, kind: T.DataType) -> Any:
    """``value`` as the column's type has it; unchanged where that fails."""
    if isinstance(value, list):
        return [coerce(v, kind) for v in value]
    try:
        if isinstance(kind, T.BooleanType) and not isinstance(value, bool):
            word = str(value).strip().lower()
            return True if word in _TRUE else False if word in _FALSE else value
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, (T.FractionalType, T.DecimalType)):
            return float(value)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, str):
            return datetime.datetime.fromisoformat(value)
        if isinstance(kind, T.DateType) and isinstance(value, str):
            return datetime.date.fromisoformat(value)
    except (TypeError, ValueError):
        return value
    return value


def _fractional(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def _missing(c: Column, kind: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if _fractional(kind) else c.isNull()


_OPERATORS: dict[str, Callable[[Column, Any, T.DataType], Column]] = {
    "eq": lambda c, v, _: c == F.lit(v),
    "neq": lambda c, v, _: ~c.eqNullSafe(F.lit(v)),  # true for nulls
    "gt": lambda c, v, _: c > F.lit(v),
    "gte": lambda c, v, _: c >= F.lit(v),
    "lt": lambda c, v, _: c < F.lit(v),
    "lte": lambda c, v, _: c <= F.lit(v),
    "contains": lambda c, v, _: c.cast("string").rlike("(?i)" + str(v)),
    "in": lambda c, v, _: c.isin(v),
    "between": lambda c, v, _: c.between(F.lit(v[0]), F.lit(v[1])),
    "is_null": lambda c, _, kind: _missing(c, kind),
    "not_null": lambda c, _, kind: ~_missing(c, kind),
}


def condition(df: DataFrame, spec: dict[str, Any]) -> Column:
    """The Column of one {column, operator, value}: true where it holds, false or null elsewhere; ValueError for what the language doesn't know."""
    name, op = spec.get("column"), spec.get("operator")
    if name not in df.columns:
        raise ValueError(f"unknown column {name!r}")
    if op not in _OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    value = spec.get("value")
    if op not in ("is_null", "not_null") and value is None:
        raise ValueError(f"{op} needs a value")
    if op == "in" and not isinstance(value, list):
        raise ValueError("in needs a list")
    if op == "between" and not (isinstance(value, list) and len(value) == 2):
        raise ValueError("between needs two values")
    kind = df.schema[name].dataType
    value = value if op == "contains" else coerce(value, kind)
    found = _OPERATORS[op](F.col(name), value, kind)
    # Spark ranks NaN above infinity; here it is above nothing.  Unlike isnan(), the comparison reaches the scan.
    return found & (F.col(name) <= float("inf")) if op in ("gt", "gte") and _fractional(kind) else found


def compile_filter(df: DataFrame, conditions: list[dict[str, Any]], combine: str = "and") -> Column:
    if combine not in ("and", "or"):
        raise ValueError(f"combine must be and or or, not {combine!r}")
    parts = [condition(df, c) for c in conditions]
    return reduce(lambda a, b: a & b if combine == "and" else a | b, parts)


def filter_table(df: DataFrame, conditions: list[dict[str, Any]], combine: str = "and", *, order: list[str], limit: int = 20, sample: int = 5) -> DataFrame:
    """The first ``limit`` matches by ``order``; without conditions the first ``sample`` rows."""
    if not conditions:
        return df.orderBy(*order).limit(sample)
    return df.where(compile_filter(df, conditions, combine)).orderBy(*order).limit(limit)
