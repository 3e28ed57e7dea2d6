"""Comparisons and conversions with the semantics of schemaless records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

_WHOLE = re.compile(r"[+-]?\d+", re.ASCII)


def equals_text(df: DataFrame, name: str, value: object) -> Column:
    """Whether the Python text of a column equals that of ``value``.

    Compares in the column's own type wherever the text can only stem from one value, so that the
    predicate reaches the scan. A missing or null field reads as None.
    """
    text = str(value)
    if name not in df.columns:
        return F.lit(text == "None")
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    match kind:
        case T.StringType():
            same = col == text
        case T.BooleanType():
            same = col == (text == "True") if text in ("True", "False") else F.lit(False)
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType() | T.DecimalType():
            same = col == F.lit(text).cast(kind) if _WHOLE.fullmatch(text) and str(int(text)) == text else F.lit(False)
        case T.FloatType() | T.DoubleType():
            same = _same_float(col, text)
        case _:
            same = col.cast("string") == text
    return (same | col.isNull()) if text == "None" else same


def _same_float(col: Column, text: str) -> Column:
    try:
        number = float(text)
    except ValueError:
        return F.lit(False)
    return col == number if repr(number) == text else F.lit(False)


def ts_millis(df: DataFrame, name: str = "ts") -> Column:
    """Unix milliseconds of a field: numbers as they are, text as number or ISO 8601, timestamps floored; else null."""
    if name not in df.columns:
        return F.lit(None).cast("bigint")
    kind, col = df.schema[name].dataType, F.col(name)
    match kind:
        case T.TimestampType() | T.TimestampNTZType():
            return F.unix_millis(col.cast("timestamp"))
        case T.StringType():
            text = F.trim(col)
            whole, number = text.rlike(r"^-?[0-9]+$"), text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
            iso = F.unix_millis(F.try_to_timestamp(F.when(text.rlike(r"^[0-9]{4}-"), text)))
            return F.when(whole, text.try_cast("bigint")).when(number, text.try_cast("double").try_cast("bigint")).otherwise(iso)
        case T.BooleanType():
            return F.lit(None).cast("bigint")
        case _:
            return col.try_cast("bigint")


def after(df: DataFrame, millis: int, name: str = "ts") -> Column:
    """``ts_ms > millis``, as a comparison on the column itself where that is a timestamp.

    Milliseconds are floors of microseconds, hence ``ts >= millis + 1``; a function around the
    column would keep the predicate from the scan.
    """
    return _bound(df, name, millis + 1, lower=True)


def before(df: DataFrame, millis: int, name: str = "ts") -> Column:
    """``ts_ms < millis``."""
    return _bound(df, name, millis, lower=False)


def _bound(df: DataFrame, name: str, millis: int, lower: bool) -> Column:
    kind = df.schema[name].dataType if name in df.columns else None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        edge = F.timestamp_millis(F.lit(millis)).cast(kind)
        return F.col(name) >= edge if lower else F.col(name) < edge
    return ts_millis(df, name) >= millis if lower else ts_millis(df, name) < millis


def parse_ts(value: object) -> int | None:
    """The rule of ``ts_millis`` for one JSON value."""
    match value:
        case bool():
            return None
        case int():
            return value
        case float():
            return int(value) if abs(value) < float("inf") else None
        case str() if value.strip():
            return _parse_ts_text(value.strip())
    return None


def _parse_ts_text(text: str) -> int | None:
    try:
        return int(text) if _WHOLE.fullmatch(text) else int(float(text))
    except (ValueError, OverflowError):
        pass
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        return None
    return int((moment if moment.tzinfo else moment.replace(tzinfo=UTC)).timestamp() * 1000)


def strings_in(value: object) -> Iterator[str]:
    """All strings of a JSON value, keys of objects included, at any depth."""
    todo = [value]
    while todo:
        match todo.pop():
            case str() as text:
                yield text
            case dict() as obj:
                yield from obj
                todo += obj.values()
            case list() as items:
                todo += items


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings(raw: pd.Series) -> pd.Series:
    """Distinct strings of JSON text, sorted; null where the text isn't JSON."""

    def one(text: str | None) -> list[str] | None:
        try:
            return None if text is None else sorted(set(strings_in(json.loads(text))))
        except ValueError:
            return None

    return raw.map(one)


def short(value: object, limit: int = 220) -> str:
    """A record's JSON, keys sorted, cut to ``limit`` characters."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False)
    return text if len(text) <= limit else text[:limit] + "..."
