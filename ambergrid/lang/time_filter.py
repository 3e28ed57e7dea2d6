"""Predicates on ``ts``: two comparisons with unix milliseconds and three named windows."""

from __future__ import annotations

import re

from .errors import TimeFilterError

HOUR_MS = 3_600_000
WINDOWS = {"last_hour": HOUR_MS, "last_day": 24 * HOUR_MS, "last_7_days": 168 * HOUR_MS}


def parse(text: str) -> dict:
    """``{field, op, value}`` for ``ts > N`` and ``ts < N``, ``{field, op, window}`` for ``ts IN name``."""
    words = text.strip() if isinstance(text, str) else ""
    if not words:
        raise TimeFilterError("empty time filter")
    if found := re.fullmatch(r"(?i:ts)\s*([<>])\s*(\S+)", words):
        sign, number = found.groups()
        if not (number.isascii() and number.isdigit()):
            raise TimeFilterError("a timestamp is a whole, non-negative number of unix milliseconds")
        return dict(op=sign, value=int(number), field="ts")
    if found := re.fullmatch(r"(?i:ts)\s+(?i:in)\s+(\w+)", words, re.ASCII):
        name = found[1].lower()
        if name not in WINDOWS:
            raise TimeFilterError(f"no timestamp window is called {found[1]}")
        return dict(op="in_window", window=name, field="ts")
    field = re.match(r"[A-Za-z_]\w*\b", words, re.ASCII)
    if field and field[0].lower() != "ts":
        raise TimeFilterError(f"only ts takes the operators of a timestamp filter, not {field[0]}")
    raise TimeFilterError("a timestamp filter is ts > N, ts < N or ts IN " + "|".join(WINDOWS))


def record_ts(value: object) -> int | None:
    """Milliseconds of a JSON value by the strict rule: non-negative whole numbers, or their digits as text."""
    match value.get("ts") if isinstance(value, dict) else value:
        case bool():
            return None
        case int() as n if n >= 0:
            return n
        case float() as x if x >= 0 and x.is_integer():
            return int(x)
        case str() as text if text.strip().isascii() and text.strip().isdigit():
            return int(text)
    return None


def matches(value: object, predicate: dict, now_ms: int) -> bool:
    """The strict rule: windows are closed on both sides and end now."""
    ts = record_ts(value)
    if ts is None:
        return False
    match predicate.get("op"):
        case ">":
            return ts > int(predicate["value"])
        case "<":
            return ts < int(predicate["value"])
        case "in_window" if predicate.get("window") in WINDOWS:
            return now_ms - WINDOWS[predicate["window"]] <= ts <= now_ms
    raise TimeFilterError(f"unknown timestamp predicate {predicate}")
