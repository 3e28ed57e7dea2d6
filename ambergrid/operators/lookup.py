"""Lookups as DataFrame plans: source match, rank, filter, projection, limit.

A *memory* is a DataFrame whose rows are records. ``ord`` numbers them in load order (unique, not
necessarily dense); every other column is a record key, and null means that the key is absent.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values
from ..lang import time_filter
from ..lang.bql import Lookup

ORD = "ord"
_SOURCE_KEYS = {
    "seed": "seed seed_id source source_value pattern_id record_id id".split(),
    "concept": "concept concept_id concept_name pattern_id record_id id".split(),
}
MAX_ROWS = 50


def source_match(memory: DataFrame, kind: str, value: str) -> Column:
    """Whether any source key of the record reads as ``value``; only keys that are columns are asked."""
    hits = [values.equals_text(memory, key, value) & F.col(key).isNotNull() for key in _SOURCE_KEYS[kind] if key in memory.columns]
    return reduce(or_, hits, F.lit(False))


def expand(memory: DataFrame, query: Lookup) -> DataFrame:
    """The matching records with ``record_id`` (else id, else position) and ``depth`` (else 0) filled in."""
    rows = memory.where(source_match(memory, query.kind, query.value))
    fallback = F.col("id").cast("string") if "id" in memory.columns else F.lit(None).cast("string")
    fallback = F.coalesce(fallback, F.col(ORD).cast("string"))
    if "record_id" not in memory.columns:
        rows = rows.withColumn("record_id", F.col(ORD) if "id" not in memory.columns else fallback)
    else:
        rows = rows.withColumn("record_id", F.coalesce(F.col("record_id").cast("string"), fallback))
    depth = F.coalesce(F.col("depth"), F.lit(0)) if "depth" in memory.columns else F.lit(0)
    return rows.withColumn("depth", depth)


def predicate(rows: DataFrame, condition: dict, now_ms: int, closed_windows: bool = False) -> Column:
    """A filter as a column.

    ``ts IN last_hour`` has no upper end, and the two longer windows match nothing, unless
    ``closed_windows`` asks for the strict rule: closed on both sides, ending now.
    """
    name, op, value = condition.get("field"), condition.get("op"), condition.get("value")
    if name == "ts":
        if op == ">":
            return values.after(rows, int(value))
        if op == "<":
            return values.before(rows, int(value))
        if op == "in_window":
            width = time_filter.WINDOWS[condition["window"]]
            if closed_windows:
                return values.after(rows, now_ms - width - 1) & values.before(rows, now_ms + 1)
            return values.after(rows, now_ms - width) if condition["window"] == "last_hour" else F.lit(False)
        return F.lit(False)
    if op == "=":
        return values.equals_text(rows, name, value)
    if op in ("<", ">") and name in rows.columns:
        left, right = F.col(name).try_cast("double"), F.lit(str(value)).try_cast("double")
        return F.coalesce(left > right if op == ">" else left < right, F.lit(False))
    return F.lit(False)


def matched(memory: DataFrame, query: Lookup, now_ms: int, closed_windows: bool = False) -> DataFrame:
    """Expanded records that pass all filters, without ranks."""
    rows = expand(memory, query)
    for condition in query.filters:
        rows = rows.where(predicate(rows, condition, now_ms, closed_windows))
    return rows


def _project(rows: DataFrame, query: Lookup) -> DataFrame:
    names = list(dict.fromkeys([*query.fields, "rank", "depth", "record_id"]))
    return rows.select(*[F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names])


def run(memory: DataFrame, query: Lookup, now_ms: int, limit: int = MAX_ROWS, closed_windows: bool = False) -> DataFrame:
    """The query's rows.

    ``rank`` counts all records of the source up to this one, filtered or not. Only the returned
    rows need it: they are cut off first, then each record of the source is counted once, for the first returned
    row at or after it, and the at most MAX_ROWS counts are added up. A row_number over everything
    would send the whole source to one task.
    """
    wanted = max(1, min(query.top or limit, limit, MAX_ROWS))
    rows = matched(memory, query, now_ms, closed_windows)
    if "rank" in memory.columns:
        return _project(rows.orderBy(ORD).limit(wanted), query)
    top = rows.orderBy(ORD).limit(wanted)
    marks = top.agg(F.sort_array(F.collect_list(ORD)).alias("m")).scalar()  # at most MAX_ROWS numbers
    source = memory.where(source_match(memory, query.kind, query.value)).select(F.col(ORD).alias("_at"))
    slot = F.element_at(F.filter("_m", lambda m: m >= F.col("_at")), 1).alias("_ord")
    counted = source.withColumn("_m", marks).where(F.col("_at") <= F.array_max("_m")).groupBy(slot).agg(F.count("*").alias("n"))
    ranks = counted.select("_ord", F.sum("n").over(Window.orderBy("_ord")).alias("rank"))
    return _project(top.join(F.broadcast(ranks), F.col(ORD) == F.col("_ord")), query)


def counts(memory: DataFrame, query: Lookup, now_ms: int, limit: int = MAX_ROWS) -> DataFrame:
    """``expanded_count``, ``matched_count``, ``returned_count`` in one pass."""
    rows = expand(memory, query)
    hit = F.lit(True)
    for condition in query.filters:
        hit = hit & predicate(rows, condition, now_ms)
    wanted = max(1, min(query.top or limit, limit, MAX_ROWS))
    total = rows.agg(F.count("*").alias("expanded_count"), F.count_if(hit).alias("matched_count"))
    return total.withColumn("returned_count", F.least("matched_count", F.lit(wanted).cast("bigint")))
