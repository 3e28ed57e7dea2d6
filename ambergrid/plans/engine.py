"""Text to result: parse, plan, run, envelope; and a session that remembers its memories."""

from __future__ import annotations

import html
import json
import os
import time
import traceback
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..lang import bql
from ..lang.bql import Lookup
from ..lang.errors import code_of
from ..operators import lookup
from ..sources import records
from ..sources.scratch import discard, persist
from . import history

VERSION, CONTRACT = "V03G8_TS_INDEX_FOR_TIME_FILTER", "V03H4B_TARGET_STATE_BQL_COMPAT"
_SAFE = dict.fromkeys("read_only no_write no_wal no_vector_engine no_network no_full_graph_export".split(), True)


def ranged(query: Lookup) -> bool:
    """Whether a filter bounds ts in a way that a range index (here: column statistics) can serve."""
    return any(f["field"] == "ts" and (f["op"] in "<>" or f.get("window") == "last_hour") for f in query.filters)


def explain(query: Lookup, index_used: bool = False) -> dict:
    """The steps of a query as metadata; see ``DataFrame.explain`` for what Spark makes of it."""
    candidate = ranged(query)
    used = candidate and index_used
    reason = "no timestamp filter that an index serves"
    if candidate:
        reason = f"timestamp filter present, range lookup {'used' if used else 'unavailable'}"
    first = {"stage": "seed_lookup", "bounded": True, "source_kind": query.kind, "source_value": query.value}
    second = {"stage": "balloon_expand", "max_radius": bql.MAX_RADIUS, "radius": query.radius, "direction": query.direction, "no_full_graph_export": True}
    steps = [first, second]
    if used:
        steps.append({"stage": "ts_index_range_lookup", "field": "ts", "persisted_index": False, "candidate_only": True, "uses_wal": False})
    if query.filters:
        timed = {"predicate_kind": "time", "time_filter": True} if any(f["field"] == "ts" for f in query.filters) else {}
        origin = {"candidate_source": "ts_index_range_lookup"} if used else {}
        steps.append({"stage": "filter", "applied_inside_balloon": True, "predicates": [dict(f) for f in query.filters]} | timed | origin)
    steps.append({"stage": "return", "returns_full_graph": False, "bounded_result": True, "fields": list(query.fields)})
    head = {"type": "BQL_EXPLAIN_PLAN", "read_only": True, "version": VERSION, "feature_version": VERSION}
    index = {"ts_index_candidate": candidate, "ts_index_used": used, "ts_index_reason": reason}
    return head | index | {"steps": [s | {"read_only": True} for s in steps], "safety": {k: v for k, v in _SAFE.items() if k != "read_only"}}


def _keys(query: Lookup) -> list[str]:
    return [*lookup._SOURCE_KEYS[query.kind], "id", "record_id", "depth", "rank", *(f["field"] for f in query.filters)]


def _json_rows(memory: DataFrame, query: Lookup, now_ms: int, limit: int) -> list[dict]:
    """Result rows of a JSON memory, values as they stand in the records."""
    typed = bql.Lookup(query.kind, query.value, query.radius, query.direction, ("raw", "ord"), query.filters, query.top)
    text = memory.drop("rank") if "rank" in memory.columns else memory
    out = []
    for row in lookup.run(text, typed, now_ms, limit).orderBy("ord").collect():
        record = json.loads(row["raw"])
        record.setdefault("record_id", record.get("id", row["ord"]))
        record.setdefault("depth", 0)
        record.setdefault("rank", row["rank"])
        out.append({f: record.get(f) for f in dict.fromkeys([*query.fields, "rank", "depth", "record_id"])})
    return out


class Session:
    """Runs queries against memories: a path of JSON files, or a DataFrame with ``ord``.

    Memories by path are read once and kept as tables in the shared folder, so they must not change;
    ``forget`` drops them.
    """

    def __init__(self, spark: SparkSession, now: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.now = spark, now
        self._kept: dict[str, DataFrame] = {}
        self.stats = {"queries": 0, "cache_hits": 0, "cache_misses": 0}

    def memory(self, source: str | os.PathLike | DataFrame) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        key = str(source)
        self.stats["cache_hits" if key in self._kept else "cache_misses"] += 1
        if key not in self._kept:
            self._kept[key] = persist(records.read_json(self.spark, key), "memory")
        return self._kept[key]

    def forget(self) -> None:
        while self._kept:
            discard(self._kept.popitem()[1])

    def rows(self, text: str, source: str | DataFrame, max_results: int = lookup.MAX_ROWS) -> DataFrame:
        """The result as a DataFrame, for a memory with typed columns."""
        return lookup.run(self.memory(source), bql.parse(text), self.now(), max_results)

    def execute(self, text: str, source: str | DataFrame, max_results: int = lookup.MAX_ROWS) -> dict:
        query, now = bql.parse(text), self.now()
        self.stats["queries"] += 1
        memory = self.memory(source)
        limit = max(1, min(int(max_results or lookup.MAX_ROWS), lookup.MAX_ROWS))
        if "raw" in memory.columns:
            memory = records.with_keys(memory, _keys(query))
            results = _json_rows(memory, query, now, limit)
        else:
            results = [r.asDict(recursive=True) for r in lookup.run(memory, query, now, limit).orderBy("rank").collect()]
        total = lookup.counts(memory, query, now, limit).first().asDict()
        used = ranged(query)
        body = {"status": "PASS_V03G8_BQL_QUERY_EXECUTED", "version": VERSION, "ts": now, "ast": query.as_dict(), "plan": explain(query, used), "safety": dict(_SAFE)}
        return body | {"balloon_expand": total | {"results": results}}

    def contract(self, text: str, source: str | DataFrame, max_results: int = lookup.MAX_ROWS, with_trace: bool = False) -> dict:
        """An ok or error envelope; never raises for a bad query."""
        head = {"feature_version": CONTRACT, "query": text}
        try:
            result = self.execute(text, source, max_results)
        except Exception as error:  # the envelope carries it
            code = code_of(error)
            body = {"code": code, "class": type(error).__name__, "message": str(error), "retryable": False}
            trace = {"trace": traceback.format_exc()} if with_trace else {}
            return {"ok": False, "status": code, "result": None, "error": body} | head | trace
        return {"ok": True, "status": "PASS_V03G2_BQL_QUERY_EXECUTED", "engine_status": result["status"], "result": result, "error": None} | head

    def execute_logged(self, text: str, source: str | DataFrame, log: str | Path, traces: str | Path, keep: int = history.ENTRIES) -> dict:
        """``execute`` with an entry in the history and a trace, whether it works, is refused or fails."""
        began = self.now()
        key = history.query_hash(text, history.VERSION)

        def note(status: str, count: int, extras: dict) -> str:
            elapsed = self.now() - began
            history.record(log, text, status, elapsed, count, extras=extras, keep=keep)
            return history.trace(traces, key, history.stages(status, elapsed, count), extras={"history_status": status})

        try:
            result = self.execute(text, source)
        except Exception as error:
            note("rejected" if isinstance(error, ValueError) else "error", 0, {"error_type": type(error).__name__, "error": str(error)})
            raise
        path = note("ok", result["balloon_expand"]["returned_count"], {"executor_status": result["status"]})
        return result | {"query_history": {"query_hash": key, "trace_path": path, "bounded_metadata_only": True}}

    def handle(self, request: dict) -> dict:
        """One request of the line protocol: query, stats or shutdown."""
        match request.get("cmd", "query"):
            case "stats":
                return {"ok": True, "stats": dict(self.stats) | {"memories": len(self._kept)}}
            case "query":
                return self.contract(request.get("query", ""), request["memory"], request.get("max_results", lookup.MAX_ROWS))
            case "shutdown":
                self.forget()
                return {"ok": True, "status": "BYE"}
        return {"ok": False, "status": "UNKNOWN_COMMAND"}


def write_jsonl(path: str | Path, rows: list[dict]) -> None:
    Path(path).write_text("".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows))


def write_html(path: str | Path, rows: list[dict], title: str = "Results") -> None:
    """A table of result rows, every value escaped."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    line = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    body = "\n".join([line("th", names), *(line("td", [r.get(n, "") for n in names]) for r in rows)])
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>\n<table>\n{body}\n</table>\n")


def check_roles(path: str | Path, layers: tuple[str, ...]) -> list[str]:
    """Layers that a role map (JSON object, its layers under ``layers``) lacks."""
    found = json.loads(Path(path).read_text()).get("layers", {})
    return [x for x in layers if x not in found]
