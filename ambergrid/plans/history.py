"""Bounded, redacted history of queries and traces of their stages."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from pathlib import Path

from ..functions.canonical import canonical
from ..operators.snapshots import write_atomic

VERSION = "V03G9_QUERY_HISTORY_AND_EXPLAIN_TRACE"
SECRETS = frozenset("secret token password api_key authorization credential".split())
TEXT, ITEMS, DEPTH, ENTRIES = 240, 32, 5, 1000
STAGES = tuple("parse plan filter execute return".split())


def normal(text: object) -> str:
    return "" if text is None else " ".join(str(text).split())


def query_hash(text: object, plan_version: str) -> str:
    return hashlib.sha256(f"{normal(text)}\n{plan_version}".encode(errors="replace")).hexdigest()


def cut(value: object) -> str:
    text = str(value)
    return text if len(text) <= TEXT else f"{text[:TEXT]}...[TRUNCATED]"


def clean(value: object, depth: int = 0) -> object:
    """A value fit for a log: secrets redacted, long texts, lists and objects cut, depth bounded."""
    if depth > DEPTH:
        return "<max_depth_reached>"
    match value:
        case None | bool() | int() | float():
            return value
        case str():
            return cut(value)
        case bytes():
            return f"<bytes len={len(value)}>"
        case dict():
            kept = list(value.items())[:ITEMS]
            out = {cut(k): "[REDACTED]" if str(k).lower() in SECRETS else clean(v, depth + 1) for k, v in kept}
            return out | ({"__truncated_items__": len(value) - ITEMS} if len(value) > ITEMS else {})
        case list() | tuple() | set():
            more = [{"__truncated_items__": len(value) - ITEMS}] if len(value) > ITEMS else []
            return [clean(x, depth + 1) for x in list(value)[:ITEMS]] + more
    return cut(f"<{type(value).__name__}:{value}>")


def _with_folder(path: str | Path) -> Path:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return Path(path)


def record(path: str | Path, text: str, status: str, elapsed_ms: int, result_count: int, plan_version: str = VERSION, extras: dict | None = None, keep: int = ENTRIES) -> dict:
    """Append an entry and keep the newest ``keep`` of them."""
    row = {"query_hash": query_hash(text, plan_version), "timestamp": int(time.time() * 1000), "status": cut(status), "elapsed_ms": max(0, int(elapsed_ms or 0)), "result_count": max(0, int(result_count or 0))}
    row |= {"plan_version": cut(plan_version), "safety_flags": dict.fromkeys(("read_only", "no_write"), True), "extras": clean(extras or {}), "feature_version": VERSION, "bounded_metadata_only": True}
    path = _with_folder(path)
    old = [x for x in path.read_text(errors="replace").splitlines() if x.strip()] if path.exists() else []
    lines = [*old, canonical(row).decode()]
    write_atomic(path, "".join(f"{x}\n" for x in lines[-max(1, int(keep)) :]).encode())
    return row


def stages(status: str, elapsed_ms: int, result_count: int) -> list[dict]:
    """The five stages of a query, its time dealt out evenly."""
    total = max(0, int(elapsed_ms))
    start, share = int(time.time() * 1000) - total, total // len(STAGES)
    out = []
    for k, name in enumerate(STAGES):
        began, ended = start + k * share, start + (total if name == STAGES[-1] else (k + 1) * share)
        note = f"returned_count={result_count}" if name == "return" and status == "ok" else ("done" if status == "ok" else f"not completed: {status}")
        out.append({"name": name, "started_at": began, "finished_at": ended, "elapsed_ms": ended - began, "summary": note, "diagnostics": {}})
    return out


def trace(folder: str | Path, key: str, steps: list[dict], plan_version: str = VERSION, extras: dict | None = None) -> str:
    """Write a trace document, its stages in order; returns its path."""
    by_name = {s.get("name"): s for s in steps if isinstance(s, dict)}
    now = int(time.time() * 1000)
    none = {"started_at": now, "finished_at": now, "elapsed_ms": 0, "summary": "stage metadata unavailable", "diagnostics": {}}
    doc = {"query_hash": str(key), "created_at": now, "type": "BQL_EXPLAIN_TRACE", "plan_version": cut(plan_version), "feature_version": VERSION}
    doc |= {"bounded_metadata_only": True, "extras": clean(extras or {}), "stages": [clean(by_name.get(n) or {"name": n} | none) for n in STAGES]}
    name = re.sub(r"[^\w-]", "", str(key)) or hashlib.sha256(str(key).encode(errors="replace")).hexdigest()
    path = _with_folder(Path(folder) / f"{name[:128]}.json")
    write_atomic(path, json.dumps(doc, sort_keys=True, ensure_ascii=False, indent=2).encode())
    return str(path)
