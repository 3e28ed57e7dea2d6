"""A local line-JSON service around a session, its client, and the command line."""

from __future__ import annotations

import argparse
import json
import socket
import socketserver
import statistics
import sys
import threading
import time

from pyspark.sql import SparkSession

from ..lang import bql
from ..lang.errors import ParseError, code_of
from . import engine

LOCAL = frozenset("localhost 127.0.0.1 ::1".split())
MAX_LINE = 10 * 1024 * 1024


class _Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        if self.client_address[0] not in LOCAL:
            return
        try:
            request = json.loads(self.rfile.readline(MAX_LINE))
            with self.server.lock:
                answer = self.server.session.handle(request)
        except (ValueError, KeyError) as error:
            request, answer = {}, {"ok": False, "status": code_of(error)}
        self.wfile.write(json.dumps(answer, ensure_ascii=False, default=str).encode() + b"\n")
        if request.get("cmd") == "shutdown":
            threading.Thread(target=self.server.shutdown).start()


class Service(socketserver.ThreadingTCPServer):
    """Serves one session on a local address only."""

    allow_reuse_address, daemon_threads = True, True

    def __init__(self, session: engine.Session, host: str = "127.0.0.1", port: int = 0):
        if host not in LOCAL:
            raise PermissionError("the service listens on local addresses only")
        self.session, self.lock = session, threading.RLock()
        super().__init__((host, port), _Handler)


def ask(port: int, request: dict, host: str = "127.0.0.1", timeout: float = 60) -> dict:
    with socket.create_connection((host, port), timeout) as link:
        link.sendall(json.dumps(request).encode() + b"\n")
        return json.loads(link.makefile("rb").readline())


def latencies(port: int, request: dict, repeat: int = 20) -> dict:
    """Milliseconds of repeated requests: p50 is the median, p95 the element at int(0.95 n) - 1."""
    taken = []
    for _ in range(repeat):
        began = time.perf_counter()
        ask(port, request)
        taken.append((time.perf_counter() - began) * 1000)
    taken.sort()
    return {"p50": statistics.median(taken), "p95": taken[max(0, int(repeat * 0.95) - 1)], "min": taken[0], "max": taken[-1]}


def main(argv: list[str] | None = None) -> int:
    """``parse``, ``explain`` or ``query``; 0 if all went well, 2 for a query that can't be read, 4 for one that failed."""
    cli = argparse.ArgumentParser(prog="ambergrid")
    cli.add_argument("command", choices=["parse", "explain", "query"])
    cli.add_argument("text")
    cli.add_argument("--memory", default=".")
    cli.add_argument("--jsonl")
    cli.add_argument("--html")
    args = cli.parse_args(argv)
    try:
        query = bql.parse(args.text)
    except ParseError as error:
        refusal = dict(ok=False, message=str(error), status=error.code)
        print(json.dumps(refusal))
        return 2
    if args.command != "query":
        print(json.dumps(query.as_dict() if args.command == "parse" else engine.explain(query), ensure_ascii=False, sort_keys=True))
        return 0
    answer = engine.Session(SparkSession.builder.getOrCreate()).contract(args.text, args.memory)
    rows = answer["result"]["balloon_expand"]["results"] if answer["ok"] else []
    if args.jsonl:
        engine.write_jsonl(args.jsonl, rows)
    if args.html:
        engine.write_html(args.html, rows)
    print(json.dumps(answer, ensure_ascii=False, sort_keys=True, default=str))
    return 0 if answer["ok"] else 4


if __name__ == "__main__":
    sys.exit(main())
