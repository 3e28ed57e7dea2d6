import json

import pytest
from pyspark.sql import Row, functions as F

from ambergrid.functions import canonical, values
from ambergrid.lang import bql
from ambergrid.operators import graph, index, lookup, replay
from ambergrid.plans import engine, history, service
from ambergrid.sources import records

NOW = 1_700_000_000_000
ROWS = [
    {"record_id": "old", "seed": "s", "ts": NOW - 3 * 3_600_000, "depth": 1},
    {"record_id": "one", "seed": "s", "ts": NOW - 1000, "flag": True, "x": 1.0},
    {"record_id": "two", "seed": "s", "ts": str(NOW - 5), "flag": None, "x": 1},
    {"record_id": "bad", "seed": "s", "ts": "soon"},
    {"id": 7, "seed": "s"},
    {"record_id": "other", "seed": "t", "ts": NOW},
]


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a.jsonl").write_text("﻿" + "\n".join([*map(json.dumps, ROWS[:3]), "not json", "[1]", ""]))
    (tmp_path / "b.json").write_text(json.dumps({"items": [*ROWS[3:], 5]}))
    (tmp_path / "c.jsonl.wal").write_text("{}")
    (tmp_path / "tsindex.json").write_text('{"seed": "s"}')
    return str(tmp_path)


@pytest.fixture
def session(spark):
    return engine.Session(spark, now=lambda: NOW)


def ask(session, root, rest="", fields="record_id", source="seed(s)"):
    out = session.execute(f"FROM {source} BALLOON radius=1 direction=up {rest} RETURN {fields}", root)
    return [r["record_id"] for r in out["balloon_expand"]["results"]], out


def test_json_memory_order_rank_and_defaults(session, root):
    ids, out = ask(session, root, fields="record_id, nothing, x")
    assert ids == ["old", "one", "two", "bad", 7]
    found = out["balloon_expand"]
    assert [r["rank"] for r in found["results"]] == [1, 2, 3, 4, 5] and [r["depth"] for r in found["results"]] == [1, 0, 0, 0, 0]
    assert (found["expanded_count"], found["matched_count"], found["returned_count"]) == (5, 5, 5)
    assert found["results"][1]["x"] == 1.0 and found["results"][0]["nothing"] is None


def test_time_filters_skip_bad_timestamps(session, root):
    assert ask(session, root, "FILTER ts IN last_hour")[0] == ["one", "two"]
    assert ask(session, root, f"FILTER ts > {NOW - 3_600_000}")[0] == ["one", "two"]
    assert ask(session, root, f"FILTER ts < {NOW - 3_600_000}")[0] == ["old"]
    assert ask(session, root, "FILTER ts IN last_day")[0] == []
    ids, out = ask(session, root, "FILTER ts IN last_hour")
    assert [r["rank"] for r in out["balloon_expand"]["results"]] == [2, 3], "ranks count before the filter"


def test_equality_is_that_of_python_text(session, root):
    assert ask(session, root, "FILTER flag = True")[0] == ["one"]
    assert ask(session, root, "FILTER flag = None")[0] == ["old", "two", "bad", 7]
    assert ask(session, root, "FILTER x = 1.0")[0] == ["one"]
    assert ask(session, root, "FILTER x = 1")[0] == ["two"]
    assert ask(session, root, source="seed(7)")[0] == [7]


def test_missing_root_has_no_rows(session, tmp_path):
    assert ask(session, str(tmp_path / "none"))[0] == []


def test_envelopes_and_history(session, root, tmp_path):
    ok = session.contract("FROM seed(s) BALLOON radius=1 direction=up RETURN id", root)
    assert ok["ok"] and ok["error"] is None and ok["result"]["balloon_expand"]["expanded_count"] == 5
    bad = session.contract("FROM seed(s) BALLOON radius=9 direction=up RETURN id", root)
    assert not bad["ok"] and bad["status"] == bad["error"]["code"] == "BQL_RADIUS_OUT_OF_BOUNDS" and not bad["error"]["retryable"]
    log = tmp_path / "h" / "log.jsonl"
    done = session.execute_logged("FROM seed(s) BALLOON radius=1 direction=up RETURN id", root, log, tmp_path / "h")
    with pytest.raises(ValueError):
        session.execute_logged("nonsense", root, log, tmp_path / "h")
    assert [json.loads(x)["status"] for x in log.read_text().splitlines()] == ["ok", "rejected"]
    doc = json.loads(open(done["query_history"]["trace_path"]).read())
    assert [s["name"] for s in doc["stages"]] == list(history.STAGES)


def test_history_is_bounded_and_redacted(tmp_path):
    for i in range(8):
        history.record(tmp_path / "l", f"q {i}", "ok", i, i, keep=3, extras={"Password": "x", "deep": {"token": "y", "long": "z" * 360, "many": list(range(40))}})
    rows = [json.loads(x) for x in (tmp_path / "l").read_text().splitlines()]
    assert [r["result_count"] for r in rows] == [5, 6, 7]
    extras = rows[0]["extras"]
    assert extras["Password"] == extras["deep"]["token"] == "[REDACTED]" and extras["deep"]["long"].endswith("[TRUNCATED]") and len(extras["deep"]["many"]) == 33
    assert history.query_hash(" a  b ", "v") == history.query_hash("a b", "v")


def test_service(session, root):
    import threading

    with service.Service(session) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        port = server.server_address[1]
        request = {"cmd": "query", "query": "FROM seed(s) BALLOON radius=1 direction=up RETURN id", "memory": root}
        assert service.ask(port, request)["result"]["balloon_expand"]["returned_count"] == 5
        assert service.ask(port, request)["ok"]
        assert service.ask(port, {"cmd": "stats"})["stats"]["cache_hits"] == 1
        assert service.ask(port, {"cmd": "shutdown"})["ok"]
    with pytest.raises(PermissionError):
        service.Service(session, "0.0.0.0")


def test_explain_steps():
    q = bql.parse("FROM seed(s) BALLOON radius=1 direction=up FILTER ts > 5 RETURN a")
    assert [s["stage"] for s in engine.explain(q, True)["steps"]] == ["seed_lookup", "balloon_expand", "ts_index_range_lookup", "filter", "return"]
    assert engine.explain(q)["ts_index_candidate"] and not engine.explain(q)["ts_index_used"]


def test_cli(capsys):
    assert service.main(["parse", "FROM seed(s) BALLOON radius=1 direction=up RETURN a"]) == 0
    assert service.main(["explain", "nonsense"]) == 2


def test_time_predicate_reaches_the_scan(spark, sf_dir):
    from ambergrid.plans import catalogue

    q = bql.parse(f"FROM concept(click) BALLOON radius=1 direction=up FILTER ts > {catalogue.TS_MS} RETURN event_id")
    plan = lookup.matched(catalogue.events(spark, sf_dir), q, NOW)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(event_type,click)" in plan


def test_golden_identities(spark):
    vectors = [("{}", 9973137080230810436, 2745614147), ('{"a":1.0}', None, None), ('{"é":[true,null]}', None, None)]
    texts = spark.createDataFrame([(t,) for t, _, _ in vectors], "t string")
    got = texts.select("t", canonical.canonical_json("t").alias("c")).select("t", "c", canonical.record_id_of(F.col("c")).alias("id"), canonical.crc32_of(F.col("c")).alias("crc")).collect()
    for row, (text, rid, crc) in zip(got, vectors, strict=True):
        assert row["c"] == text and int(row["id"]) == canonical.record_id(text.encode()) and row["crc"] == canonical.crc32(text.encode())
        assert rid is None or (int(row["id"]), row["crc"]) == (rid, crc)
    assert canonical.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()


def test_ts_values(spark):
    for value, ms in [(5, 5), (True, None), ("5", 5), ("5.9", 5), ("1e3", 1000), ("2024-01-01T00:00:00Z", 1704067200000), ("x", None), (float("inf"), None), (None, None)]:
        assert values.parse_ts(value) == ms
    df = spark.createDataFrame([("5",), ("5.9",), ("1e3",), ("inf",), ("x",), (" 7 ",)], "ts string")
    assert [r[0] for r in df.select(values.ts_millis(df)).collect()] == [5, 5, 1000, None, None, 7]


def test_packs_search_and_expansion(spark, tmp_path):
    (tmp_path / "PACKS").mkdir()
    lines = [{"id": "SEED_a", "text": "Alpha"}, {"id": "SEED_b", "to": "SEED_a", "next": "SEED_c"}, {"seed_id": "SEED_c", "deep": [{"k": "alphabet"}]}, {"n": 1}]
    (tmp_path / "PACKS" / "code_seeds.bpack").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    rows, report = records.read_packs(spark, str(tmp_path))
    rows = rows.cache()
    assert [r["record_id"] for r in rows.orderBy("ord").collect()] == ["SEED_a", "SEED_b", "SEED_c", "code_seeds.bpack:4"]
    assert {r["pack"]: (r["records"], r["bad_lines"]) for r in report.collect()}["code_seeds.bpack"] == (4, 1)
    hits = graph.seed_search(rows, "ALPHA")
    assert [(r["score"], r["record_id"]) for r in hits.collect()] == [(100, "SEED_a"), (20, "SEED_c")]
    start = rows.where("record_id = 'SEED_a'").select("record_id", "pointer")
    level = lambda r: [(x["depth"], x["record_id"]) for x in graph.expand_records(rows, start, r).orderBy("depth", "ord").collect()]
    assert level(1) == [(1, "SEED_a"), (1, "SEED_b")]
    assert level(3) == [(1, "SEED_a"), (1, "SEED_b"), (2, "SEED_c")]
    assert level(0) == [] and graph.expand_records(rows, start.limit(0), 2).collect() == []
    assert [r["record_id"] for r in graph.expand_records(rows, start, 3, 2).collect()] == ["SEED_a", "SEED_b"]


def test_replay_against_a_model(spark):
    import random

    rng = random.Random(3)
    log = [(i, rng.choice(["UPSERT_SEED", "DELETE_SEED", "upsert_seed", "PUT_SEED"]), rng.choice("abcde"), rng.choice([f"p{i}", None])) for i in range(200)]
    base = [("a", "old", 0), ("a", "new", 1), ("z", "zed", 2)]
    model = {k: p for k, p, _ in base}
    for _, op, key, payload in log:
        if op.upper() == "UPSERT_SEED" and payload:
            model[key] = payload
        elif op == "DELETE_SEED":
            model.pop(key, None)
    got = replay.compact(spark.createDataFrame(base, "key string, payload string, seq long"), spark.createDataFrame(log, "seq long, op string, key string, payload string"), "SEED")
    assert {r["key"]: r["payload"] for r in got.collect()} == model


def test_keyless_upserts_are_numbered(spark):
    log = spark.createDataFrame([(1, "UPSERT_SEED", "k", "p"), (2, "UPSERT_SEED", None, "q"), (3, "UPSERT_SEED", None, None), (4, "UPSERT_SEED", None, "r")], "seq long, op string, key string, payload string")
    assert [r["key"] for r in replay.with_fallback_keys(log, "SEED").orderBy("seq").collect()] == ["k", "wal_seed_1", None, "wal_seed_2"]


def test_transactions(spark):
    log = spark.createDataFrame([(1, "INTENT", "t1", "a"), (2, "COMMIT", "t1", None), (3, "INTENT", "t2", "b"), (4, "INTENT", "t3", "c"), (5, "ABORT", "t3", None), (6, "COMMIT", "t3", None), (7, "COMMIT", "t9", None), (8, "INTENT", "t1", "a2")], "seq long, op_type string, tx_id string, payload string")
    assert {r["tx_id"]: (r["intent_seq"], r["payload"], r["state"]) for r in replay.transactions(log).collect()} == {"t1": (8, "a2", "committed"), "t2": (3, "b", "pending"), "t3": (4, "c", "aborted")}


def test_promised_orders(spark):
    log = spark.createDataFrame([(i, op, f"t{(i * 7) % 30}") for op, lo in (("INTENT", 0), ("COMMIT", 100)) for i in range(lo, lo + 30)], "seq long, op_type string, tx_id string").repartition(4)
    seqs = [r["intent_seq"] for r in replay.listed(log, "committed").collect()]
    assert seqs == sorted(seqs) and len(seqs) == 30
    seqs = [r["intent_seq"] for r in replay.to_apply(log, spark.createDataFrame([("t7",)], "tx_id string")).collect()]
    assert seqs == sorted(seqs) and len(seqs) == 29
    keys = ["Z", "a", "é", "\U0001f642", "z", "A"]
    live = replay.in_order(spark.createDataFrame([(k, "p") for k in keys], "key string, payload string").repartition(3))
    assert [r["key"] for r in live.collect()] == sorted(keys)
    rows = spark.createDataFrame([(i, "bseed" if i % 2 else "bbridge", i // 2, "T", "RAW", str(i), "") for i in range(20)], "record_id long, source_kind string, record_index int, payload_type string, trust_state string, logical_id string, relation string").repartition(3)
    found = [(r["source_kind"], r["record_index"]) for r in index.find_rows(rows, "FIND type = T").collect()]
    assert found == sorted(found) and len(found) == 20


def test_ranks_and_siblings_of_a_hub(spark):
    memory = spark.range(1000).selectExpr("999 - id as ord", "cast(id % 2 as string) as seed", "cast(id % 7 as string) as x").repartition(5)
    parsed = bql.parse("FROM seed(1) BALLOON radius=1 direction=up FILTER x = 3 RETURN x TOP 30")
    source = [o for o in range(1000) if (999 - o) % 2 == 1]
    want = [(o, source.index(o) + 1) for o in source if (999 - o) % 7 == 3][:30]
    assert sorted((r["record_id"], r["rank"]) for r in lookup.run(memory, parsed, NOW).collect()) == want
    plan = lookup.run(memory, parsed, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    edges = spark.range(3000).selectExpr("'hub' as src", "cast(id as string) as dst").unionByName(spark.createDataFrame([("other", "1"), ("other", "x")], "src string, dst string"))
    near = graph.neighbours(edges, spark.createDataFrame([("1",)], "node string"), 1, "lateral")
    assert near.count() == 3001 and near.where("node = 'x'").first()["depth"] == 1
    with pytest.raises(ValueError):
        graph.neighbours(edges, spark.createDataFrame([("1",)], "node string"), 1, "sideways")


def test_running_sums_over_ranges(spark):
    from ambergrid.sources.scratch import running_sums

    got = running_sums(spark.range(500).selectExpr("(id * 37) % 500 as k").repartition(6), "k", F.col("k") + 1, "upto").collect()
    assert all(r["upto"] == (r["k"] + 1) * (r["k"] + 2) // 2 for r in got) and len(got) == 500
    assert running_sums(spark.range(0).selectExpr("id as k"), "k", F.lit(1), "upto").collect() == []


def test_packs_as_folders_keep_line_numbers(spark, tmp_path):
    spark.range(1000).selectExpr("concat('{\"id\":\"SEED_', id, '\"}') as value", "id").repartitionByRange(4, "id").sortWithinPartitions("id").select("value").write.text(str(tmp_path / "code_seeds.bpack"))
    rows, report = records.read_packs(spark, str(tmp_path))
    assert all(r["line"] == int(r["record_id"][5:]) + 1 for r in rows.collect()) and rows.count() == 1000
    assert {r["pack"]: r["records"] for r in report.collect()} == {p: 1000 if p == "code_seeds.bpack" else None for p in records.PACKS}
    none, report = records.read_packs(spark, str(tmp_path / "absent"))
    assert none.count() == 0 and report.where("records is null").count() == 5


def test_gates(spark):
    from ambergrid.plans import gates

    checks = lambda *rows: gates.summary(spark.createDataFrame(rows, "status string, required boolean")).first().asDict()
    good = checks((gates.PASSED, True), (gates.SKIPPED, False), (gates.PASSED, False))
    assert good["passed"] and (good["required_total"], good["optional_total"], good["optional_skipped"]) == (1, 2, 1)
    assert not checks((gates.SKIPPED, True))["passed"] and not checks((None, None))["passed"]


def test_validation(spark):
    rows = spark.createDataFrame([Row(record_type="seed", seed_id="s", seed_type=" "), Row(record_type="SEED", seed_id="s", seed_type="t"), Row(record_type="?", seed_id="s", seed_type="t")])
    assert [r["error"] for r in replay.validated(rows).collect()] == ["seed_type", None, "unknown type"]


def test_index_attributes(spark):
    rows = spark.createDataFrame([(1, "bseed", 0, "CONCEPT", None, "s1", None), (2, "bbridge", 0, None, "VERIFIED", None, "LINKS_TO"), (3, "bseed", 1, "", None, "", None)], "record_id long, source_kind string, record_index int, type string, trust_state string, seed_id string, relation string")
    got = [(r["payload_type"], r["trust_state"], r["logical_id"], r["relation"]) for r in index.attributes(rows).orderBy("record_id").collect()]
    assert got == [("CONCEPT", "RAW", "s1", ""), ("LINKS_TO", "VERIFIED", "rid:2", "LINKS_TO"), ("BSEED", "RAW", "rid:3", "")]
