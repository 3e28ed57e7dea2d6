import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from ambergrid.functions.canonical import batch_frame, canonical
from ambergrid.operators import snapshots
from ambergrid.sources import frames

ROWS = [{"seed_id": "a", "text": "é", "x": 1.0}, {"seed_id": "b", "n": None}, {"seed_id": "c"}]


def test_file_round_trip_and_damage():
    data = frames.encode_file("seed", ROWS, 5)
    assert [json.loads(raw) for _, _, raw in frames.decode_file(data, "seed")] == ROWS
    for at in (70, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(frames.FrameError):
            list(frames.decode_file(bytes(broken)))
    for wrong in (data[:-1], data + b"x", b"", data[:30]):
        with pytest.raises(frames.FrameError):
            list(frames.decode_file(wrong))
    with pytest.raises(frames.FrameError):
        list(frames.decode_file(data, "bridge"))


def test_append_and_cut_tail(tmp_path):
    path = str(tmp_path / "log")
    for kind, payload in (("INTENT", {"tx_id": "t", "action": "append_record"}), ("commit", {"tx_id": "t"}), ("CHECKPOINT", {})):
        frames.append_entry(path, frames.LOG, kind, payload)
    data = open(path, "rb").read()
    assert [(e.type, e.seq) for e in frames.decode_entries(frames.LOG, data)] == [("INTENT", 1), ("COMMIT", 2), ("CHECKPOINT", 3)]
    assert len(list(frames.decode_entries(frames.LOG, data[:-9]))) == 2
    with pytest.raises(frames.FrameError):
        list(frames.decode_entries(frames.LOG, data[:-9], strict_tail=True))
    with pytest.raises(frames.ChecksumError):
        list(frames.decode_entries(frames.LOG, data[:-1] + b"!"))
    with pytest.raises(frames.FrameError):
        frames.append_entry(path, frames.STORE, "SEED", {"seed_id": "s"})
    entry = frames.append_entry(str(tmp_path / "store"), frames.STORE, "route", {"route_id": "r"})
    assert entry["offset"] == 0
    stored = next(frames.decode_entries(frames.STORE, (tmp_path / "store").read_bytes()))
    assert json.loads(stored.payload)["steps"] == []


def test_data_source(spark, tmp_path):
    frames.register(spark)
    out = str(tmp_path / "out")
    spark.createDataFrame([(json.dumps(r),) for r in ROWS], "payload string").repartition(2).write.format("frames").mode("append").option("path", out).option("kind", "seed").save()
    back = spark.read.format("frames").option("path", out).option("kind", "seed").load()
    assert sorted(r["payload"] for r in back.collect()) == sorted(canonical(r).decode() for r in ROWS)
    assert not [f for f in os.listdir(out) if f.endswith(".tmp")]
    frames.append_entry(str(tmp_path / "log"), frames.LOG, "CHECKPOINT", {})
    log = spark.read.format("frames").option("path", str(tmp_path / "log")).option("layout", "log").load()
    assert [(r["type"], r["seq"]) for r in log.collect()] == [("CHECKPOINT", 1)]


def test_stores_and_logs_round_trip(spark, tmp_path):
    frames.register(spark)
    entries = [("INTENT", 5, 1, {"tx_id": "a", "action": "x"}), ("COMMIT", 6, 2, {"tx_id": "a"}), ("CHECKPOINT", 7, 3, {})]
    df = spark.createDataFrame([(*e[:3], json.dumps(e[3])) for e in entries], "type string, timestamp_ms long, seq long, payload string")
    for layout in ("log", "store"):
        out = f"file://{tmp_path}/{layout}"
        rows = df if layout == "log" else df.drop("seq").selectExpr("case type when 'INTENT' then 'SEED' when 'COMMIT' then 'route' else 'META' end as type", "timestamp_ms", "payload")
        rows.write.format("frames").mode("append").option("path", out).option("layout", layout).save()
        back = spark.read.format("frames").option("path", out).option("layout", layout).load().orderBy("timestamp_ms").collect()
        assert [(r["timestamp_ms"], r["seq"], json.loads(r["payload"])) for r in back] == [(t, s if layout == "log" else None, p) for _, t, s, p in entries]
    assert [r["type"] for r in back] == ["SEED", "ROUTE", "META"]
    named = spark.read.format("frames").option("path", f"{tmp_path}/log/part-*.log").option("layout", "log").load()
    assert named.count() == 3 and spark.read.format("frames").option("path", str(tmp_path / "none")).load().count() == 0


def test_creators_and_transactions(tmp_path):
    path = str(tmp_path / "s")
    frames.create_seed(path, "s", "T", {"a": 1})
    frames.create_bridge(path, "b", ("s", "t"), "LINK")
    frames.create_route(path, "r", [{"to": "s"}])
    frames.create_result(path, "x", "GOOD", {})
    entries = list(frames.decode_entries(frames.STORE, (tmp_path / "s").read_bytes()))
    assert [e.type for e in entries] == ["SEED", "BRIDGE", "ROUTE", "RESULT"] and all(json.loads(e.payload)["status"] == "OBSERVED" for e in entries)
    bridge = json.loads(entries[1].payload)
    assert (bridge["from_seed"], bridge["to_seed"], bridge["data"]) == ("s", "t", {})
    with pytest.raises(frames.FrameError):
        frames.create_seed(path, " ", "T", {})
    log = str(tmp_path / "l")
    frames.begin(log, "1", "append_record", {}, "there")
    frames.commit(log, "1")
    frames.begin(log, "2", "append_record", {})
    frames.abort(log, "2", "why")
    entries = list(frames.decode_entries(frames.LOG, (tmp_path / "l").read_bytes()))
    assert [(e.type, e.seq) for e in entries] == [("INTENT", 1), ("COMMIT", 2), ("INTENT", 3), ("ABORT", 4)]
    assert json.loads(entries[0].payload)["target_path"] == "there" and json.loads(entries[3].payload)["reason"] == "why"


def test_batches_are_framed_alike_in_columns(spark):
    rows = [("{}", 1, 2), ('{"a":"é"}', 0, 2**31), (None, 1, 1), ("", 3, 4)]
    df = spark.createDataFrame(rows, "p string, k long, t long")
    got = [r[0] for r in df.select(batch_frame(F.col("p"), F.col("k"), F.col("t"))).collect()]
    assert [None if x is None else bytes(x) for x in got] == [None if p is None else frames.encode_batch_record(p.encode(), k, t) for p, k, t in rows]


def test_index_blob_and_batch():
    payload = {"record_count": 1, "records": [{"record_id": 15876355370403767239}]}
    assert frames.decode_index(frames.encode_index(payload, 1)) == payload
    with pytest.raises(frames.ChecksumError):
        frames.decode_index(frames.encode_index(payload, 1)[:-1] + b"!")
    assert frames.decode_blob(frames.encode_blob([1])) == [1]
    assert len(frames.encode_batch_record(b"{}", 1, 2)) == 26


def test_snapshots_fall_back(tmp_path):
    seed = {"record_id": "s", "type": "T", "trust_state": "RAW"}
    snapshots.commit(tmp_path, 1, [seed, seed], [])
    snapshots.stage(tmp_path, 2, [seed] * 3, [], complete=False)
    assert snapshots.recover(tmp_path)["recovered_version"] == 1
    snapshots.commit(tmp_path, 2, [seed] * 3, [])
    found = snapshots.recover(tmp_path)
    assert found["recovered_version"] == 2 and found["index"]["seed_count"] == 3 and found["index"]["types"] == ["T"]
    bad = pathlib.Path(snapshots.folder(tmp_path, 2)) / "snapshot.bseed"
    bad.write_bytes(bad.read_bytes()[:-1] + b"!")
    found = snapshots.recover(tmp_path)
    assert found["recovered_version"] == 1 and len(found["fallback_errors"]) == 1
    snapshots.stage(tmp_path, 3, [], [])
    assert snapshots.recover(tmp_path)["recovered_version"] == 3, "complete versions count without activation"
    with pytest.raises(snapshots.NoSnapshot):
        snapshots.recover(tmp_path / "none")


def test_lab_record_and_manifest(tmp_path):
    data = frames.encode_lab("é", b"{}", 3, 1)
    assert frames.decode_lab(data)["logical_id"] == "é" and frames.decode_lab(data)["payload"] == b"{}"
    for wrong in (data[:-1], data + b"x", data[:20] + b"!" + data[21:], b""):
        with pytest.raises(frames.FrameError):
            frames.decode_lab(wrong)
    (tmp_path / "f").write_bytes(b"abc")
    assert frames.write_manifest(str(tmp_path / "m"), [str(tmp_path / "f")])["files"]["f"]["bytes"] == 3
