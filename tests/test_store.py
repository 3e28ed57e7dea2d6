import json

import pytest

from ambergrid.operators import store


def test_compaction_snapshot(spark, tmp_path):
    seeds = spark.createDataFrame([("alpha", json.dumps({"seed_id": "alpha", "type": "CONCEPT"}), 1), ("old", json.dumps({"seed_id": "old"}), 2)], "key string, payload string, seq long")
    bridges = spark.createDataFrame([("b0", json.dumps({"bridge_id": "b0", "relation": "X"}), 1)], "key string, payload string, seq long")
    log = spark.createDataFrame(
        [
            (1, "UPSERT_SEED", "beta", json.dumps({"seed_id": "beta", "type": "CONCEPT"})),
            (2, "UPSERT_SEED", "alpha", json.dumps({"seed_id": "alpha", "type": "CONCEPT", "trust_state": "PROMOTED"})),
            (3, "DELETE_SEED", "old", None),
            (4, "DELETE_BRIDGE", "b0", None),
            (5, "UPSERT_BRIDGE", "b1", json.dumps({"bridge_id": "b1", "relation": "LINKS_TO"})),
            (6, "UPSERT_BRIDGE", "b2", json.dumps({"bridge_id": "b2", "relation": "USES"})),
        ],
        "seq long, op string, key string, payload string",
    )
    path = str(tmp_path / "snap")
    assert store.write_snapshot(seeds, bridges, log, path)["counts"] == {"seeds": 2, "bridges": 2, "index": 4}
    tables = store.read_snapshot(spark, path)
    assert tables["index"].where("trust_state = 'PROMOTED'").count() == 1 and tables["index"].where("payload_type = 'CONCEPT'").count() == 2
    assert tables["index"].where("relation = 'LINKS_TO'").count() == 1 and not tables["seeds"].where("key = 'old'").count()
    store.write_snapshot(seeds, bridges, log.limit(0), path)
    assert store.read_snapshot(spark, path)["seeds"].count() == 2 and store.read_snapshot(spark, path + ".prev")["bridges"].count() == 2
    (tmp_path / "snap" / store.MARKER).unlink()
    with pytest.raises(store.BrokenSnapshot):
        store.read_snapshot(spark, path)


def test_recovery_is_idempotent(spark, tmp_path):
    act = lambda a: json.dumps({"action": a, "data": {}})
    rows = [(1, "INTENT", "t1", act("append_record")), (2, "COMMIT", "t1", None), (3, "INTENT", "t2", act("append_record")), (4, "INTENT", "t3", act("append_record")), (5, "COMMIT", "t3", None), (6, "INTENT", "t4", act("other")), (7, "COMMIT", "t4", None)]
    log = spark.createDataFrame(rows, "seq long, op_type string, tx_id string, payload string")
    path = str(tmp_path / "applied")
    assert store.recover(log, path, dry_run=True)["would_apply_count"] == 2
    first, second = store.recover(log, path), store.recover(log, path)
    assert (first["applied_count"], first["skipped_count"], first["unsupported_count"], first["pending_count"]) == (2, 0, 1, 1)
    assert (second["applied_count"], second["skipped_count"]) == (0, 2)
