"""State on disk as Parquet: snapshots compacted from a log, and idempotent recovery of transactions.

Paths go through Hadoop's file system API, so any shared store will do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import index, replay

PARTS = ("seeds", "bridges", "index")
MARKER, MANIFEST = "SNAPSHOT_COMPLETE", "manifest.json"


class BrokenSnapshot(ValueError):
    """A snapshot without marker or manifest, or with other row counts than these say."""


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def move(self, source: str, target: str) -> None:
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} couldn't be renamed to {target}")

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.at(path), True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def children(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(path))] if self.exists(path) else []


def write_snapshot(seeds: DataFrame, bridges: DataFrame, log: DataFrame, path: str) -> dict:
    """Compact base tables (key, payload, seq) and a log into a snapshot; returns the manifest.

    The snapshot is written beside ``path`` and renamed when its manifest and, last, its marker are
    there; the one before stays as ``.prev``. Payloads are JSON; the index holds their attributes.
    """
    spark = seeds.sparkSession
    files, aside = _Files(spark, path), f"{path}.staging"
    files.delete(aside)
    counts = {}
    for name, base, what, kind in (("seeds", seeds, "SEED", "bseed"), ("bridges", bridges, "BRIDGE", "bbridge")):
        live = replay.compact(base, replay.with_fallback_keys(log, what), what)
        replay.in_order(live.withColumn("source_kind", F.lit(kind))).write.parquet(f"{aside}/{name}")
        counts[name] = spark.read.parquet(f"{aside}/{name}").count()
    rows = spark.read.parquet(f"{aside}/seeds").unionByName(spark.read.parquet(f"{aside}/bridges"))
    keys = ("type", "kind", "relation", "trust_state", "seed_id", "bridge_id", "id")
    records = rows.select(F.col("key").alias("record_id"), "source_kind", F.lit(0).alias("record_index"), *[F.get_json_object("payload", f"$.{k}").alias(k) for k in keys])
    index.attributes(records).drop("record_index").write.parquet(f"{aside}/index")
    counts["index"] = counts["seeds"] + counts["bridges"]
    stats = replay.replay_stats(log).first().asDict()
    manifest = {"counts": counts, "log": stats}
    files.write(f"{aside}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    files.write(f"{aside}/{MARKER}", "complete\n")
    if files.exists(path):
        files.delete(f"{path}.prev")
        files.move(path, f"{path}.prev")
    files.move(aside, path)
    return manifest


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, if it has its marker and the manifest's row counts."""
    files = _Files(spark, path)
    if not (files.exists(f"{path}/{MARKER}") and files.exists(f"{path}/{MANIFEST}")):
        raise BrokenSnapshot(f"{path} is no complete snapshot")
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in PARTS}
    for name, table in tables.items():
        if (n := table.count()) != manifest["counts"][name]:
            raise BrokenSnapshot(f"{path}: {n} rows of {name}, {manifest['counts'][name]} in the manifest")
    return tables


def recover(log: DataFrame, path: str, dry_run: bool = False) -> dict:
    """Apply what a transaction log committed and ``path`` doesn't hold yet; returns counts.

    The applied records are themselves the durable state: a run writes ``run=N`` and reads the
    earlier ones, so a run that is repeated after a failure overwrites its own half-written part and
    no record is applied twice. Only ``append_record`` actions are applied.
    """
    spark = log.sparkSession
    files = _Files(spark, path)
    done = sorted(int(c.split("=")[1]) for c in files.children(path) if c.startswith("run=") and files.exists(f"{path}/{c}/_SUCCESS"))
    schema = "tx_id string, intent_seq bigint, payload string"
    before = spark.read.schema(schema).parquet(*[f"{path}/run={n}" for n in done]) if done else spark.createDataFrame([], schema)
    committed = replay.transactions(log).where("state = 'committed'")
    wanted = committed.where(F.get_json_object("payload", "$.action") == "append_record")
    new = wanted.join(before.select("tx_id"), "tx_id", "left_anti").select("tx_id", "intent_seq", "payload")
    counts = replay.transaction_counts(log).first().asDict() | {"unsupported_count": committed.count() - wanted.count(), "skipped_count": wanted.join(before.select("tx_id"), "tx_id", "left_semi").count()}
    if dry_run:
        return counts | {"applied_count": 0, "would_apply_count": new.count()}
    target = f"{path}/run={(done[-1] + 1) if done else 0}"
    new.write.mode("overwrite").parquet(target)
    return counts | {"applied_count": spark.read.schema(schema).parquet(target).count()}
