"""Logs as streams: an extension beyond batch replay, with the same results once all input has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import replay


def follow_transactions(log: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of every transaction of a streamed log (seq, op_type, tx_id, payload) in a memory table.

    State is one row per transaction; available input is taken, then the query ends.
    """
    states = replay.transactions(log)
    return states.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_compaction(spark: SparkSession, log: DataFrame, target: str, what: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch of a streamed log (seq, op, key, payload) into the newest version under ``target``.

    A batch writes the version named by its number and reads the one before, so a batch that is
    repeated after a failure overwrites its own result and nothing is applied twice. Keys keep their
    deletions (payload null, with seq), which makes late entries with a lower seq harmless.
    """
    upsert, delete = f"UPSERT_{what}", f"DELETE_{what}"

    def fold(batch: DataFrame, number: int) -> None:
        op = F.upper("op")
        ops = batch.where(((op == upsert) & F.col("payload").isNotNull()) | ((op == delete) & F.col("key").isNotNull()))
        rows = ops.select("key", "seq", F.when(op == upsert, F.col("payload")).alias("payload"))
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{target}/version={number - 1}"))
        last = rows.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))
        last.write.mode("overwrite").parquet(f"{target}/version={number}")

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
