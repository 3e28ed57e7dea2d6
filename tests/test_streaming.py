from pyspark.sql import functions as F

from ambergrid.operators import replay
from ambergrid.plans import catalogue
from ambergrid.streaming import logs


def pieces(df, path, n=3):
    for i in range(n):
        df.where(F.pmod("seq", F.lit(n)) == i).coalesce(1).write.mode("append").parquet(path)


def test_streamed_transactions_equal_batch(spark, sf_dir, tmp_path):
    log = catalogue.tx_log(spark, sf_dir)
    pieces(log, str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    logs.follow_transactions(stream, "tx_states", str(tmp_path / "cp")).awaitTermination(120)
    assert {tuple(r) for r in spark.table("tx_states").collect()} == {tuple(r) for r in replay.transactions(log).collect()}


def test_streamed_compaction_equals_batch(spark, sf_dir, tmp_path):
    log = catalogue.change_log(spark, sf_dir, "SEED", "user_id")
    pieces(log, str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    logs.follow_compaction(spark, stream, str(tmp_path / "out"), "SEED", str(tmp_path / "cp")).awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    got = spark.read.parquet(str(tmp_path / "out" / f"version={last}")).where("payload is not null").select("key", "payload")
    want = replay.compact(spark.createDataFrame([], "key string, payload string, seq long"), log, "SEED")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
