"""Intermediate tables in the folder that all executors share, and sums over ranges of rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the setting is missing, a single-machine session gets a temporary folder of its own;
    on a cluster that is an error, since executors would not see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ambergrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _cleanup(spark: SparkSession, app: str) -> None:
    for path in _written.pop(app, []):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def new_path(spark: SparkSession, tag: str) -> str:
    """A path for a table that lives as long as the session."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{app}/{tag}-{uuid.uuid4().hex[:12]}"
    if app not in _written:
        _written[app] = []
        atexit.register(_cleanup, spark, app)
    _written[app].append(path)
    return path


def persist(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    Unlike cached blocks, the files outlive any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``persist`` once no later query reads it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def running_sums(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows up to this one by ``order`` (distinct).

    Rows are cut into ranges, summed within each, and the sums of earlier ranges are added. Ranges are
    written out, as a second evaluation might cut them elsewhere.
    """
    split = persist(rows.withColumn("_value", value).repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = split.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))  # a row per range
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(order))
    return split.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_value", "_range", "_before", "_inside")
