"""Records from JSON and JSON-lines files, in a stable order."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import values

ENVELOPES = tuple("records items data rows".split())
PACKS = tuple(f"code_{x}.bpack" for x in "seeds bridges routes results patterns".split())
PACK_IDS = ["id", *(f"{x}_id" for x in "seed pattern route bridge result".split()), "name", "status", "result"]
_SKIP = re.compile(r"(\.wal|\.idx)$|tsindex", re.IGNORECASE)


def _files(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """(path, is JSON lines) of all record files in load order: lines first, then documents; each kind by path."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    if fs.getFileStatus(top).isFile():
        return [(str(top), str(top).lower().endswith(".jsonl"))]
    found, walk = [], fs.listFiles(top, True)
    while walk.hasNext():
        path = walk.next().getPath()
        name = path.getName()
        if not _SKIP.search(name) and name.endswith((".jsonl", ".json")):
            found.append((path.toString(), name.endswith(".jsonl")))
    return sorted(found, key=lambda x: (not x[1], x[0]))


def _numbered(rows: DataFrame, within: str | None = None) -> DataFrame:
    """Dense positions of rows (file_no, block, at): counts per block give the offsets, no global sort.

    There are as many blocks as input splits, so the offsets are a small table. within: count anew for each of its values.
    """
    group = [within] if within else []
    blocks = rows.groupBy(*group, "file_no", "block").agg(F.count("*").alias("n"))
    before = blocks.select("file_no", "block", (F.sum("n").over(Window.partitionBy(*group).orderBy("file_no", "block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file_no", "block").orderBy("at")) - 1
    return rows.withColumn("inside", inside).join(before, ["file_no", "block"]).withColumn("ord", F.col("before") + F.col("inside"))


def _lines(spark: SparkSession, paths: list[str], whole: bool = False, separator: str | None = None) -> DataFrame:
    """``file_no`` (place in ``paths``), ``block``, ``at`` and ``value`` of all lines, or whole texts; without byte order marks."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    text = reader.text(paths, wholetext=whole).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    text = text.withColumn("value", F.regexp_replace("value", "^\ufeff", "")).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    table = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, file_no int").withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    return text.join(table, "path").select("file_no", "block", "at", "value")  # Spark broadcasts the list of files if it is small


def read_json(spark: SparkSession, root: str) -> DataFrame:
    """``ord`` and ``raw`` (JSON text) of every object under ``root``.

    JSON lines are split over tasks; what isn't JSON or no object is skipped. A JSON document gives
    its items if it is a list, else those of its first envelope key that holds a list, else itself.
    A missing root has no records.
    """
    files = _files(spark, root)
    empty = spark.createDataFrame([], "file_no int, block bigint, at bigint, raw string")
    parts = empty
    for lines in (True, False):
        paths = [p for p, kind in files if kind == lines]
        if not paths:
            continue
        text = _lines(spark, paths, whole=not lines)
        if lines:
            rows = text.select("file_no", "block", "at", F.trim("value").alias("raw"))
        else:  # documents come after all lines
            rows = text.select((F.col("file_no") + len(files) - len(paths)).alias("file_no"), "block", F.posexplode(_items("value")).alias("at", "raw")).withColumn("at", F.col("at").cast("bigint"))
        parts = parts.unionByName(rows.where(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT")))
    return _numbered(parts).select("ord", "raw")


def resolve_lines(records: DataFrame, refs: DataFrame) -> DataFrame:
    """The records at given positions (a column ``ord``)."""
    return records.join(refs.select("ord").distinct(), "ord", "left_semi")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _items(documents: pd.Series) -> pd.Series:
    def one(text: str) -> list[str]:
        try:
            value = json.loads(text)
        except ValueError:
            return []
        if isinstance(value, dict):
            value = next((value[k] for k in ENVELOPES if isinstance(value.get(k), list)), [value])
        return [json.dumps(x, ensure_ascii=False) for x in value if isinstance(x, dict)] if isinstance(value, list) else []

    return documents.map(one)


def with_keys(records: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the Python text of the given keys (null: absent) and ``ts`` in milliseconds, in one pass over ``raw``.

    A key that holds JSON null reads as None, as it does for a Python program.
    """
    names = sorted(set(keys) - {"ts"})
    schema = ", ".join([*(f"`{n}` string" for n in names), "ts bigint"])

    @F.pandas_udf(f"struct<{schema.replace(' string', ':string').replace(' bigint', ':bigint')}>")
    def pick(raw: pd.Series) -> pd.DataFrame:
        rows = [json.loads(t) for t in raw]
        out = {n: [str(r[n]) if n in r else None for r in rows] for n in names}
        ts = [values.parse_ts(r.get("ts")) for r in rows]
        out["ts"] = pd.array([None if t is None else max(-(2**63), min(2**63 - 1, t)) for t in ts], dtype="Int64")
        return pd.DataFrame(out)

    return records.select("ord", "raw", pick("raw").alias("_k")).select("ord", "raw", "_k.*")


def read_packs(spark: SparkSession, root: str, packs: tuple[str, ...] = PACKS) -> tuple[DataFrame, DataFrame]:
    """Records of pack files (JSON lines), and a report per pack.

    Records: ``ord, pointer`` (pack:line, lines from 1), ``pack, line, record_id, raw, strings``. A
    pack lies in root, root/PACKS or root/packs; it may be a folder of files, whose lines follow each other in the
    order of their names. Large files are split over tasks. The record id is the first of the identifying keys
    with text in it, else the pointer. Report: ``pack``, ``records``, ``bad_lines`` (null: no such pack).
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files: list[tuple[str, str]] = []
    for pack in packs:
        for place in (root, f"{root}/PACKS", f"{root}/packs"):
            path = jvm.org.apache.hadoop.fs.Path(place, pack)
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                inside = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
                files += [(pack, f) for f in inside]
                break
    if files:
        owner = spark.createDataFrame([(i, packs.index(p), p) for i, (p, _) in enumerate(files)], "file_no int, pack_no int, pack string")
        text = _lines(spark, [f for _, f in files], separator="\n").join(owner, "file_no")
        lines = _numbered(text, "pack_no").select("pack_no", "pack", (F.col("ord") + 1).cast("int").alias("line"), F.trim(F.regexp_replace("value", "\r$", "")).alias("raw"))
    else:
        lines = spark.createDataFrame([], "pack_no int, pack string, line int, raw string")
    lines = lines.where("raw != ''").withColumn("json", F.try_parse_json("raw"))
    report = spark.createDataFrame([(p,) for p in packs], "pack string").join(lines.groupBy("pack").agg(F.count("json").alias("records"), F.count_if(F.col("json").isNull()).alias("bad_lines")), "pack", "left")
    ids = [F.when(F.schema_of_variant(F.try_variant_get("json", f"$.{k}", "variant")) == "STRING", F.nullif(F.try_variant_get("json", f"$.{k}", "string"), F.lit(""))) for k in PACK_IDS]
    pointer = F.concat_ws(":", "pack", "line")
    good = lines.where("json is not null").select((F.col("pack_no").cast("bigint") * (1 << 40) + F.col("line")).alias("ord"), pointer.alias("pointer"), "pack", "line", F.coalesce(*ids, pointer).alias("record_id"), "raw")
    return good.withColumn("strings", values.json_strings("raw")), report
