"""Seed search and bounded neighbourhoods.

Two forms of expansion: over records, where records are adjacent if one holds a string that the
other is known by, and over a table of edges, where a direction can be given.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import persist

MAX_RADIUS = 3
PREFIXES = tuple(f"{p}_" for p in ("SEED", "BRIDGE", "ROUTE", "PATTERN", "RESULTREC"))
MAX_IDS = 20
#: A frontier of so many ids at most is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def seed_search(records: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """``score``, ``pointer``, ``record_id``, ``pack`` of records that hold the text.

    records: pointer, pack, record_id, strings (array). Ignores case; a whole string scores 100, a
    part of one 20. Best first, then by pack and record id.
    """
    query = F.lit(text.lower())
    low = lambda s: F.lower(s)
    score = F.when(F.exists("strings", lambda s: low(s) == query), 100).when(F.exists("strings", lambda s: F.contains(low(s), query)), 20)
    hits = records.withColumn("score", score).where("score is not null")
    return hits.orderBy(F.desc("score"), "pack", "record_id", "pointer").limit(limit).select("score", "pointer", "record_id", "pack")


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint where a count shows that the side is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def expand_records(records: DataFrame, start: DataFrame, radius: int = 1, max_results: int = 50) -> DataFrame:
    """``depth``, ``pointer``, ``record_id``, ``pack``, ``ids`` of the records around the start.

    start: record_id and pointer of hits, which come back themselves at depth 1. A level takes the
    records that share a string with the frontier and weren't taken before, in order, up to
    ``max_results`` in all; the next frontier is what these know: at most MAX_IDS of their
    identifiers each, by prefix, sorted. The loop has at most ``radius`` rounds.
    """
    spark = records.sparkSession
    known = records.withColumn("all", F.array_union("strings", F.array("record_id", "pointer")))
    ids = F.slice(F.array_sort(F.filter("all", lambda s: F.array_contains(F.array(*map(F.lit, PREFIXES)), F.regexp_extract(s, r"^[A-Z]+_", 0)))), 1, MAX_IDS)
    words = known.select("pointer", F.explode("all").alias("s"))
    first = start.select(F.explode(F.array("record_id", "pointer")).alias("s")).distinct()
    level = known.join(words.join(_small(first), "s", "left_semi").select("pointer").distinct(), "pointer", "left_semi")
    found: list[pa.Table] = []
    for depth in range(1, min(radius, MAX_RADIUS) + 1):
        # at most max_results rows in all, so they and what they know are kept on the driver
        left = max_results - sum(t.num_rows for t in found)
        rows = level.orderBy("ord").limit(left).select("ord", F.lit(depth).alias("depth"), "pointer", "record_id", "pack", F.array_distinct(ids).alias("ids")).toArrow()
        found.append(rows)
        frontier = sorted({s for x in rows["ids"].to_pylist() for s in x})
        if not frontier or rows.num_rows == left:
            break
        taken = [x for t in found for x in t["pointer"].to_pylist()]
        asked = spark.createDataFrame([(frontier, taken)], "frontier array<string>, taken array<string>")
        # one scan, without a shuffle but for its first rows
        level = known.where(F.arrays_overlap("all", asked.select("frontier").scalar()) & ~F.array_contains(asked.select("taken").scalar(), F.col("pointer")))
    if not found:  # a radius below 1
        return known.limit(0).select("ord", F.lit(0).alias("depth"), "pointer", "record_id", "pack", F.array_distinct(ids).alias("ids"))
    return spark.createDataFrame(pa.concat_tables(found))


def neighbours(edges: DataFrame, start: DataFrame, radius: int, direction: str) -> DataFrame:
    """``node`` and its least ``depth`` (0: the start) within ``radius`` steps over edges (src, dst).

    down: along edges. up: against them. up_down: both. lateral: nodes that share a source with
    the node; it goes by way of the distinct sources, so a hub's children aren't paired. Each round joins only
    the newest level with the edges and drops what is known. Levels are written to the shared folder, which
    cuts their lineage and tells the next join how large they are.
    """

    def step(level: DataFrame, here: str, there: str) -> DataFrame:
        return edges.join(level.withColumnRenamed("node", here), here, "left_semi").select(F.col(there).alias("node"))

    def reached(level: DataFrame) -> DataFrame:
        match direction:
            case "down":
                return step(level, "src", "dst")
            case "up":
                return step(level, "dst", "src")
            case "up_down":
                return step(level, "src", "dst").unionByName(step(level, "dst", "src"))
            case "lateral":
                return step(step(level, "dst", "src").distinct(), "src", "dst")
        raise ValueError(f"no direction {direction}")

    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    level = seen.select("node")
    for depth in range(1, min(radius, MAX_RADIUS) + 1):
        found = reached(level).distinct().join(seen.select("node"), "node", "left_anti")
        level = persist(found, "level")
        seen = seen.unionByName(level.select("node", F.lit(depth).alias("depth")))
    return seen
