"""Fixed virtual slots: records hash to slots for good, and only the slot-to-shard map changes.

The map is a small table of SLOTS rows per version, whatever the data's size. Rebalancing writes a
new version that moves as few bytes as the target needs; older versions stay readable.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

SLOTS = 4096
#: Shards of the first map and of the edited one, and the share above the mean that a shard may hold.
SHARDS, GROWN, SLACK = 16, 20, 0.02


def slot_of(key: F.Column, slots: int = SLOTS) -> F.Column:
    """The slot of a key: the first 32 bits of its MD5 modulo ``slots``. A null key hashes as the empty string."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``slot``, ``n_records``, ``n_bytes`` (UTF-8 bytes of text, 0 for null) of every slot, empty ones too."""
    used = docs.groupBy(slot_of(F.col(id_col), slots).alias("slot")).agg(F.count("*").alias("n_records"), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("n_bytes"))
    every = docs.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(used, "slot", "left").select("slot", F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"), F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"))


def initial_map(sizes: pd.DataFrame, shards: int) -> pd.DataFrame:
    """``slot`` and ``shard``: largest slots first, each to the shard with the fewest bytes (ties: lowest shard)."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for row in sizes.sort_values(["n_bytes", "slot"], ascending=[False, True]).itertuples():
        size, count, shard = heapq.heappop(heap)
        out[row.slot] = shard
        heapq.heappush(heap, (size + row.n_bytes, count + 1, shard))
    return pd.DataFrame({"slot": sorted(out), "shard": [out[s] for s in sorted(out)]})


def rebalance(sizes: pd.DataFrame, current: pd.DataFrame, shards: int, slack: float = SLACK) -> pd.DataFrame:
    """An edited map for ``shards`` shards.

    Slots of shards that no longer exist are homeless. Then, while a shard holds more than the mean
    plus ``slack``, it gives up the largest slot that doesn't take it below the mean. Homeless slots go,
    largest first, to the shard with the fewest bytes. All other slots stay where they are.
    """
    size = dict(zip(sizes["slot"], sizes["n_bytes"], strict=True))
    home = dict(zip(current["slot"], current["shard"], strict=True))
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    homeless = []
    for slot in sorted(size):
        (held[home[slot]] if home.get(slot, -1) in held else homeless).append(slot)
    mean = sum(size.values()) / shards
    load = {s: sum(size[x] for x in slots) for s, slots in held.items()}
    for shard, slots in held.items():
        for slot in sorted(slots, key=lambda x: (-size[x], x)):
            if load[shard] <= mean * (1 + slack):
                break
            if size[slot] and load[shard] - size[slot] >= mean:
                homeless.append(slot)
                load[shard] -= size[slot]
    moved = {}
    heap = [(load[s], s) for s in held]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda x: (-size[x], x)):
        n, shard = heapq.heappop(heap)
        moved[slot] = shard
        heapq.heappush(heap, (n + size[slot], shard))
    slots = sorted(size)
    return pd.DataFrame({"slot": slots, "shard": [moved.get(s, home.get(s)) for s in slots]})


def write_map(spark: SparkSession, path: str, slot_map: pd.DataFrame, version: int) -> None:
    """Store a version; versions are never overwritten."""
    spark.createDataFrame(slot_map.astype("int32"), "slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``slot``, ``shard``, ``version`` of one version, by default the newest complete one."""
    if version is None:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        version = max(found)
    return spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def assign(docs: DataFrame, slot_map: DataFrame, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``id_col``, ``slot``, ``shard``, ``version``, one row per input row; the map has a fixed size and is broadcast.

    Null ids share one slot; repeated rows share theirs. Other columns are left out.
    """
    keyed = docs.select(F.col(id_col), slot_of(F.col(id_col), slots).alias("slot"))
    return keyed.join(F.broadcast(slot_map), "slot", "left").select(id_col, "slot", "shard", "version")


def shard_documents(docs: DataFrame, path: str, shards: int = SHARDS, grown: int = GROWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store version 1 of the map for ``shards`` shards and version 2, edited for ``grown``; assign by the newest.

    ``id_col``, ``slot``, ``shard``, ``version``, and ``previous_shard`` as of version 1. An empty
    table gets maps all the same, with slots dealt out evenly.
    """
    spark = docs.sparkSession
    sizes = slot_bytes(docs, id_col, text_col).orderBy("slot").toPandas()
    first = initial_map(sizes, shards)
    write_map(spark, path, first, 1)
    write_map(spark, path, rebalance(sizes, first, grown), 2)
    before = read_map(spark, path, 1).select("slot", F.col("shard").alias("previous_shard"))
    now = read_map(spark, path).join(F.broadcast(before), "slot")
    keyed = docs.select(F.col(id_col), slot_of(F.col(id_col)).alias("slot"))
    return keyed.join(F.broadcast(now), "slot", "left").select(id_col, "slot", "shard", "previous_shard", "version")


#: Slots of documents, dealt out and rebalanced as above; the three recursions take one slot at a time.
ORACLE_SQL = f"""
with recursive sizes as (
  select s.slot, coalesce(n_bytes, 0) as n_bytes
  from (select unnest(range({SLOTS})) as slot) s
  left join (select cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as ubigint) % {SLOTS} as slot, cast(sum(strlen(coalesce(text, ''))) as bigint) as n_bytes from documents group by all) u on u.slot = s.slot),
dealt as materialized (select list(n_bytes order by n_bytes desc, slot) as n, list(slot order by n_bytes desc, slot) as slots from sizes),
first_deal(i, held, counts, shard) as (
  select 0, list_transform(range({SHARDS}), lambda x: cast(0 as bigint)), list_transform(range({SHARDS}), lambda x: cast(0 as bigint)), cast(null as bigint)
  union all
  select i + 1, list_transform(range({SHARDS}), lambda x: held[x + 1] + case when x = pick then n[i + 1] else 0 end), list_transform(range({SHARDS}), lambda x: counts[x + 1] + case when x = pick then 1 else 0 end), pick
  from (select *, list_sort(list_transform(range({SHARDS}), lambda x: {{'a': held[x + 1], 'b': counts[x + 1], 'c': x}}))[1].c as pick from first_deal, dealt where i < {SLOTS})),
before as materialized (select slots[i] as slot, n[i] as n_bytes, shard as previous_shard from first_deal, dealt where i > 0),
mean as materialized (select cast(sum(n_bytes) as double) / {GROWN} as mean from sizes),
piles as materialized (select previous_shard as pile, list(slot order by n_bytes desc, slot) as slots, list(n_bytes order by n_bytes desc, slot) as n, cast(sum(n_bytes) as bigint) as total from before where n_bytes > 0 group by all),
given(pile, i, held, goes) as (
  select pile, 0, total, false from piles
  union all
  select pile, i + 1, held - case when leaves then n[i + 1] else 0 end, leaves
  from (select g.pile, g.i, g.held, p.n, g.held > mean * (1 + {SLACK}) and g.held - p.n[g.i + 1] >= mean as leaves from given g join piles p on p.pile = g.pile, mean where g.i < len(p.n))),
homeless as materialized (select list(slots[i] order by n[i] desc, slots[i]) as slots, list(n[i] order by n[i] desc, slots[i]) as n from given join piles using (pile) where goes),
loads as materialized (select list(coalesce(held, 0) order by x) as held from (select unnest(range({GROWN})) as x) left join (select pile, min(held) as held from given group by pile) on pile = x),
second_deal(i, held, shard) as (
  select 0, held, cast(null as bigint) from loads
  union all
  select i + 1, list_transform(range({GROWN}), lambda x: held[x + 1] + case when x = pick then n[i + 1] else 0 end), pick
  from (select d.i, d.held, h.n, list_sort(list_transform(range({GROWN}), lambda x: {{'a': d.held[x + 1], 'c': x}}))[1].c as pick from second_deal d, homeless h where d.i < coalesce(len(h.n), 0))),
moved as materialized (select slots[i] as slot, shard from second_deal, homeless where i > 0)
select doc_id, cast(slot as integer) as slot, cast(coalesce(m.shard, b.previous_shard) as integer) as shard, cast(b.previous_shard as integer) as previous_shard, 2 as version
from (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as ubigint) % {SLOTS} as slot from documents) d join before b using (slot) left join moved m using (slot)
"""
