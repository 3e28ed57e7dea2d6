"""Queries whose rows pass through files first: memories, packs, containers, snapshots; and the SQL that gives the same rows.

Each writes a table in the format at hand to the shared folder and reads it with the source that is tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import canonical
from ..lang import bql
from ..operators import graph, index, lookup, replay, snapshots, store
from ..sources import frames, records
from ..sources.scratch import new_path, persist
from . import catalogue, gates
from .catalogue import KIND, NOW_MS, TS_MS, USER, Query, _named, _read


def _line(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


# memories of JSON files


def json_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as JSON lines in the order of their ids."""
    path = new_path(spark, "memory")
    e = _read(spark, sf_dir, "events")
    text = _line(seed=F.col("user_id").cast("string"), concept=F.col("event_type"), event_id=F.col("event_id"), event_type=F.col("event_type"), ts=F.unix_millis(F.col("ts").cast("timestamp")), value=F.col("value"))
    e.orderBy("event_id").select(text).write.text(path)
    files = store._Files(spark, path)
    for name in files.children(path):
        if name.startswith("part-"):
            files.move(f"{path}/{name}", f"{path}/{name.partition('.')[0]}.jsonl")
    return records.with_keys(records.read_json(spark, path), "seed concept event_id event_type value".split())


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, a table of fixed size, as one JSON document with an envelope."""
    path = new_path(spark, "document")
    item = F.struct(F.col("n_nationkey"), F.struct(F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("concept_id"), F.col("n_nationkey").alias("id")).alias("r"))
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["r"])
    _read(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.lit(3).alias("format"), items.alias("records")))).coalesce(1).write.text(path)
    files = store._Files(spark, path)
    for name in files.children(path):
        if name.startswith("part-"):
            files.move(f"{path}/{name}", f"{path}/nations.json")
    return records.with_keys(records.read_json(spark, path), "concept_id name id".split())


def _json(text: str) -> Query:
    parsed = bql.parse(text)
    return lambda spark, sf_dir: lookup.run(json_memory(spark, sf_dir), parsed, NOW_MS)


def _json_sql(where: str, condition: str = "true", top: int = 50) -> str:
    return f"""
with numbered as (select *, epoch_us(ts) // 1000 as ts_ms, row_number() over (order by event_id) - 1 as record_id from events),
found as (select *, row_number() over (order by event_id) as rank from numbered where {where})
select cast(event_id as varchar) as event_id, event_type, rank, 0 as depth, record_id from found where {condition} order by record_id limit {top}"""


def _json_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two filters, one of them on numbers."""
    parsed = bql.Lookup("concept", KIND, 1, "up", ("event_id",), ({"field": "ts", "op": ">", "value": TS_MS}, {"field": "value", "op": "<", "value": 50}))
    return lookup.matched(json_memory(spark, sf_dir), parsed, NOW_MS).select("event_id", "ts", "ord")


def _two_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = bql.Lookup("concept", KIND, 1, "up", ("event_id",), ({"field": "ts", "op": ">", "value": TS_MS}, {"field": "value", "op": "<", "value": 50}))
    return lookup.matched(catalogue.events(spark, sf_dir), parsed, NOW_MS).select("event_id", "value")


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = bql.parse("FROM concept(r1) BALLOON radius=1 direction=down RETURN name")
    return lookup.run(json_document(spark, sf_dir), parsed, NOW_MS)


# packs


def packs(spark: SparkSession, sf_dir: str) -> str:
    """Regions, nations, customers, orders and suppliers as packs; some lines of the last are broken or blank."""
    root = new_path(spark, "packs")
    region, nation, customer, order, supplier = (_read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "supplier"))
    near = region.select(F.struct(F.lit(0).alias("table"), F.col("r_regionkey").alias("key")).alias("k"), _line(id=_id("SEED_r", "r_regionkey"), name=F.col("r_name")).alias("line"))
    far = nation.select(F.struct(F.lit(1).alias("table"), F.col("n_nationkey").alias("key")).alias("k"), _line(id=_id("SEED_n", "n_nationkey"), region=_id("SEED_r", "n_regionkey")).alias("line"))
    line = F.when(F.col("s_acctbal") < 0, "{broken").when(F.col("s_suppkey") % 7 == 0, "").otherwise(_line(name=F.col("s_name"), at=F.array(_id("SEED_n", "s_nationkey"))))
    tables = {
        "seeds": near.unionByName(far),
        "bridges": customer.select(F.col("c_custkey").alias("k"), _line(bridge_id=_id("BRIDGE_c", "c_custkey"), to=_id("SEED_n", "c_nationkey")).alias("line")),
        "routes": order.select(F.col("o_orderkey").alias("k"), _line(route_id=_id("ROUTE_o", "o_orderkey"), of=_id("BRIDGE_c", "o_custkey")).alias("line")),
        "results": supplier.select(F.col("s_suppkey").alias("k"), line.alias("line")),
    }
    for name, table in tables.items():
        table.orderBy("k").select("line").write.text(f"{root}/PACKS/code_{name}.bpack")
    return root


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


_PACKS = """lines as (
  select 0 as no, 'code_seeds.bpack' as pack, row_number() over (order by r_regionkey) as line, 'SEED_r' || r_regionkey as record_id, ['id', 'SEED_r' || r_regionkey, 'name', r_name] as strings, true as good from region
  union all select 0, 'code_seeds.bpack', (select count(*) from region) + row_number() over (order by n_nationkey), 'SEED_n' || n_nationkey, ['id', 'SEED_n' || n_nationkey, 'region', 'SEED_r' || n_regionkey], true from nation
  union all select 1, 'code_bridges.bpack', row_number() over (order by c_custkey), 'BRIDGE_c' || c_custkey, ['bridge_id', 'BRIDGE_c' || c_custkey, 'to', 'SEED_n' || c_nationkey], true from customer
  union all select 2, 'code_routes.bpack', row_number() over (order by o_orderkey), 'ROUTE_o' || o_orderkey, ['route_id', 'ROUTE_o' || o_orderkey, 'of', 'BRIDGE_c' || o_custkey], true from orders
  union all select 3, 'code_results.bpack', line, s_name, ['name', s_name, 'at', 'SEED_n' || s_nationkey], case when s_acctbal < 0 then false when s_suppkey % 7 = 0 then null else true end
    from (select *, row_number() over (order by s_suppkey) as line from supplier)),
records as (select no * 1099511627776 + line as ord, pack || ':' || line as pointer, pack, cast(line as integer) as line, record_id, list_sort(list_distinct(strings)) as strings from lines where good)"""


def _pack_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = records.read_packs(spark, packs(spark, sf_dir))
    return rows.select("ord", "pointer", "pack", "line", "record_id", F.concat_ws("|", "strings").alias("strings"))


def _pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_packs(spark, packs(spark, sf_dir))[1]


def _pack_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.seed_search(records.read_packs(spark, packs(spark, sf_dir))[0], "seed_R1")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("ord"))
    return records.resolve_lines(json_memory(spark, sf_dir), wanted).select("ord", "event_id")


def _expansion(start: str, radius: int, most: int = 50) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = persist(records.read_packs(spark, packs(spark, sf_dir))[0], "pack-rows")  # every level reads them
        found = graph.expand_records(rows, rows.where(F.col("record_id") == start).select("record_id", "pointer"), radius, most)
        return found.select("ord", "depth", "pointer", "record_id", "pack", F.concat_ws("|", "ids").alias("ids"))

    return run


def _expansion_sql(start: str, radius: int, most: int = 50) -> str:
    """Levels in full, then the first rows by depth and order, which are those that a bounded walk takes."""
    levels = [f"f0 as (select unnest([record_id, pointer]) as s from whole where record_id = '{start}'), l0 as (select null as ord where false)"]
    for d in range(1, radius + 1):
        seen = " union all ".join(f"select ord from l{k}" for k in range(d))
        levels.append(f"l{d} as (select distinct w.ord from words w join f{d - 1} using (s) where w.ord not in ({seen})), f{d} as (select distinct unnest(ids) as s from whole semi join l{d} using (ord))")
    rows = " union all ".join(f"select {d} as depth, ord from l{d}" for d in range(1, radius + 1))
    return f"""
with {_PACKS},
whole as (select *, list_distinct(list_concat(strings, [record_id, pointer])) as known, list_sort(list_filter(known, lambda s: regexp_matches(s, '^(SEED|BRIDGE|ROUTE|PATTERN|RESULTREC)_')))[:20] as ids from records),
words as (select ord, unnest(known) as s from whole),
{", ".join(levels)}
select ord, depth, pointer, record_id, pack, array_to_string(ids, '|') as ids from ({rows}) join whole using (ord) order by depth, ord limit {most}"""


# framed containers

_CUSTOMER_JSON = """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}'"""
_CRC_TABLE = "crc_table as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as steps)"


def _crc_sql(text: str) -> str:
    """CRC-32 of a text by its table, byte for byte; goes with ``crc_table`` in the same FROM."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})) + 1, 2), lambda i: cast('0x' || substr(hex(encode({text})), cast(i as integer), 2) as bigint))"
    return f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), {octets}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"


def _id_sql(text: str) -> str:
    """The first eight bytes of the SHA-256, little end first, as a number."""
    return "cast('0x' || " + " || ".join(f"substr(sha256({text}), {2 * k + 1}, 2)" for k in reversed(range(8))) + " as ubigint)"


def _little_sql(number: str) -> str:
    """Four bytes as hexadecimal digits, little end first."""
    digits = f"printf('%08x', cast({number} as bigint))"
    return " || ".join(f"substr({digits}, {k}, 2)" for k in (7, 5, 3, 1))


def _file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames.register(spark)
    path = new_path(spark, "frames")
    _read(spark, sf_dir, "customer").select(_line(c_name=F.col("c_name"), c_custkey=F.col("c_custkey")).alias("payload")).write.format("frames").mode("append").option("path", path).option("kind", "seed").save()
    return spark.read.format("frames").option("path", path).option("kind", "seed").load().select("record_id", "crc32", "payload")


def _store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per type and distinct id of a typed store."""
    frames.register(spark)
    path = new_path(spark, "store")
    rows = catalogue._store(spark, sf_dir).select(F.col("record_type").alias("type"), F.col("offset").alias("timestamp_ms"), _line(id=F.col("id")).alias("payload"))
    rows.write.format("frames").mode("append").option("path", path).option("layout", "store").save()
    back = spark.read.format("frames").option("path", path).option("layout", "store").load()
    last = back.select(F.col("type").alias("record_type"), F.get_json_object("payload", "$.id").alias("id"), F.col("timestamp_ms").alias("offset"))
    return replay.last_offsets(last)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction log, written as framed entries and read again; notes are checkpoints."""
    frames.register(spark)
    path = new_path(spark, "log")
    log = catalogue.tx_log(spark, sf_dir)
    kind = F.when(F.col("op_type") == "NOTE", "CHECKPOINT").otherwise(F.col("op_type"))
    rows = log.select(kind.alias("type"), F.col("seq").alias("timestamp_ms"), "seq", _line(tx_id=F.col("tx_id"), payload=F.col("payload")).alias("payload"))
    rows.write.format("frames").mode("append").option("path", path).option("layout", "log").save()
    back = spark.read.format("frames").option("path", path).option("layout", "log").load()
    return back.select("seq", F.col("type").alias("op_type"), *[F.get_json_object("payload", f"$.{k}").alias(k) for k in ("tx_id", "payload")])


def _log_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.transactions(_log(spark, sf_dir))


def _index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of nation, a table of fixed size, through the container of an index file."""
    rows = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("record_id"), F.lit("bseed").alias("source_kind"), F.col("n_nationkey").alias("record_index"), F.col("n_name").alias("type"))
    found = [r.asDict() for r in index.attributes(rows).orderBy("record_id").collect()]
    back = frames.decode_index(frames.encode_index({"record_count": len(found), "records": found}, 0))["records"]
    return spark.createDataFrame([(r["record_id"], r["payload_type"], r["logical_id"], r["trust_state"]) for r in back], "record_id int, payload_type string, logical_id string, trust_state string")


# snapshots and recovery


def _snapshot(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    path = new_path(spark, "snapshot")
    of = lambda t, key, name: _read(spark, sf_dir, t).select(F.col(key).cast("string").alias("key"), _line(id=F.col(key).cast("string"), type=F.col(name)).alias("payload"), F.col(key).alias("seq"))
    e = _read(spark, sf_dir, "events")
    op = catalogue._mapped("event_type", {"purchase": "UPSERT_SEED", "view": "UPSERT_BRIDGE", "error": "DELETE_SEED"})
    log = e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), _line(id=F.col("user_id").cast("string"), type=F.col("event_type")).alias("payload"))
    store.write_snapshot(of("customer", "c_custkey", "c_mktsegment"), of("supplier", "s_suppkey", "s_name"), log, path)
    return store.read_snapshot(spark, path)


_SNAPSHOT = """ops as (
  select 'bseed' as source_kind, cast(c_custkey as varchar) as key, 0 as later, c_custkey as seq, c_mktsegment as kind from customer
  union all select 'bbridge', cast(s_suppkey as varchar), 0, s_suppkey, s_name from supplier
  union all select 'bseed', cast(user_id as varchar), 1, event_id, case when event_type = 'purchase' then 'purchase' end from events where event_type in ('purchase', 'error')
  union all select 'bbridge', cast(user_id as varchar), 1, event_id, 'view' from events where event_type = 'view'),
live as (select * from (select *, row_number() over (partition by source_kind, key order by later desc, seq desc) as r from ops) where r = 1 and kind is not null)"""


def _snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _snapshot(spark, sf_dir)
    return tables["seeds"].unionByName(tables["bridges"]).select("source_kind", "key", F.get_json_object("payload", "$.type").alias("kind"))


def _snapshot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir)["index"].select("record_id", "source_kind", "payload_type", "trust_state", "logical_id", "relation")


def _recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a first run, a repeated one, and a dry one before them."""
    path = new_path(spark, "applied")
    action = F.when(F.col("seq") % 5 == 0, "delete_record").otherwise("append_record")
    log = catalogue.tx_log(spark, sf_dir).withColumn("payload", _line(action=action))
    names = "committed_count pending_count aborted_count unsupported_count skipped_count applied_count".split()
    out = []
    for run, dry in enumerate((True, False, False)):
        counts = store.recover(log, path, dry)
        out.append((run, *(counts[n] for n in names), counts.get("would_apply_count")))
    return spark.createDataFrame(out, "run int, " + ", ".join(f"{n} bigint" for n in [*names, "would_apply_count"]))


def _recovery_sql() -> str:
    counts = "count(*) filter (state = 'committed') as c, count(*) filter (state = 'pending') as p, count(*) filter (state = 'aborted') as a, count(*) filter (state = 'committed' and intent_seq % 5 = 0) as u"
    row = lambda run, skipped, applied, would: f"select {run} as run, c as committed_count, p as pending_count, a as aborted_count, u as unsupported_count, {skipped} as skipped_count, {applied} as applied_count, cast({would} as bigint) as would_apply_count from n"
    return f"with {catalogue._TX}, n as (select {counts} from tx) " + " union all ".join((row(0, "0", "0", "c - u"), row(1, "0", "c - u", "null"), row(2, "c - u", "0", "null")))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, a table of fixed size, as versions: one active, one never completed, which recovery passes over."""
    path = new_path(spark, "versions")
    rows = [r.asDict() for r in _read(spark, sf_dir, "nation").select(_named("n", "n_nationkey").alias("record_id"), F.col("n_name").alias("type"), F.lit("RAW").alias("trust_state")).orderBy("record_id").collect()]
    snapshots.commit(path, 1, rows[:5], [])
    snapshots.commit(path, 2, rows, rows[:2])
    snapshots.stage(path, 3, [], [], complete=False)
    found = snapshots.recover(path)
    body = [(found["recovered_version"], kind, r["record_id"], r["type"]) for kind in ("seeds", "bridges") for r in found[kind]]
    return spark.createDataFrame(body, "version int, kind string, record_id string, type string")


# small operators without files


def _fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = catalogue.change_log(spark, sf_dir, "SEED", "user_id").withColumn("key", F.when(F.col("seq") % 3 > 0, F.col("key")))
    return replay.with_fallback_keys(log, "SEED")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = catalogue._mapped("event_type", {"purchase": "seed", "view": "BRIDGE ", "error": "meta", "click": "intent"})
    user = F.col("user_id").cast("string")
    fields = {"seed_id": user, "seed_type": F.when(F.col("event_id") % 2 == 0, " ").otherwise("T"), "bridge_id": user, "from_seed": user, "to_seed": F.when(F.col("event_id") % 3 == 0, None).otherwise(user), "bridge_type": user, "tx_id": user}
    return replay.validated(_read(spark, sf_dir, "events").select("event_id", kind.alias("record_type"), *[c.alias(n) for n, c in fields.items()])).select("event_id", "error")


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAIL_TEST").when(F.col("event_type") == "view", gates.SKIPPED).otherwise(gates.PASSED)
    return gates.summary(_read(spark, sf_dir, "events").select(status.alias("status"), (F.col("event_type") != "view").alias("required")))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = canonical.batch_frame(F.col("props"), F.col("event_id") % 7, F.col("user_id"))
    return _read(spark, sf_dir, "events").select("event_id", F.lower(F.hex(frame)).alias("frame"))


def _payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.payload_bytes(_read(spark, sf_dir, "documents"), "text")


_SEED = "FROM seed(\"{}\") BALLOON radius=1 direction=up {} RETURN event_id, event_type"
_CATALOGUE: dict[str, tuple[Query, str]] = {
    "json_lines_lookup": (_json(_SEED.format(USER, "")), _json_sql(f"user_id = {USER}")),
    "json_lines_filter_eq": (_json(_SEED.format(USER, "FILTER event_type = click")), _json_sql(f"user_id = {USER}", "event_type = 'click'")),
    "json_lines_ts_gt": (_json(_SEED.format(USER, f"FILTER ts > {TS_MS}") + " TOP 20"), _json_sql(f"user_id = {USER}", f"ts_ms > {TS_MS}", 20)),
    "json_lines_two_filters": (_json_all, f"select cast(event_id as varchar) as event_id, epoch_us(ts) // 1000 as ts, ord from (select *, row_number() over (order by event_id) - 1 as ord from events) where event_type = '{KIND}' and epoch_us(ts) // 1000 > {TS_MS} and value < 50"),
    "json_lines_resolve": (_resolved, "select ord, cast(event_id as varchar) as event_id from (select event_id, row_number() over (order by event_id) - 1 as ord from events) where ord in (select r_regionkey from region)"),
    "json_document_lookup": (_document, "select n_name as name, row_number() over (order by n_nationkey) as rank, 0 as depth, cast(n_nationkey as varchar) as record_id from nation where n_regionkey = 1"),
    "bql_two_filters": (_two_filters, f"select event_id, value from events where event_type = '{KIND}' and epoch_us(ts) // 1000 > {TS_MS} and value < 50"),
    "pack_records": (_pack_records, f"with {_PACKS} select ord, pointer, pack, line, record_id, array_to_string(strings, '|') as strings from records"),
    "pack_lines": (_pack_lines, f"with {_PACKS}, n as (select pack, count(*) filter (good) as records, count(*) filter (not good) as bad_lines from lines where good is not null group by pack) select pack, records, bad_lines from n union all select 'code_patterns.bpack', null, null"),
    "pack_search": (_pack_search, f"with {_PACKS} select case when list_contains(list_transform(strings, lambda s: lower(s)), 'seed_r1') then 100 else 20 end as score, pointer, record_id, pack from records where len(list_filter(strings, lambda s: contains(lower(s), 'seed_r1'))) > 0 order by score desc, pack, record_id, pointer limit 10"),
    "record_expansion": (_expansion("ROUTE_o5", 3), _expansion_sql("ROUTE_o5", 3)),
    "record_expansion_wide": (_expansion("SEED_r1", 2, 400), _expansion_sql("SEED_r1", 2, 400)),
    "frames_file": (_file_round_trip, f"with {_CRC_TABLE}, c as (select {_CUSTOMER_JSON} as payload from customer) select cast({_id_sql('payload')} as varchar) as record_id, {_crc_sql('payload')} as crc32, payload from c, crc_table"),
    "frames_store": (_store_round_trip, f'with {catalogue._STORE} select record_type, id, max("offset") as last_offset from store group by all'),
    "frames_log": (_log_transactions, f"with {catalogue._TX} select * from tx"),
    "frames_index": (_index_round_trip, "select n_nationkey as record_id, n_name as payload_type, 'rid:' || n_nationkey as logical_id, 'RAW' as trust_state from nation"),
    "snapshot_rows": (_snapshot_rows, f"with {_SNAPSHOT} select source_kind, key, kind from live"),
    "snapshot_index": (_snapshot_index, f"with {_SNAPSHOT} select key as record_id, source_kind, kind as payload_type, 'RAW' as trust_state, key as logical_id, '' as relation from live"),
    "recovery_counts": (_recovery, _recovery_sql()),
    "snapshot_versions": (_versions, "select 2 as version, 'seeds' as kind, 'n:' || n_nationkey as record_id, n_name as type from nation union all (select 2, 'bridges', 'n:' || n_nationkey, n_name from nation order by 'n:' || n_nationkey limit 2)"),
    "wal_fallback_keys": (
        _fallback_keys,
        "with log as (select *, case when event_type in ('purchase', 'view') then 'UPSERT_SEED' when event_type = 'error' then 'DELETE_SEED' else 'NOTE' end as op from events), numbered as (select *, count(*) filter (op = 'UPSERT_SEED') over (order by event_id) - 1 as n from log) "
        "select event_id as seq, op, case when event_id % 3 > 0 then cast(user_id as varchar) when op = 'UPSERT_SEED' then 'wal_seed_' || n end as key, cast(event_id as varchar) as payload from numbered",
    ),
    "wal_validation": (_validated, "select event_id, case event_type when 'purchase' then case when event_id % 2 = 0 then 'seed_type' end when 'view' then case when event_id % 3 = 0 then 'to_seed' end when 'error' then 'meta_id' when 'click' then 'action' else 'unknown type' end as error from events"),
    "gate_summary": (
        _gate,
        "with n as (select count(*) filter (event_type <> 'view') as required_total, count(*) filter (event_type not in ('view', 'error')) as required_pass, count(*) filter (event_type = 'error') as required_fail_or_missing, count(*) filter (event_type = 'view') as optional_total, cast(0 as bigint) as optional_pass, count(*) filter (event_type = 'view') as optional_skipped from events) "
        "select *, required_fail_or_missing = 0 as passed from n",
    ),
    "batch_encode": (_batch, f"with {_CRC_TABLE} select event_id, substr(sha256(props), 1, 16) || " + " || ".join(map(_little_sql, ("event_id % 7", "user_id", "octet_length(encode(props))", _crc_sql("props")))) + " || lower(hex(encode(props))) as frame from events, crc_table"),
    "batch_payload_bytes": (_payload_bytes, "select count(*) as n_records, cast(sum(strlen(text)) as bigint) as n_bytes from documents"),
}

#: The catalogue's query of record ids, with the checksums that SQL finds by their table.
CRC_SQL = f"""with {_CRC_TABLE}, r as (select r_regionkey, '{{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}}' as t from region) select r_regionkey, cast({_id_sql('t')} as decimal(20, 0)) as record_id, {_crc_sql('t')} as crc32 from r, crc_table"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CATALOGUE.items()} | {"record_ids_crc32": CRC_SQL}
