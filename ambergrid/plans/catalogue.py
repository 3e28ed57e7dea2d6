"""Named queries over the test tables, and the SQL that gives the same rows.

events are timed records (seed: user, concept: type, position: id) and, by type, also log entries;
region, nation, customer and orders are seeds and their foreign keys edges; documents with labels
carry trust states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import canonical
from ..lang import bql
from ..operators import graph, index, lookup, replay
from . import history

Query = Callable[[SparkSession, str], DataFrame]
#: A moment inside the events, in place of the clock.
NOW_MS = 1_705_500_000_000
TS_MS = 1_704_930_358_551
USER, KIND = "13", "purchase"
DAY_MS = 86_400_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("seed"), F.col("event_type").alias("concept"), "event_id", "user_id", "event_type", "ts", "value", "props")


def _named(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst, relation) from the referenced row to the one that refers to it."""
    keys = [("region", "n_regionkey", "nation", "n_nationkey", "nation"), ("nation", "c_nationkey", "customer", "c_custkey", "customer"), ("customer", "o_custkey", "order", "o_orderkey", "orders")]
    parts = [_read(spark, sf_dir, t).select(_named(p, fk).alias("src"), _named(c, pk).alias("dst"), F.lit(fk).alias("relation")) for p, fk, c, pk, t in keys]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EDGES = """edges as (
  select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst, 'n_regionkey' as relation from nation
  union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'c_nationkey' from customer
  union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'o_custkey' from orders)"""


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    trust = F.when(F.col("toxic") == 1, "QUARANTINED").when(F.col("quality") == 1, "VERIFIED").when(F.col("l.doc_id").isNotNull(), "CANDIDATE").otherwise("RAW")
    rows = docs.select("doc_id", "lang", "source").alias("d").join(labels.alias("l"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("record_id"), F.lit("bseed").alias("source_kind"), F.col("doc_id").alias("record_index"), F.col("lang").alias("type"), trust.alias("trust_state"), _named("doc", "doc_id").alias("seed_id"))


def bridge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("record_id"), F.lit("bbridge").alias("source_kind"), F.col("o_orderkey").alias("record_index"), F.lit("o_custkey").alias("relation"), _named("ob", "o_orderkey").alias("bridge_id"))


def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.attributes(document_records(spark, sf_dir)).unionByName(index.attributes(bridge_records(spark, sf_dir)))


_INDEX = """records as (
  select d.doc_id as record_id, 'bseed' as source_kind, d.doc_id as record_index, lang as payload_type,
    case when toxic = 1 then 'QUARANTINED' when quality = 1 then 'VERIFIED' when l.doc_id is not null then 'CANDIDATE' else 'RAW' end as trust_state,
    'doc:' || d.doc_id as logical_id, '' as relation
  from documents d left join labels l on d.doc_id = l.doc_id
  union all select o_orderkey, 'bbridge', o_orderkey, 'o_custkey', 'RAW', 'ob:' || o_orderkey, 'o_custkey' from orders)"""

_OPS = {"signup": "INTENT", "purchase": "COMMIT", "error": "ABORT"}


def _mapped(column: str, names: dict[str, str]) -> Column:
    out = F.lit("NOTE")
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def tx_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction is what a user does in a day."""
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), _tx_id().alias("tx_id"), _mapped("event_type", _OPS).alias("op_type"), F.col("props").alias("payload"))


def _tx_id() -> Column:
    return F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))


_TX = """tx as (
  select user_id || ':' || cast(ts as date) as tx_id, max(event_id) filter (event_type = 'signup') as intent_seq, arg_max(props, event_id) filter (event_type = 'signup') as payload,
    case when bool_or(event_type = 'error') then 'aborted' when bool_or(event_type = 'purchase') then 'committed' else 'pending' end as state
  from events group by user_id, cast(ts as date) having max(event_id) filter (event_type = 'signup') is not null)"""


def change_log(spark: SparkSession, sf_dir: str, what: str, column: str) -> DataFrame:
    op = {"purchase": f"UPSERT_{what}", "view": f"UPSERT_{what}", "error": f"DELETE_{what}"}
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), _mapped("event_type", op).alias("op"), F.col(column).cast("string").alias("key"), F.col("event_id").cast("string").alias("payload"))


def _compact_sql(base: str, column: str) -> str:
    return f"""
with ops as (
  select key, 0 as later, seq, payload from ({base})
  union all select cast({column} as varchar), 1, event_id, case when event_type = 'error' then null else cast(event_id as varchar) end from events where event_type in ('purchase', 'view', 'error')),
ranked as (select *, row_number() over (partition by key order by later desc, seq desc) as r from ops)
select key, payload from ranked where r = 1 and payload is not null"""


def _lookup(text: str, closed: bool = False) -> Query:
    parsed = bql.parse(text)
    return lambda spark, sf_dir: lookup.run(events(spark, sf_dir), parsed, NOW_MS, closed_windows=closed)


def _all(text: str, closed: bool = False) -> Query:
    """Every match, without the language's limit."""
    parsed = bql.parse(text)
    return lambda spark, sf_dir: lookup.matched(events(spark, sf_dir), parsed, NOW_MS, closed).select("event_id", "event_type", "value")


def _from(clause: str, rest: str = "", fields: str = "event_id, event_type, value") -> str:
    return f"FROM {clause} BALLOON radius=1 direction=up_down {rest} RETURN {fields}"


def _lookup_sql(where: str, condition: str = "true", columns: str = "event_id, event_type, value", top: int = 50) -> str:
    return f"""
with found as (select *, epoch_us(ts) // 1000 as ts_ms, row_number() over (order by event_id) as rank from events where {where})
select {columns}, rank, 0 as depth, event_id as record_id from found where {condition} order by event_id limit {top}"""


def _all_sql(where: str) -> str:
    return f"select event_id, event_type, value from (select *, epoch_us(ts) // 1000 as ts_ms from events) where {where}"


def _bfs(start: str, radius: int, direction: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return graph.neighbours(edges(spark, sf_dir), spark.createDataFrame([(start,)], "node string"), radius, direction)

    return run


def _bfs_sql(start: str, radius: int, direction: str) -> str:
    steps = {"down": "select src, dst from edges", "up": "select dst as src, src as dst from edges", "lateral": "select a.dst as src, b.dst as dst from edges a join edges b on a.src = b.src and a.dst <> b.dst"}
    steps["up_down"] = f"{steps['down']} union all {steps['up']}"
    return f"""
with recursive {_EDGES},
steps as ({steps[direction]}),
reached(node, depth) as (select '{start}', 0 union select s.dst, r.depth + 1 from reached r join steps s on s.src = r.node where r.depth < {radius})
select node, min(depth) as depth from reached group by node"""


def _find(text: str) -> Query:
    return lambda spark, sf_dir: index.find_rows(record_index(spark, sf_dir), text)


def _find_sql(where: str) -> str:
    return f"with {_INDEX} select record_id, source_kind, record_index, payload_type, trust_state, logical_id, relation from records where {where}"


def _hand_made(op: str) -> Query:
    parsed = bql.Lookup("concept", KIND, 1, "up", ("event_id", "value"), ({"field": "value", "op": op, "value": 50},))
    return lambda spark, sf_dir: lookup.matched(events(spark, sf_dir), parsed, NOW_MS).select("event_id", "value")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("payload"), F.col("c_custkey").alias("seq"))


def _bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("key"), F.col("s_nationkey").cast("string").alias("payload"), F.col("s_suppkey").alias("seq"))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [_read(spark, sf_dir, t).select(F.lit(kind).alias("record_type"), F.col(key).cast("string").alias("id"), F.col(at).cast("bigint").alias("offset")) for t, kind, key, at in (("customer", "SEED", "c_nationkey", "c_custkey"), ("supplier", "BRIDGE", "s_nationkey", "s_suppkey"), ("orders", "ROUTE", "o_custkey", "o_orderkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_STORE = """store as (
  select 'SEED' as record_type, cast(c_nationkey as varchar) as id, c_custkey as "offset" from customer
  union all select 'BRIDGE', cast(s_nationkey as varchar), s_suppkey from supplier
  union all select 'ROUTE', cast(o_custkey as varchar), o_orderkey from orders)"""


def _searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select(F.format_string("%s:%d", "source", "doc_id").alias("pointer"), F.col("source").alias("pack"), F.col("doc_id").cast("string").alias("record_id"), F.array("text", "lang", "source", F.lit("text"), F.lit("lang"), F.lit("source")).alias("strings"))


def _search(text: str) -> Query:
    return lambda spark, sf_dir: graph.seed_search(_searchable(spark, sf_dir), text)


def _search_sql(text: str) -> str:
    fields = ("text", "lang", "source", "'text'", "'lang'", "'source'")
    exact = " or ".join(f"lower({f}) = '{text}'" for f in fields)
    part = " or ".join(f"contains(lower({f}), '{text}')" for f in fields)
    return f"""
select case when {exact} then 100 else 20 end as score, source || ':' || doc_id as pointer, cast(doc_id as varchar) as record_id, source as pack
from documents where {part} order by score desc, pack, record_id, pointer limit 10"""


def _index_vs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the pushed-down time predicate and the plain one differ: none."""
    e = events(spark, sf_dir)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    parsed = bql.parse(_from(f'concept("{KIND}")', f"FILTER ts > {TS_MS}"))
    pushed = lookup.matched(e, parsed, NOW_MS).select("event_id")
    plain = e.where((F.col("event_type") == KIND) & (ms > TS_MS)).select("event_id")
    return pushed.exceptAll(plain).unionByName(plain.exceptAll(pushed))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = _read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")
    return r.select(_named("region", "r_regionkey").alias("pointer"), F.col("r_name").alias("name")).unionByName(n.select(_named("nation", "n_nationkey").alias("pointer"), F.col("n_name").alias("name")))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    text = F.to_json(F.struct("n_name", "n_nationkey", "n_regionkey"))
    return n.select("n_nationkey", text.alias("canonical"), F.substring(F.sha2(text, 256), 1, 16).alias("id_hex"))


def _crcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.struct("r_name", "r_regionkey"))
    return _read(spark, sf_dir, "region").select("r_regionkey", canonical.record_id_of(text).alias("record_id"), canonical.crc32_of(text).alias("crc32"))


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.trim(F.regexp_replace("props", r"\s+", " ")), F.lit(f"\n{history.VERSION}"))
    return _read(spark, sf_dir, "events").select("event_id", F.sha2(text, 256).alias("query_hash"))


def _pack_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").groupBy(F.col("source").alias("pack")).agg(F.count("*").alias("records"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").where("event_type = 'click'").select(_tx_id().alias("tx_id"))


def _tx(state: str) -> Query:
    return lambda spark, sf_dir: replay.listed(tx_log(spark, sf_dir), state)


_WINDOW_DAY, _WINDOW_WEEK = _from(f'concept("{KIND}")', "FILTER ts IN last_day"), _from(f'concept("{KIND}")', "FILTER ts IN last_7_days")
_CATALOGUE: dict[str, tuple[Query, str | None]] = {
    "bql_seed_lookup": (_lookup(_from(f'seed("{USER}")')), _lookup_sql(f"user_id = {USER}")),
    "bql_seed_lookup_all": (_all(_from(f'seed("{USER}")')), _all_sql(f"user_id = {USER}")),
    "bql_concept_lookup": (_lookup(_from(f"concept({KIND})") + " TOP 20"), _lookup_sql(f"event_type = '{KIND}'", top=20)),
    "bql_filter_eq": (_lookup(_from(f'seed("{USER}")', "FILTER event_type = click")), _lookup_sql(f"user_id = {USER}", "event_type = 'click'")),
    "bql_filter_eq_all": (_all(_from(f'seed("{USER}")', "FILTER event_type = click")), _all_sql(f"user_id = {USER} and event_type = 'click'")),
    "bql_filter_depth": (_lookup(_from(f'seed("{USER}")', "FILTER depth = 0")), _lookup_sql(f"user_id = {USER}")),
    "bql_filter_missing_is_none": (_all(_from(f"concept({KIND})", 'FILTER nothing = "None"')), _all_sql(f"event_type = '{KIND}'")),
    "bql_ts_gt": (_lookup(_from(f'seed("{USER}")', f"FILTER ts > {TS_MS}", "event_id, event_type, ts") + " TOP 20"), _lookup_sql(f"user_id = {USER}", f"ts_ms > {TS_MS}", "event_id, event_type, ts", 20)),
    "bql_ts_gt_all": (_all(_from(f"concept({KIND})", f"FILTER ts > {TS_MS}")), _all_sql(f"event_type = '{KIND}' and ts_ms > {TS_MS}")),
    "bql_ts_lt": (_lookup(_from(f'seed("{USER}")', f"FILTER ts < {TS_MS}")), _lookup_sql(f"user_id = {USER}", f"ts_ms < {TS_MS}")),
    "bql_ts_lt_all": (_all(_from(f"concept({KIND})", f"FILTER ts < {TS_MS}")), _all_sql(f"event_type = '{KIND}' and ts_ms < {TS_MS}")),
    "bql_ts_last_hour": (_all(_from(f"concept({KIND})", "FILTER ts IN last_hour")), _all_sql(f"event_type = '{KIND}' and ts_ms > {NOW_MS - 3_600_000}")),
    "bql_ts_last_day_is_empty": (_all(_WINDOW_DAY), _all_sql("false")),
    "bql_window_inclusive_day": (_all(_WINDOW_DAY, True), _all_sql(f"event_type = '{KIND}' and ts_ms between {NOW_MS - DAY_MS} and {NOW_MS}")),
    "bql_window_inclusive_7d": (_all(_WINDOW_WEEK, True), _all_sql(f"event_type = '{KIND}' and ts_ms between {NOW_MS - 7 * DAY_MS} and {NOW_MS}")),
    "bql_ts_equals_is_empty": (_all(_from(f"concept({KIND})", "FILTER ts = 5")), _all_sql("false")),
    "bql_number_gt": (_hand_made(">"), f"select event_id, value from events where event_type = '{KIND}' and value > 50"),
    "bql_number_lt": (_hand_made("<"), f"select event_id, value from events where event_type = '{KIND}' and value < 50"),
    "bql_counts": (
        lambda spark, sf_dir: lookup.counts(events(spark, sf_dir), bql.parse(_from(f"concept({KIND})", f"FILTER ts > {TS_MS}")), NOW_MS),
        f"select count(*) as expanded_count, count(*) filter (epoch_us(ts) // 1000 > {TS_MS}) as matched_count, least(count(*) filter (epoch_us(ts) // 1000 > {TS_MS}), 50) as returned_count from events where event_type = '{KIND}'",
    ),
    "bql_ts_index_vs_scan": (_index_vs_scan, "select event_id from events where false"),
    "bql_missing_field_projection": (_lookup(_from(f'seed("{USER}")', fields="event_id, nowhere")), _lookup_sql(f"user_id = {USER}", columns="event_id, cast(null as varchar) as nowhere")),
    "find_by_type": (_find("FIND type = fr"), _find_sql("payload_type = 'fr'")),
    "find_by_trust": (_find('find Trust_State = "VERIFIED"'), _find_sql("trust_state = 'VERIFIED'")),
    "find_by_relation": (_find("FIND relation = o_custkey"), _find_sql("relation = 'o_custkey'")),
    "find_by_logical_id": (_find("FIND logical_id = 'doc:17'"), _find_sql("logical_id = 'doc:17'")),
    "find_by_record_id": (_find("FIND record_id = 32"), _find_sql("record_id = 32")),
    "index_records": (record_index, _find_sql("true")),
    "index_postings_size": (
        lambda spark, sf_dir: index.postings(record_index(spark, sf_dir)),
        f"with {_INDEX}, " + "p as (" + " union all ".join(f"select '{a}' as attribute, cast({c} as varchar) as value from records" for a, c in (("record_id", "record_id"), ("type", "payload_type"), ("trust_state", "trust_state"), ("relation", "relation"), ("logical_id", "logical_id"))) + ") select attribute, value, count(*) as n from p where not (attribute = 'relation' and value = '') group by all",
    ),
    "index_positions": (
        lambda spark, sf_dir: index.posting_positions(record_index(spark, sf_dir), "type").select("value", F.size("positions").cast("bigint").alias("n"), F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last")),
        f"with {_INDEX} select payload_type as value, count(*) as n, min(record_index) as first, max(record_index) as last from records group by all",
    ),
    "distinct_trust_types": (
        lambda spark, sf_dir: index.distinct_states(record_index(spark, sf_dir)).select(F.concat_ws(",", "trust_states").alias("trust_states"), F.concat_ws(",", "types").alias("types")),
        f"with {_INDEX} select string_agg(distinct trust_state, ',' order by trust_state) as trust_states, string_agg(distinct payload_type, ',' order by payload_type) as types from records",
    ),
    "store_type_counts": (lambda spark, sf_dir: replay.type_counts(_store(spark, sf_dir)), f"with {_STORE} select record_type, count(*) as n from store group by all"),
    "store_last_by_id": (lambda spark, sf_dir: replay.last_offsets(_store(spark, sf_dir)), f'with {_STORE} select record_type, id, max("offset") as last_offset from store group by all'),
    "wal_tx_states": (lambda spark, sf_dir: replay.transactions(tx_log(spark, sf_dir)), f"with {_TX} select * from tx"),
    "wal_committed": (_tx("committed"), f"with {_TX} select * from tx where state = 'committed'"),
    "wal_pending": (_tx("pending"), f"with {_TX} select * from tx where state = 'pending'"),
    "wal_aborted": (_tx("aborted"), f"with {_TX} select * from tx where state = 'aborted'"),
    "wal_tx_counts": (lambda spark, sf_dir: replay.transaction_counts(tx_log(spark, sf_dir)), f"with {_TX} select " + ", ".join(f"count(*) filter (state = '{s}') as {s}_count" for s in ("committed", "pending", "aborted")) + " from tx"),
    "wal_apply_new_only": (lambda spark, sf_dir: replay.to_apply(tx_log(spark, sf_dir), _applied(spark, sf_dir)), f"with {_TX} select * from tx where state = 'committed' and tx_id not in (select user_id || ':' || cast(ts as date) from events where event_type = 'click')"),
    "wal_next_seq": (lambda spark, sf_dir: replay.next_seq(tx_log(spark, sf_dir)), "select coalesce(max(event_id), 0) + 1 as next_seq from events"),
    "wal_compact_seeds": (lambda spark, sf_dir: replay.in_order(replay.compact(_seeds(spark, sf_dir), change_log(spark, sf_dir, "SEED", "user_id"), "SEED")), _compact_sql("select cast(c_custkey as varchar) as key, c_custkey as seq, c_name as payload from customer", "user_id")),
    "wal_compact_bridges": (lambda spark, sf_dir: replay.compact(_bridges(spark, sf_dir), change_log(spark, sf_dir, "BRIDGE", "event_type"), "BRIDGE"), _compact_sql("select s_name as key, s_suppkey as seq, cast(s_nationkey as varchar) as payload from supplier", "event_type")),
    "wal_replay_stats": (
        lambda spark, sf_dir: replay.replay_stats(change_log(spark, sf_dir, "SEED", "user_id")),
        "select count(*) as wal_entry_count, count(*) filter (event_type in ('purchase', 'view')) as upsert_seed_count, cast(0 as bigint) as upsert_bridge_count, count(*) filter (event_type = 'error') as delete_seed_count, cast(0 as bigint) as delete_bridge_count, count(*) filter (event_type not in ('purchase', 'view', 'error')) as ignored_entry_count from events",
    ),
    "graph_bfs_down": (_bfs("region:1", 3, "down"), _bfs_sql("region:1", 3, "down")),
    "graph_bfs_up": (_bfs("order:5", 3, "up"), _bfs_sql("order:5", 3, "up")),
    "graph_bfs_up_down": (_bfs("customer:7", 3, "up_down"), _bfs_sql("customer:7", 3, "up_down")),
    "graph_bfs_lateral": (_bfs("nation:3", 2, "lateral"), _bfs_sql("nation:3", 2, "lateral")),
    "seed_search_top10": (_search("idiot"), _search_sql("idiot")),
    "seed_search_exact": (_search("src3"), _search_sql("src3")),
    "path_concat_union": (_paths, "select 'region:' || r_regionkey as pointer, r_name as name from region union all select 'nation:' || n_nationkey, n_name from nation"),
    "record_ids_sha256": (_ids, """select n_nationkey, canonical, substr(sha256(canonical), 1, 16) as id_hex from (select n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as canonical from nation)"""),
    "record_ids_crc32": (_crcs, None),  # its SQL is in round_trips
    "history_query_hash": (_hashes, f"select event_id, sha256(trim(regexp_replace(props, '\\s+', ' ', 'g')) || chr(10) || '{history.VERSION}') as query_hash from events"),
    "history_keep_newest": (lambda spark, sf_dir: replay.keep_newest(_read(spark, sf_dir, "events").select("event_id", "ts", "user_id"), 1000, "ts", "event_id"), "select event_id, ts, user_id from events order by ts desc, event_id desc limit 1000"),
    "latency_percentiles": (lambda spark, sf_dir: replay.latency(_read(spark, sf_dir, "events"), "value"), "select quantile_cont(value, 0.5) as p50, list_sort(list(value))[greatest(1, count(*) * 95 // 100)] as p95, min(value) as min, max(value) as max from events"),
    "pack_report": (_pack_report, "select source as pack, count(*) as records, cast(sum(strlen(text)) as bigint) as n_bytes from documents group by all"),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CATALOGUE.items() if sql}
