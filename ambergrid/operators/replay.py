"""Replay of logs: transactions, compaction, recovery.

Every state is an aggregate per key ordered by ``seq`` (unique within a log): nothing is replayed
row by row, and partial aggregates run before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import running_sums


def transactions(log: DataFrame) -> DataFrame:
    """``tx_id``, ``intent_seq``, ``payload``, ``state`` of every transaction that has an INTENT.

    log: seq, op_type, tx_id, and payload if any. The last INTENT counts; ABORT beats COMMIT; order
    between them doesn't matter; without either a transaction is pending.
    """
    intent = F.when(F.col("op_type") == "INTENT", F.col("seq"))
    payload = F.col("payload") if "payload" in log.columns else F.lit(None).cast("string")
    per_tx = log.groupBy("tx_id").agg(
        F.max(intent).alias("intent_seq"),
        F.max_by(payload, intent).alias("payload"),
        F.bool_or(F.col("op_type") == "COMMIT").alias("commit"),
        F.bool_or(F.col("op_type") == "ABORT").alias("abort"),
    )
    state = F.when(F.col("abort"), "aborted").when(F.col("commit"), "committed").otherwise("pending")
    return per_tx.where("intent_seq is not null").select("tx_id", "intent_seq", "payload", state.alias("state"))


def listed(log: DataFrame, state: str) -> DataFrame:
    """The transactions of a state, in the order of their intents' seq."""
    return transactions(log).where(F.col("state") == state).orderBy("intent_seq")


def transaction_counts(log: DataFrame) -> DataFrame:
    found = transactions(log)
    return found.agg(*[F.count_if(F.col("state") == s).alias(f"{s}_count") for s in ("committed", "pending", "aborted")])


def to_apply(log: DataFrame, applied: DataFrame) -> DataFrame:
    """Committed transactions whose tx_id isn't in ``applied``, in the order of their intents' seq."""
    return listed(log, "committed").join(applied.select("tx_id"), "tx_id", "left_anti").orderBy("intent_seq")


def next_seq(log: DataFrame) -> DataFrame:
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next_seq"))


def compact(base: DataFrame, log: DataFrame, what: str) -> DataFrame:
    """``key`` and ``payload`` of the live seeds or bridges after the log, unordered (``in_order`` sorts by key).

    base: key, payload, seq (load order; of repeated keys the last counts). log: seq, op, key,
    payload. ``UPSERT_<what>`` with a payload replaces it, ``DELETE_<what>`` removes it; upserts
    without a payload and other operations change nothing, so they are dropped before the last
    operation of a key is picked.
    """
    upsert, delete = f"UPSERT_{what}", f"DELETE_{what}"
    op = F.upper("op")
    ops = log.where(((op == upsert) & F.col("payload").isNotNull()) | ((op == delete) & F.col("key").isNotNull()))
    # log entries come after all of the base
    changes = ops.select("key", F.struct(F.lit(1).alias("from"), F.col("seq").cast("bigint").alias("seq")).alias("at"), F.when(op == upsert, F.col("payload")).alias("payload"))
    rows = base.select("key", F.struct(F.lit(0).alias("from"), F.col("seq").cast("bigint").alias("seq")).alias("at"), "payload").unionByName(changes)
    last = rows.groupBy("key").agg(F.max_by("payload", "at").alias("payload"))
    return last.where("payload is not null")


def in_order(live: DataFrame) -> DataFrame:
    """Compacted rows by key, in the order of its bytes in UTF-8, which is that of code points."""
    return live.orderBy("key")


def with_fallback_keys(log: DataFrame, what: str) -> DataFrame:
    """Gives upserts without a key the name ``wal_seed_N``, N counting the upserts before them.

    Logs without keyless upserts pay one scan for it. Else upserts are counted over ranges of ``seq``.
    """
    op = F.upper("op") == f"UPSERT_{what}"
    valid = log.where(op & F.col("payload").isNotNull())
    if valid.where("key is null").isEmpty():
        return log
    marked = valid.select("seq", F.col("key").isNull().alias("keyless"))
    numbered = running_sums(marked, "seq", F.lit(1).cast("bigint"), "upto").where("keyless")
    named = numbered.select(F.col("seq").alias("_seq"), F.concat(F.lit(f"wal_{what.lower()}_"), F.col("upto") - 1).alias("_key"))
    return log.join(named, log["seq"] == named["_seq"], "left").withColumn("key", F.coalesce("key", "_key")).drop("_seq", "_key")


def replay_stats(log: DataFrame) -> DataFrame:
    """Entries by what they did: applied upserts and deletes of both kinds, and those ignored."""
    op = F.upper("op")
    kinds = {f"{a}_{b}_count": (op == f"{a}_{b}".upper()) & (F.col("payload").isNotNull() if a == "upsert" else F.lit(True)) for a in ("upsert", "delete") for b in ("seed", "bridge")}
    counted = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in kinds.items()]
    total = log.agg(F.count("*").alias("wal_entry_count"), *counted)
    return total.withColumn("ignored_entry_count", F.col("wal_entry_count") - sum(F.col(n) for n in kinds))


def type_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("record_type").agg(F.count("*").alias("n"))


def last_offsets(store: DataFrame) -> DataFrame:
    """The offset of the last record of every id."""
    return store.groupBy("record_type", "id").agg(F.max("offset").alias("last_offset"))


REQUIRED = {
    "SEED": "seed_id seed_type",
    "BRIDGE": "bridge_id from_seed to_seed bridge_type",
    "ROUTE": "route_id",
    "RESULT": "result_id",
    "META": "meta_id",
    "INTENT": "tx_id action",
    "COMMIT": "tx_id",
    "ABORT": "tx_id",
}


def validated(records: DataFrame, kind_col: str = "record_type") -> DataFrame:
    """``error``: the first required key that is missing or blank, ``unknown type``, or null."""
    error = F.lit("unknown type")
    for kind, keys in REQUIRED.items():
        missing = F.coalesce(*[F.when(F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) == "", k) if k in records.columns else F.lit(k) for k in keys.split()])
        error = F.when(F.upper(F.trim(F.col(kind_col))) == kind, missing).otherwise(error)
    return records.withColumn("error", error)


def keep_newest(history: DataFrame, n: int, order: str = "ts", tie: str = "id") -> DataFrame:
    """The newest n rows, by a distributed top-n."""
    return history.orderBy(F.desc(order), F.desc(tie)).limit(max(1, n))


def latency(rows: DataFrame, column: str) -> DataFrame:
    """p50 (median), p95 (the element at ``int(0.95 n) - 1`` of the sorted values), min and max.

    The p95 element is found by rank: values are counted first, so only distinct values are ordered.
    """
    values = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    ranked = running_sums(values, "x", F.col("c"), "upto")
    n = rows.agg(F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("x")))
    half = F.col("n") / 2
    joined = ranked.crossJoin(F.broadcast(n))
    low, high, far = at(F.ceil(half)), at(F.floor(half) + 1), at(F.greatest(F.lit(1), F.floor(F.col("n") * 95 / 100)))
    return joined.agg(((low + high) / 2).alias("p50"), far.alias("p95"), F.first("min").alias("min"), F.first("max").alias("max"))
