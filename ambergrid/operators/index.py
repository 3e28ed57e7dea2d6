"""The record index: attributes derived from payloads, and lookups by them.

An index is a table; its lookups are filters, which Parquet statistics and partitions serve. The
posting lists of a file index are one aggregate away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..lang import find


def _filled(df: DataFrame, *names: str) -> list[Column]:
    return [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]


def attributes(records: DataFrame) -> DataFrame:
    """``record_id, source_kind, record_index, payload_type, trust_state, logical_id, relation``.

    From records with record_id, source_kind, record_index and any payload keys. Type: the type,
    else an edge's relation, else the kind, else the upper-cased source kind. Logical id: seed_id,
    bridge_id, id or key, else ``rid:`` and the record id. Trust: RAW unless given.
    """
    blank = F.lit(None).cast("string")
    relation = F.coalesce(*_filled(records, "relation"), blank)
    kind = F.coalesce(*_filled(records, "type"), F.when(F.col("source_kind") == "bbridge", relation), *_filled(records, "kind"), F.upper("source_kind"))
    name = F.coalesce(*_filled(records, *"seed_id bridge_id id key".split()), F.concat(F.lit("rid:"), F.col("record_id").cast("string")))
    trust = F.coalesce(F.col("trust_state").cast("string"), F.lit("RAW")) if "trust_state" in records.columns else F.lit("RAW")
    return records.select("record_id", "source_kind", "record_index", kind.alias("payload_type"), trust.alias("trust_state"), name.alias("logical_id"), F.coalesce(relation, F.lit("")).alias("relation"))


def lookup(index: DataFrame, attribute: str, value: str) -> DataFrame:
    column = "payload_type" if attribute == "type" else attribute
    if attribute == "relation" and not value:
        return index.limit(0)
    if attribute == "record_id":
        # numbers compare as numbers, so that the predicate reaches the scan
        number = F.lit(value).try_cast(index.schema["record_id"].dataType)
        return index.where((F.col("record_id") == number) & (number.cast("string") == value))
    return index.where(F.col(column) == value)


def find_rows(index: DataFrame, text: str) -> DataFrame | None:
    """Rows of a FIND query in index order (kind, position, id); None where the text is no FIND query."""
    parsed = find.parse(text)
    return None if parsed is None else lookup(index, *parsed).orderBy("source_kind", "record_index", "record_id")


def postings(index: DataFrame) -> DataFrame:
    """``attribute``, ``value``, ``n``: the length of every posting list, from one pass over the index."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col("payload_type" if a == "type" else a).cast("string").alias("value")) for a in find.ATTRIBUTES])
    rows = index.select(F.explode(pairs).alias("p")).select("p.*").where("not (attribute = 'relation' and value = '')")
    return rows.groupBy("attribute", "value").agg(F.count("*").alias("n"))


def posting_positions(index: DataFrame, attribute: str) -> DataFrame:
    """``value``, ``positions``: record positions per key in index order."""
    column = "payload_type" if attribute == "type" else attribute
    return index.where(F.col(column) != "").groupBy(F.col(column).cast("string").alias("value")).agg(F.sort_array(F.collect_list("record_index")).alias("positions"))


def distinct_states(records: DataFrame) -> DataFrame:
    """Sorted distinct trust states and types in one row."""
    return records.agg(F.array_sort(F.collect_set("trust_state")).alias("trust_states"), F.array_sort(F.collect_set("payload_type")).alias("types"))
