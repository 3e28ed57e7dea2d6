"""Near-duplicates by MinHash: one permutation, optimal densification, bands, star edges.

One hash per shingle fills one of SLOTS bins with its minimum; empty bins copy the bin that a
universal hash of (bin, attempt) picks, the same for every document (optimal densification), so
that two documents agree in a bin with a probability of their Jaccard similarity. BANDS groups of
ROWS bins are hashed to buckets. In a bucket every member is paired with the smallest first: n
members give n - 1 pairs.

Every pair is judged by one rule, whatever the texts' lengths: a text's sketch is its LOWEST smallest
shingle hashes, and a pair is an edge if the Jaccard similarity over the range of hashes that both
sketches cover reaches THRESHOLD. A text of fewer shingles is covered whole, so that two such texts
are compared exactly. Where a bucket's members don't all match their centre, each is compared with all
others that no match has reached yet, so a bucket joins whom all its pairs would join; for members
that match nobody this takes all their pairs, PART by PART members to a task.

The nodes are distinct sketches, not rows: copies collapse in an aggregate before anything else.
Groups are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import Words, lowered_words, mix, slices
from .store import discard, persist

SHINGLE = 3
SLOTS, BANDS, ROWS = 128, 42, 3
LOWEST = 128
THRESHOLD = 0.5
#: Members of a bucket, about, that a task compares with those of one other part.
PART = 2_048
EMPTY = np.uint32(0xFFFFFFFF)
_COEFFICIENTS = mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and the text each belongs to; a shorter text is one shingle."""
    size = np.diff(words.offset)
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    doc = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    at = words.offset[:-1][doc] + np.arange(len(doc)) - first[doc]
    out = np.zeros(len(doc), np.uint64)
    stop = words.offset[1:][doc]
    for k in range(n):
        there = at + k < stop
        out += np.where(there, words.hash[np.minimum(at + k, max(len(words.hash) - 1, 0))] * _COEFFICIENTS[k], np.uint64(0)) if len(words.hash) else np.uint64(0)
    return mix(out), doc


def _donors() -> np.ndarray:
    """For each bin the order in which it asks others, as far as ever needed in practice."""
    attempt = np.arange(1, 16 * SLOTS, dtype=np.uint64)
    grid = mix(np.arange(SLOTS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + attempt[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
    return (grid % np.uint64(SLOTS)).astype(np.int32)


_DONORS = _donors()


def signatures(words: Words) -> np.ndarray:
    """A row of SLOTS values per text; all EMPTY for texts without words."""
    h, doc = shingles(words)
    n = len(words.offset) - 1
    sig = np.full(n * SLOTS, EMPTY, np.uint32)
    np.minimum.at(sig, doc * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    sig = sig.reshape(n, SLOTS)
    row, bin_ = np.nonzero((sig == EMPTY) & (np.diff(words.offset) > 0)[:, None])
    filled = sig.copy()
    attempt = 0
    while len(row):
        if attempt < _DONORS.shape[1]:
            value = sig[row, _DONORS[bin_, attempt]]
        else:  # never seen; keeps the loop finite
            value = sig.min(1)[row]
        done = value != EMPTY
        filled[row[done], bin_[done]] = value[done]
        row, bin_, attempt = row[~done], bin_[~done], attempt + 1
    return filled


def bands(sig: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket numbers per signature."""
    out = np.empty((len(sig), BANDS), np.int64)
    wide = sig.astype(np.uint64)
    for band in range(BANDS):
        h = np.full(len(sig), (band + 1) * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
        for r in range(ROWS):
            h = mix(h ^ wide[:, band * ROWS + r])
        out[:, band] = h.view(np.int64)
    return out


def sketches(words: Words) -> np.ndarray:
    """A row per text: its LOWEST smallest distinct shingle hashes, ascending, then EMPTY."""
    h, doc = shingles(words)
    key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | np.minimum(h >> np.uint64(32), np.uint64(EMPTY - 1)))
    owner = (key >> np.uint64(32)).astype(np.int64)
    place = np.arange(len(key)) - np.searchsorted(owner, owner)
    out = np.full((len(words.offset) - 1, LOWEST), EMPTY, np.uint32)
    low = place < LOWEST
    out[owner[low], place[low]] = key[low].astype(np.uint32)
    return out


def pack(rows: np.ndarray) -> list[bytes]:
    """Sketches without their ends of EMPTY."""
    return [r[:n].tobytes() for r, n in zip(rows, (rows != EMPTY).sum(1).tolist(), strict=True)]


def unpack(packed: list[bytes]) -> np.ndarray:
    size = np.array([len(x) // 4 for x in packed], np.int64)
    out = np.full((len(packed), LOWEST), EMPTY, np.uint32)
    row = np.repeat(np.arange(len(packed)), size)
    out[row, np.arange(len(row)) - (np.cumsum(size) - size)[row]] = np.frombuffer(b"".join(packed), np.uint32)
    return out


def covered(rows: np.ndarray) -> np.ndarray:
    """Up to which hash each sketch holds all: its last one where it is full, else everything."""
    return np.minimum(rows[:, -1], EMPTY - np.uint32(1))


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches, row by row, reach THRESHOLD."""
    upto = np.minimum(covered(a), covered(b))[:, None]
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] <= upto)).sum(1)
    return common >= THRESHOLD * ((a <= upto).sum(1) + (b <= upto).sum(1) - common)


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``key`` (of the sketch), ``low`` (sketch) and ``bands`` of every row with an id; all but the id null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        odd = np.arange(LOWEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            for part in slices(b, "text"):
                words = lowered_words(part.column("text"))
                none = np.diff(words.offset) == 0
                low = sketches(words)
                key = mix(mix(low.astype(np.uint64) * odd).sum(1, dtype=np.uint64)).view(np.int64)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * BANDS), pa.array(bands(signatures(words)).ravel()), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(key, mask=none), pa.array(pack(low), pa.binary(), mask=none), buckets], names=["id", "key", "low", "bands"])

    picked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, key bigint, low binary, bands array<bigint>")


def _matching(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``same``: whether a and b are alike."""

    @F.pandas_udf("boolean")
    def same(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(alike(unpack(left.tolist()), unpack(right.tolist())), dtype=bool)

    a, b = (reps.select(F.col("key").alias(x), F.col("low").alias(f"low_{x}")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").withColumn("same", same("low_a", "low_b")).drop("low_a", "low_b")


def _linked(group: pd.DataFrame) -> pd.DataFrame:
    """Edges that join a bucket's members as all their pairs would: each is compared with all not reached yet."""
    group = group.sort_values("key").drop_duplicates("key")
    keys, rows = group["key"].to_numpy(), unpack(group["low"].tolist())
    limit = covered(rows)
    _, number = np.unique(rows, return_inverse=True)
    number = number.reshape(rows.shape).astype(np.int32)
    mark = np.zeros(int(number.max()) + 1, bool)
    left, frontier, out = np.arange(1, len(keys)), [0], []
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
            continue
        at = frontier.pop()
        upto = np.minimum(limit[at], limit[left])
        mark[number[at]] = True
        within = rows[left] <= upto[:, None]
        common = (mark[number[left]] & within).sum(1)
        mark[number[at]] = False
        hit = common >= THRESHOLD * (np.searchsorted(rows[at], upto, side="right") + within.sum(1) - common)
        if hit.any():
            frontier += left[hit].tolist()
            out += [(min(keys[at], x), max(keys[at], x)) for x in keys[left[hit]]]
            left = left[~hit]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def edges(reps: DataFrame) -> DataFrame:
    """Verified pairs (a < b) of distinct sketches (key, low, bands)."""
    buckets = reps.select(F.explode("bands").alias("bucket"), "key")
    centres = buckets.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("last")).where("a < last").drop("last")
    shared = persist(buckets.join(centres, "bucket"), "buckets")  # of two members at least
    pairs = shared.where("key > a").groupBy("a", F.col("key").alias("b")).agg(F.collect_set("bucket").alias("buckets"))
    judged = persist(_matching(pairs, reps), "judged")
    # buckets of three or more whose centre doesn't match them all may hold further edges; large ones are cut into
    # parts, of which every two meet in a task
    rest = judged.where("not same").select(F.explode("buckets").alias("bucket")).distinct()
    crowded = shared.join(rest, "bucket", "left_semi").groupBy("bucket").count().where("count > 2").select("bucket", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    several = F.transform(F.expr("filter(sequence(0, parts - 1), x -> x != part)"), lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j")))
    meets = F.when(F.col("parts") > 1, several).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    spread = shared.join(crowded, "bucket").withColumn("part", part).select("bucket", "key", F.explode(meets).alias("m")).select("bucket", "key", "m.i", "m.j")
    more = spread.join(reps.select("key", "low"), "key").groupBy("bucket", "i", "j").applyInPandas(_linked, "a bigint, b bigint")
    found = persist(judged.where("same").select("a", "b").unionByName(more).distinct(), "edges")
    for t in (shared, judged):
        discard(t)
    return found


def _contracted(found: DataFrame) -> DataFrame:
    """Each partition's edges as stars around the smallest member of what they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        stars = [(find(x), x) for x in root]
        stars = np.array([s for s in stars if s[0] != s[1]], np.int64).reshape(-1, 2)
        for at in range(0, len(stars), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(stars[at : at + (1 << 16), k]) for k in (0, 1)], names=["a", "b"])

    return found.mapInArrow(run, "a bigint, b bigint")


def components(found: DataFrame) -> DataFrame:
    """``id`` and ``root`` (smallest member of its component) of every end of an edge (a, b).

    Alternates large-star and small-star steps, each a shuffle of at most the edges, until the
    edges are stars around their smallest member; partitions contract what they hold on the way.
    A few rounds, as their number grows with the logarithm of the longest chain.
    """
    current, total = persist(_contracted(found), "stars"), None
    while True:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low, large["b"] == low["u"]).select("m", "a", "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        after = persist(_contracted(small), "stars")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(current)
        current = after
        if state == total or not state[0]:
            break
        total = state
    return current.select(F.col("b").alias("id"), F.col("a").alias("root")).union(current.select(F.col("a"), F.col("a")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``group_id`` (smallest id of the group), ``is_duplicate``: one row per distinct id.

    Ids may be of any type that has an order. Documents without near-duplicates, and those without
    words (null, empty, punctuation only), are groups of one. Rows that repeat an id are one document,
    which joins the groups of all its texts. Rows whose id is null are left out. Texts shorter than a
    shingle match when all their words do. Other columns are ignored, whatever their names.
    """
    sketch = persist(_sketch(docs, id_col, text_col), "sketch")
    keys = persist(sketch.select("id", "key"), "keys")
    worded = keys.where("key is not null")
    # copies meet here in a map-side combined aggregate, however many there are
    reps = persist(sketch.where("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("low").alias("low"), F.min("bands").alias("bands")), "reps")
    discard(sketch)
    several = worded.groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").select("id", "a")
    texts = worded.join(several, "id").where("key > a").select("a", F.col("key").alias("b"))
    matched = edges(reps.select("key", "low", "bands"))
    roots = components(matched.unionByName(texts)).select(F.col("id").alias("key"), "root")
    named = persist(reps.select("key", "first", "last").join(roots, "key", "left").where("root is not null or first < last"), "named")
    least = named.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    group = persist(named.join(least, "root", "left").select("key", F.coalesce("least", "first").alias("group")), "groups")
    for t in (reps, matched, named):
        discard(t)
    each = worded.join(group, "key", "left").select("id", "group").unionByName(keys.where("key is null").select("id", F.col("id").alias("group")))
    out = each.groupBy("id").agg(F.min(F.coalesce("group", "id")).alias("group"))
    return out.select(F.col("id").alias(id_col), F.col("group").alias("group_id"), (F.col("id") != F.col("group")).alias("is_duplicate"))


def _unlike(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column has it, in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document (the smallest id) of each group.

    Of rows that repeat an id one stays, the first by its JSON. Rows whose id is null stay, as
    nothing tells them apart. Columns may have any names and types.
    """
    dropped, twice, row = (_unlike(docs.columns, x) for x in ("dropped", "twice", "row"))
    gone = near_duplicates(docs, id_col, text_col).where("is_duplicate").select(F.col(id_col).alias(dropped))
    kept = docs.join(gone, docs[id_col] == F.col(dropped), "left_anti")
    repeats = persist(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(twice)).count().where("count > 1").select(twice), "twice")
    if repeats.isEmpty():
        return kept
    repeated = kept.join(repeats, kept[id_col] == F.col(twice), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = repeated.groupBy(F.col(id_col).alias(twice)).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return kept.join(repeats, kept[id_col] == F.col(twice), "left_anti").unionByName(first)
