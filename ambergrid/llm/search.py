"""Exact BM25 top-k by block-at-a-time pruning.

Documents lie in blocks of BLOCK consecutive rows. A block holds a forward index (for each document
its terms and their frequencies) over the terms of the query batch and, per term that occurs, its
maximum frequency and its minimum ratio of length to frequency, which bound the score that any of its
documents can get from the term. For a query, a block's bound is the sum of these; blocks are scored
from the highest bound down, through their forward index, until the bound falls below the k-th score found.

Bounds lie in columns of their own. One scan of these finds every query's LEADS most promising blocks
of all, whose scores give all tasks a common k-th score to start from; the last scan unpacks the
forward index only of blocks whose bound reaches it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .kernel import lowered_words, slices
from .store import discard, persist

K1, B = 1.2, 0.75
BLOCK = 256
#: Queries that are answered in one pass over the index; more of them take several passes.
BATCH = 20_000
#: Blocks whose bounds a worker holds at a time.
GROUP = 64
#: Blocks per query that are scored first.
LEADS = 2
DIGITS = 6
_HALF = 0.5 * 10.0**-DIGITS


class Queries(NamedTuple):
    """ids; terms (sorted hashes); term numbers and frequencies of query i at ``offset[i]:offset[i+1]``."""

    ids: np.ndarray
    terms: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    offset: np.ndarray


def _parse(ids: list[int], texts: list[str]) -> Queries:
    words = lowered_words(pa.array(texts, pa.string()))
    terms = np.unique(words.hash)
    term, tf, offset = [], [], [0]
    for i, j in zip(words.offset[:-1], words.offset[1:], strict=True):
        t, n = np.unique(np.searchsorted(terms, words.hash[i:j]), return_counts=True)
        term.append(t)
        tf.append(n)
        offset.append(offset[-1] + len(t))
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Queries(np.array(ids, np.int64), terms, flat(term, np.int32), flat(tf, np.float64), np.array(offset))


_BLOCK = "block bigint, ids binary, length binary, count binary, term binary, tf binary, of binary, df binary, most binary, ratio binary"
_KINDS = {"ids": np.int64, "length": np.int32, "count": np.int32, "term": np.int32, "tf": np.int32, "of": np.int32, "df": np.int32, "most": np.int32, "ratio": np.float64}


def pack_block(number: int, columns: dict[str, np.ndarray]) -> dict:
    """A row of the index from ids, length, count, term and tf; adds what bounds need, per term in ``of``."""
    length = np.repeat(columns["length"], columns["count"])
    of, where = np.unique(columns["term"], return_inverse=True)
    most, ratio = np.zeros(len(of), np.int32), np.full(len(of), np.inf)
    np.maximum.at(most, where, columns["tf"])
    np.minimum.at(ratio, where, length / columns["tf"])
    full = columns | {"of": of, "df": np.bincount(where, minlength=len(of)), "most": most, "ratio": ratio}
    return {"block": number} | {c: full[c].astype(kind).tobytes() for c, kind in _KINDS.items()}


def _build(docs: DataFrame, shared) -> DataFrame:
    """A row per block: its documents, their lengths in words, the forward index over query terms, and its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        terms = shared.value.terms
        kept: dict[str, list] = {c: [] for c in ("ids", "length", "count", "term", "tf")}
        n, number = 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal n, number
            row = pack_block(number, {c: np.concatenate(x) for c, x in kept.items()})
            n, number = 0, number + 1
            for x in kept.values():
                x.clear()
            return pa.RecordBatch.from_pylist([row])

        for b in batches:
            for part in slices(b, "text"):
                words = lowered_words(part.column("text"))
                at = np.minimum(np.searchsorted(terms, words.hash), max(len(terms) - 1, 0))
                asked = terms[at] == words.hash if len(terms) else np.zeros(len(at), bool)
                doc = np.repeat(np.arange(part.num_rows), np.diff(words.offset))[asked]
                key, times = np.unique(doc * (len(terms) + 1) + at[asked], return_counts=True)
                owner, term = key // (len(terms) + 1), key % (len(terms) + 1)
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                names = part.column("id").to_numpy(zero_copy_only=False)
                row = 0
                while row < part.num_rows:
                    stop = min(part.num_rows, row + BLOCK - n)
                    i, j = bounds[row], bounds[stop]
                    for c, x in (("ids", names[row:stop]), ("length", np.diff(words.offset[row : stop + 1])), ("count", np.diff(bounds[row : stop + 1])), ("term", term[i:j]), ("tf", times[i:j])):
                        kept[c].append(x)
                    n, row = n + stop - row, stop
                    if n == BLOCK:
                        yield block()
        if n:
            yield block()

    return docs.mapInArrow(run, _BLOCK)


class Statistics(NamedTuple):
    """Documents, their mean length, and the inverse document frequency of every term."""

    n_docs: int
    mean: float
    idf: np.ndarray

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))

    def bounds(self, of: np.ndarray, most: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """No document's weight is higher: tf / (tf + x + y * length) falls with x / tf and with length / tf."""
        return self.idf[of] * (K1 + 1) / (1 + K1 * (1 - B) / most + K1 * B / self.mean * ratio)


def _arrays(batch: pa.RecordBatch, row: int, *columns: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(c)[row].as_buffer(), _KINDS[c]) for c in columns]


class Searcher:
    """The k best documents of each query among the blocks that it is shown; ``unpacked`` counts blocks."""

    def __init__(self, q: Queries, stats: Statistics, k: int, floor: np.ndarray):
        self.q, self.stats, self.k, self.floor, self.unpacked = q, stats, k, floor, 0
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in q.ids]  # of (score, -id): a root is the one to beat
        self.most, self.dense = np.zeros(len(q.terms)), np.zeros(len(q.terms))
        self.some = np.flatnonzero(np.diff(q.offset))

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row per block, a column per query that has terms."""
        out = np.zeros((batch.num_rows, len(self.some)))
        for i in range(batch.num_rows if len(self.some) else 0):
            of, most, ratio = _arrays(batch, i, "of", "most", "ratio")
            self.most[of] = self.stats.bounds(of, most, ratio)
            out[i] = np.add.reduceat(self.most[self.q.term] * self.q.tf, self.q.offset[self.some])
            self.most[of] = 0
        return out

    def least(self, query: int) -> float:
        best = self.heaps[query]
        return max(self.floor[query], best[0][0] if len(best) == self.k else 0.0)

    def search(self, batch: pa.RecordBatch, bound: np.ndarray) -> None:
        """Score blocks for every query from its highest bound down; each is unpacked when it is first needed."""
        open_: dict[int, tuple] = {}
        top = bound.max(0, initial=0)
        for column, query in enumerate(self.some.tolist()):
            if top[column] <= 0 or top[column] + _HALF < self.least(query):
                continue
            i, j = self.q.offset[query : query + 2]
            self.dense[self.q.term[i:j]] = self.q.tf[i:j]
            for at in np.argsort(-bound[:, column], kind="stable").tolist():
                if bound[at, column] <= 0 or bound[at, column] + _HALF < self.least(query):
                    break
                if at not in open_:
                    open_[at] = self._unpack(batch, at)
                self._score(query, *open_[at])
            self.dense[self.q.term[i:j]] = 0

    def _unpack(self, batch: pa.RecordBatch, at: int) -> tuple:
        self.unpacked += 1
        ids, length, count, term, tf = _arrays(batch, at, "ids", "length", "count", "term", "tf")
        filled = np.flatnonzero(count)
        return ids[filled], (np.cumsum(count) - count)[filled], term, self.stats.weights(term, tf, np.repeat(length, count))

    def _score(self, query: int, ids: np.ndarray, start: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        if not len(ids):
            return
        total = np.round(np.add.reduceat(weight * self.dense[term], start), DIGITS)
        best, good = self.heaps[query], (total > 0) & (total >= self.least(query))
        for s, d in zip(total[good].tolist(), ids[good].tolist(), strict=True):
            if len(best) < self.k:
                heapq.heappush(best, (s, -d))
            elif (s, -d) > best[0]:
                heapq.heapreplace(best, (s, -d))

    def found(self) -> pa.RecordBatch:
        out = [(int(x), -d, s) for x, best in zip(self.q.ids, self.heaps, strict=True) for s, d in best]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])


def _statistics(index: DataFrame, n_terms: int) -> Statistics:
    """From all blocks; only their lengths and document frequencies are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found, docs, words = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            for i in range(b.num_rows):
                length, of, df = _arrays(b, i, "length", "of", "df")
                docs, words = docs + len(length), words + int(length.sum(dtype=np.int64))
                found[of] += df
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([docs, words, *found[at].tolist()], pa.int64())], names=["term", "n"])

    rows = index.select("length", "of", "df").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = {r["term"]: r["n"] for r in rows}
    df = np.zeros(n_terms)
    for t, n in total.items():
        if t >= 0:
            df[t] = n
    n_docs = total.get(-2, 0)
    return Statistics(n_docs, (total.get(-1, 0) / n_docs if n_docs else 0.0) or 1.0, np.log(1 + (n_docs - df + 0.5) / (df + 0.5)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, GROUP):
            yield b.slice(at, GROUP)


def _leads(index: DataFrame, shared, stats, k: int) -> set[int]:
    """The blocks with every query's LEADS highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        s = Searcher(shared.value, stats.value, k, np.zeros(len(shared.value.ids)))
        top = np.zeros((LEADS, len(s.some)))
        block = np.full((LEADS, len(s.some)), -1, np.int64)
        for b in _groups(batches):
            bound, number = np.concatenate([top, s.bounds(b)]), np.concatenate([block, np.repeat(b.column("block").to_numpy()[:, None], len(s.some), 1)])
            order = np.argsort(-bound, axis=0, kind="stable")[:LEADS]
            top, block = np.take_along_axis(bound, order, 0), np.take_along_axis(number, order, 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(s.some, LEADS)), pa.array(top.ravel()), pa.array(block.ravel())], names=["q", "bound", "block"])

    rows = index.select("block", "of", "most", "ratio").mapInArrow(run, "q bigint, bound double, block bigint").where("block >= 0 and bound > 0")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("bound")).alias("s"), "block"))), 1, LEADS)  # of LEADS rows per task
    return {r["block"] for r in rows.groupBy("q").agg(best.alias("b")).select(F.explode("b.block").alias("block")).distinct().collect()}


def _wave(index: DataFrame, shared, stats, floor, k: int) -> DataFrame:
    """Each partition's top k of every query. floor: for each query a k-th score that is known to be reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        s = Searcher(shared.value, stats.value, k, floor.value)
        for b in _groups(batches):
            s.search(b, s.bounds(b))
        yield s.found()

    return index.mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query, by an aggregate that keeps sorted lists short on the map side too."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("d")))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best"))


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", partitions: int | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``doc_id``, ``score``: the k documents with the highest BM25 of every query.

    Ids are whole numbers. At most BATCH queries, with their terms, are broadcast at a time; a task holds
    GROUP bounds of each. Exact: scores are rounded to DIGITS digits, and equal ones ranked by ascending id. A query's
    repeated words count as often as they occur. Only documents with a word of the query appear, so a
    query may have fewer than k rows, and null, empty or wordless queries none. Null and empty
    documents count for the number of documents and their mean length. Rows with a null id are left
    out, on both sides; queries that share an id are answered as one text, in the order of the texts;
    a document id that occurs twice is two documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("id"), F.coalesce(F.col(query_text), F.lit("")).alias("text"))
    asked = asked.groupBy("id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text"))
    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_batches = -(-asked.count() // BATCH)
    out = None
    for batch in range(n_batches):  # one, unless there are very many queries: bounds what is broadcast
        rows = asked.where(F.pmod(F.hash("id"), F.lit(n_batches)) == batch).orderBy("id").collect()
        q = _parse([r["id"] for r in rows], [r["text"] for r in rows])
        shared = spark.sparkContext.broadcast(q)
        index = persist(_build(whole, shared), "blocks")
        stats = spark.sparkContext.broadcast(_statistics(index, len(q.terms)))
        floor = np.zeros(len(q.ids))
        none, leads = spark.sparkContext.broadcast(floor.copy()), _leads(index, shared, stats, k)
        at = {int(x): i for i, x in enumerate(q.ids)}
        chosen = F.broadcast(spark.createDataFrame([(x,) for x in leads], "block bigint"))  # LEADS x BATCH rows at most
        for r in _merge(_wave(index.join(chosen, "block", "left_semi"), shared, stats, none, k), k).where(F.size("best") == k).select("query_id", F.element_at("best", -1)["s"].alias("s")).collect():
            floor[at[r["query_id"]]] = -r["s"]
        best = persist(_merge(_wave(index, shared, stats, spark.sparkContext.broadcast(floor), k), k), "top")
        discard(index)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, doc_id bigint, score double")
    return out.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.d").alias("doc_id"), (-F.col("b.s")).alias("score"))


ORACLE_SQL = f"""
with docs as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as words from documents),
stats as (select count(*) as n, avg(len(words)) as mean from docs),
terms as (select item_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as term from benchmark) group by all),
vocabulary as (select distinct term from terms),
postings as (select doc_id, length, term, count(*) as tf from (select doc_id, len(words) as length, unnest(words) as term from docs) semi join vocabulary using (term) group by all),
weights as (
  select doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * length / mean)) as w
  from postings join (select term, count(*) as df from postings group by term) using (term), stats),
scored as (select item_id, doc_id, round(sum(w * qtf), {DIGITS}) as score from terms join weights using (term) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id as query_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
