"""Inverted files: coarse centroids, probing, product-quantised residuals, distance tables, exact reranking.

Centroids and codebooks come from Lloyd rounds over all vectors, each round an aggregate of
per-partition sums. The index is a stored table of (cell, id, code), a code being one byte per space of the
residual; cells are binned to groups of about MAX_LIST codes, and larger cells split. A query's vector
goes once to every group in which it probes a cell; there tables of distances to the codebooks give
rough distances, and the best ``depth`` of a query over all groups are measured exactly against their vectors.

How many cells to probe and how many candidates to measure is measured too: SAMPLE queries are answered
by brute force over all vectors, and the smallest numbers are taken by which the whole search finds the target
share of their true neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import discard, persist

#: Vectors and queries that meet in one task, about; larger cells are split over several tasks.
MAX_LIST, MAX_QUERIES = 8_192, 32_768
SAMPLE = 256
DIGITS = 6


def vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id`` (long) and ``v`` (float32 bytes), one row per id.

    Left out: null ids, null vectors, and vectors that hold nulls, NaN or infinities or aren't of
    length ``dim``. Of rows that repeat an id the smallest vector stays.
    """
    fine = (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(fine)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            yield _batch(b.column("id"), flat.reshape(-1, dim))

    return rows.mapInArrow(run, "id bigint, v binary")


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    off = pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).data)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, off, pa.py_buffer(np.ascontiguousarray(x).data)])


def _batch(ids, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64()), _binary(x)], names=["id", "v"])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
        if len(c):
            parts.append(np.frombuffer(c.buffers()[2], np.float32, count=(off[-1] - off[0]) // 4, offset=off[0]))
    return np.concatenate(parts).reshape(-1, dim) if parts else np.zeros((0, dim), np.float32)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all pairs."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centroids: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), 4096):
        d = distances(x[i : i + 4096], centroids)
        if k == 1:
            out[i : i + 4096, 0] = d.argmin(1)
        else:
            near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            out[i : i + 4096] = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
    return out


def lloyd(vecs: DataFrame, start: np.ndarray, rounds: int, dim: int, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Centroids, of shape (spaces, centroids, width), after some rounds over all vectors.

    The spaces cut a vector into equal pieces, each clustered by itself. prepare: applied first.
    Centroids without members stay where they were.
    """
    spaces, size, width = start.shape
    centroids = start
    for _ in range(rounds):
        current = centroids

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterable[pa.RecordBatch]:
            total, n = np.zeros((spaces * size, width)), np.zeros(spaces * size, np.int64)
            for b in batches:
                x = matrix(b.column("v"), dim)
                x = prepare(x) if prepare else x
                for s in range(spaces):
                    part = np.ascontiguousarray(x[:, s * width : (s + 1) * width])
                    at = nearest(part, current[s])[:, 0] + s * size
                    n += np.bincount(at, minlength=len(n))
                    for d in range(width):
                        total[:, d] += np.bincount(at, part[:, d], len(n))
            used = np.flatnonzero(n)
            sums = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), sums], names=["at", "n", "total"])

        sums = vecs.select("v").mapInArrow(run, "at bigint, n bigint, total array<double>").groupBy("at")
        rows = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(width)]).alias("total")).toPandas()
        flat = current.reshape(-1, width).copy()
        if len(rows):
            flat[rows["at"].to_numpy()] = np.stack(rows["total"].to_numpy()) / rows["n"].to_numpy()[:, None]
        centroids = flat.reshape(current.shape).astype(np.float32)
    return centroids


def sample(vecs: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the n rows with the lowest hash."""
    t = vecs.orderBy(F.xxhash64("id"), "id").limit(n).toArrow()
    return t["id"].to_numpy(), matrix(t["v"], dim)


def coarse(vecs: DataFrame, cells: int, dim: int, rounds: int = 5) -> np.ndarray:
    _, start = sample(vecs, cells, dim)
    return lloyd(vecs, start[None], rounds, dim)[0]


def _top(found: DataFrame, k: int) -> DataFrame:
    """Merges rows (query, near: array of (d, id)) to the k nearest of each query."""
    return found.groupBy("query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _emit(query: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest per row by distance, then id; infinite distances are left out."""
    if d.shape[1] > k:
        # ties at the k-th place go to the lowest ids: columns come in ascending order of ids
        cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        close = d <= cut
        over = close.sum(1) > k
        rank = np.where(close, d, np.inf)
        order = np.argpartition(rank, k - 1, axis=1)[:, :k]
        if over.any():
            order[over] = np.argsort(rank[over], axis=1, kind="stable")[:, :k]
        d, ids = np.take_along_axis(d, order, 1), np.take_along_axis(np.broadcast_to(ids, rank.shape), order, 1)
    else:
        ids = np.broadcast_to(ids, d.shape)
    some = np.isfinite(d)
    offset = np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(d[some].astype(np.float64)), pa.array(ids[some].astype(np.int64))], names=["d", "id"])
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.ListArray.from_arrays(pa.array(offset), pairs)], names=["query", "near"])


_NEAR = "query bigint, near array<struct<d:double,id:bigint>>"


def probes_needed(vecs: DataFrame, centroids: np.ndarray, k: int, dim: int, target: float) -> int:
    """The number of nearest cells that holds ``target`` of the true k neighbours of SAMPLE queries."""
    ids, x = sample(vecs, SAMPLE, dim)
    if len(ids) < 2:
        return 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        place = np.empty((len(x), len(centroids)), np.int64)
        np.put_along_axis(place, distances(x, centroids).argsort(1, kind="stable"), np.arange(len(centroids))[None, :], 1)
        for b in batches:
            y, names = matrix(b.column("v"), dim), b.column("id").to_numpy(zero_copy_only=False)
            cell = nearest(y, centroids)[:, 0]
            for i in range(0, len(y), 8192):
                d = distances(x, y[i : i + 8192])
                d[names[None, i : i + 8192] == ids[:, None]] = np.inf
                yield _emit(ids, d, place[:, cell[i : i + 8192]], k)

    rows = _top(vecs.mapInArrow(run, _NEAR), k).select(F.explode("near.id").alias("place")).toPandas()
    return int(np.quantile(rows["place"], target, method="higher")) + 1 if len(rows) else 1


def neighbours(vecs: DataFrame, centroids: np.ndarray, probes: int, k: int, dim: int) -> DataFrame:
    """``query`` and ``near`` of every vector: its k nearest others in the probed cells as (d, id), by squared distance, then id.

    Without codes, for narrow vectors: distances are exact.

    Vectors meet the queries that probe their cell in one task per (cell, part of the cell, part of
    the queries), so neither a hot cell nor a popular one has to fit into a single task.
    """
    cells = len(centroids)
    probes = min(probes, cells)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n = np.zeros((2, cells), np.int64)
        for b in batches:
            near = nearest(matrix(b.column("v"), dim), centroids, probes)
            n[0] += np.bincount(near[:, 0], minlength=cells)
            n[1] += np.bincount(near.ravel(), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(n[0]), pa.array(n[1])], names=["cell", "listed", "asked"])

    rows = vecs.mapInArrow(tally, "cell bigint, listed bigint, asked bigint").groupBy("cell").agg(F.sum("listed").alias("listed"), F.sum("asked").alias("asked")).toPandas()
    parts = np.ones((2, cells), np.int64)
    for k_, (column, most) in enumerate((("listed", MAX_LIST), ("asked", MAX_QUERIES))):
        parts[k_, rows["cell"]] = np.maximum(-(-rows[column].to_numpy() // most), 1)

    def spread(as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    x, ids = matrix(part.column("v"), dim), part.column("id").to_numpy(zero_copy_only=False)
                    near = nearest(x, centroids, probes if as_query else 1)
                    row, cell = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel().astype(np.int64)
                    own, other = (parts[1], parts[0]) if as_query else (parts[0], parts[1])
                    mine = ids[row] % own[cell]
                    times = other[cell]
                    row, cell, mine = np.repeat(row, times), np.repeat(cell, times), np.repeat(mine, times)
                    theirs = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    a, c = (theirs, mine) if as_query else (mine, theirs)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(a), pa.array(c), pa.array(ids[row], pa.int64()), _binary(x[row])], names=["cell", "list_part", "query_part", "id", "v"])

        return vecs.mapInArrow(run, "cell bigint, list_part bigint, query_part bigint, id bigint, v binary")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_emit(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1), np.int64), k)]
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            ids, x = left["id"].to_numpy(), matrix(left["v"], dim)
            asked, y = right["id"].to_numpy(), matrix(right["v"], dim)
            step = max(1, (1 << 21) // max(len(x), 512))
            for i in range(0, len(y), step):
                own = asked[i : i + step, None] == ids[None, :]
                d = distances(y[i : i + step], x)
                d[own] = np.inf
                out.append(_emit(asked[i : i + step], np.round(d.astype(np.float64), DIGITS), ids[None, :], k))
        return pa.Table.from_batches(out)

    keys = ("cell", "list_part", "query_part")
    found = spread(False).groupBy(*keys).cogroup(spread(True).groupBy(*keys)).applyInArrow(meet, _NEAR)
    return _top(found, k)


class Codec(NamedTuple):
    """Centroids, and the codebook of each space: (spaces, codes, width)."""

    centroids: np.ndarray
    books: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and the codes of its residual."""
        cell = nearest(x, self.centroids)[:, 0].astype(np.int64)
        rest, width = x - self.centroids[cell], self.books.shape[2]
        return cell, np.stack([nearest(np.ascontiguousarray(rest[:, s * width : (s + 1) * width]), book)[:, 0] for s, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def rough(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries from coded vectors of a cell, by tables of distances to the codebooks."""
        rest, width = queries - self.centroids[cell], self.books.shape[2]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            out += distances(np.ascontiguousarray(rest[:, s * width : (s + 1) * width]), book)[:, codes[:, s]]
        return out


def train_codec(vecs: DataFrame, n: int, dim: int, spaces: int) -> Codec:
    centroids = coarse(vecs, max(1, min(n, round(math.sqrt(n) / 2))), dim)

    def residual(x: np.ndarray) -> np.ndarray:
        return x - centroids[nearest(x, centroids)[:, 0]]

    start, width = residual(sample(vecs, min(256, n), dim)[1]), dim // spaces
    return Codec(centroids, lloyd(vecs, np.stack([start[:, s * width : (s + 1) * width] for s in range(spaces)]), 4, dim, residual))


def encode(vecs: DataFrame, codec: Codec, dim: int) -> DataFrame:
    """The index: ``cell``, ``id`` and ``code`` of every vector."""
    shared = vecs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            cell, codes = shared.value.encode(matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("id"), _binary(codes)], names=["cell", "id", "code"])

    return vecs.mapInArrow(run, "cell bigint, id bigint, code binary")


def _codes(column: pa.Array | pa.ChunkedArray, spaces: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, spaces)


def _probed(codec: Codec, queries: np.ndarray, probes: int) -> np.ndarray:
    """Which cells (columns) each query probes."""
    out = np.zeros((len(queries), len(codec.centroids)), bool)
    np.put_along_axis(out, nearest(queries, codec.centroids, probes), True, 1)
    return out


def _rough_all(codec: Codec, queries: np.ndarray, probed: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rough distances of all queries from coded vectors, infinite in cells that they don't probe."""
    out = np.full((len(queries), len(cell)), np.inf, np.float32)
    order = np.argsort(cell, kind="stable")
    used, first = np.unique(cell[order], return_index=True)
    for c, at in zip(used.tolist(), np.split(order, first[1:]), strict=True):
        asks = np.flatnonzero(probed[:, c])
        if len(asks):
            out[np.ix_(asks, at)] = codec.rough(queries[asks], c, codes[at])
    return out


def calibrate(vecs: DataFrame, index: DataFrame, codec: Codec, k: int, dim: int, target: float) -> tuple[int, int]:
    """Cells to probe and candidates to measure by which SAMPLE queries find ``target`` of their true neighbours.

    Probing is allowed half of the loss.
    """
    cells, spaces = len(codec.centroids), len(codec.books)
    ids, x = sample(vecs, SAMPLE, dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            y, names = matrix(b.column("v"), dim), b.column("id").to_numpy(zero_copy_only=False)
            for i in range(0, len(y), 8192):
                part = np.argsort(names[i : i + 8192], kind="stable") + i
                d = distances(x, y[part])
                d[names[None, part] == ids[:, None]] = np.inf
                yield _emit(ids, d, names[None, part], k)

    rows = _top(vecs.mapInArrow(exact, _NEAR), k).select("query", F.explode("near.id").alias("id")).collect()
    coded = {r["id"]: (r["cell"], np.frombuffer(r["code"], np.uint8)) for r in index.where(F.col("id").isin(sorted({r["id"] for r in rows}))).collect()}
    row = {i: n for n, i in enumerate(ids.tolist())}
    place = np.empty((len(x), cells), np.int64)
    np.put_along_axis(place, nearest(x, codec.centroids, cells), np.arange(cells)[None, :], 1)
    true = [(row[r["query"]], *coded[r["id"]]) for r in rows]
    probes = int(np.quantile([place[q, c] for q, c, _ in true], (1 + target) / 2, method="higher")) + 1
    probed = _probed(codec, x, probes)
    reached = [(q, float(codec.rough(x[q : q + 1], c, code[None])[0, 0])) for q, c, code in true if probed[q, c]]
    which, limit = np.array([q for q, _ in reached]), np.array([d for _, d in reached], np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        closer = np.zeros(len(limit), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                d = _rough_all(codec, x, probed, part.column("cell").to_numpy(), _codes(part.column("code"), spaces))
                for q in np.unique(which):
                    mine = np.flatnonzero(which == q)
                    closer[mine] += np.searchsorted(np.sort(d[q]), limit[mine])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(closer))), pa.array(closer)], names=["at", "n"])

    ranks = sorted(r["n"] for r in index.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect())
    wanted = min(len(ranks), math.ceil(target * len(true)))
    return probes, max(2 * k, ranks[wanted - 1] + 1 + k)


def search(vecs: DataFrame, index: DataFrame, queries: DataFrame, codec: Codec, probes: int, depth: int, k: int, dim: int) -> DataFrame:
    """``query`` and ``near``: the k nearest others as (d, id) of each query (id, v), by squared distance, then id."""
    cells, spaces = len(codec.centroids), len(codec.books)
    n = np.zeros(cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # a row per cell, as many as there are centroids
        n[r["cell"]] = r["count"]
    # neighbouring cells share groups, so that a query goes to few of them
    centred = codec.centroids - codec.centroids.mean(0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable") if cells > 1 else np.zeros(1, np.int64)
    parts = np.maximum(-(-n // MAX_LIST), 1)
    first, at, held = np.zeros(cells, np.int64), 0, 0
    for c in order.tolist():
        if held and held + n[c] > MAX_LIST:
            at, held = at + 1, 0
        first[c], held = at, held + n[c]
        if parts[c] > 1:
            at, held = at + int(parts[c]), 0
    shared = vecs.sparkSession.sparkContext.broadcast((codec, first, parts))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        _, first, parts = shared.value
        for b in batches:
            cell, ids = b.column("cell").to_numpy(), b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + ids % parts[cell]), *b.columns], names=["group", "cell", "id", "code"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        codec, first, parts = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x, ids = matrix(part.column("v"), dim), part.column("id").to_numpy()
                near = nearest(x, codec.centroids, probes)
                row, cell = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
                times = parts[cell]
                group = np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, group = np.unique(np.stack([np.repeat(row, times), group]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(ids[row]), _binary(x[row])], names=["group", "id", "v"])

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_emit(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1), np.int64), depth)]
        if left.num_rows and right.num_rows:
            codec = shared.value[0]
            left = left.sort_by("id")
            ids, cell, codes = left["id"].to_numpy(), left["cell"].to_numpy(), _codes(left["code"], spaces)
            names, y = right["id"].to_numpy(), matrix(right["v"], dim)
            step = max(1, (1 << 21) // len(ids))
            for i in range(0, len(y), step):
                d = _rough_all(codec, y[i : i + step], _probed(codec, y[i : i + step], probes), cell, codes)
                d[names[i : i + step, None] == ids[None, :]] = np.inf
                out.append(_emit(names[i : i + step], d, ids[None, :], depth))
        return pa.Table.from_batches(out)

    lists = index.select("cell", "id", "code").mapInArrow(listed, "group bigint, cell bigint, id bigint, code binary").groupBy("group")
    found = lists.cogroup(queries.mapInArrow(asked, "group bigint, id bigint, v binary").groupBy("group")).applyInArrow(meet, _NEAR)
    best = persist(_top(found, depth), "candidates").select("query", F.explode("near.id").alias("id"))
    pairs = best.join(vecs.withColumnRenamed("v", "theirs"), "id").join(queries.select(F.col("id").alias("query"), F.col("v").alias("mine")), "query")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            d = np.square(matrix(b.column("mine"), dim).astype(np.float64) - matrix(b.column("theirs"), dim)).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("query"), pa.array(np.round(d, DIGITS)), b.column("id")], names=["query", "d", "id"])

    exact = pairs.select("query", "id", "mine", "theirs").mapInArrow(measure, "query bigint, d double, id bigint")
    return exact.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k).alias("near"))


def approximate_neighbours(df: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, spaces: int = 16, target: float = 0.95, every: int = 1) -> DataFrame:
    """``id_col``, ``rank`` (from 1), ``neighbour_id``, ``distance``: about the k nearest others of the vectors whose id is a multiple of ``every``.

    All vectors are searched. Distances are Euclidean, exact and rounded; ties go to the lower id. With
    fewer than k others there are fewer rows, with none (a single vector, an empty table) none. Ids are
    whole numbers. For rows that are left out see ``vectors``; other columns are ignored. Of copies
    the lowest ids come first; a vector of which there are more copies than candidates may hide others
    that are as near.
    """
    vecs = persist(vectors(df, id_col, vec_col, dim), "vectors")
    n = vecs.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], f"`{id_col}` bigint, rank int, neighbour_id bigint, distance double")
    codec = train_codec(vecs, n, dim, spaces)
    index = persist(encode(vecs, codec, dim), "codes")
    probes, depth = calibrate(vecs, index, codec, k, dim, target)
    found = persist(search(vecs, index, vecs.where(F.pmod("id", F.lit(every)) == 0), codec, probes, depth, k, dim), "neighbours")
    for t in (vecs, index):
        discard(t)
    return found.select(F.col("query").alias(id_col), F.posexplode("near").alias("p", "n")).select(id_col, (F.col("p") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), F.round(F.sqrt("n.d"), DIGITS).alias("distance"))
