"""Related documents packed into windows (after Shi et al., 2024).

A document's vector is a random projection of its words to DIM numbers, so that shared
vocabulary and shared passages bring documents together. Documents of equal vectors are one node,
which gets its K nearest neighbours from an inverted file; edges count both ways. A path starts at
an unvisited node of lowest degree and walks to the nearest unvisited neighbour until there is none.

Paths are walked within regions of at most REGION nodes, each in one task: cells of the
inverted file are merged along the most edges between them, so that few edges join two regions;
``edges_between_regions`` tells their share. Walks see nodes only. Documents, however many share a node, are
laid out by aggregates and running sums over ranges of them, and fill their region's windows along its paths.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import ivf
from .kernel import lowered_words, mix, slices
from .store import discard, persist

WINDOW = 2048
DIM, K = 16, 8
#: Nodes per cell on average in small tables (see ``cells_for``), and per region at most (which bounds the memory of a task).
CELL, REGION = 1_000, 65_536


def cells_for(n: int) -> int:
    """Cells for n nodes: about n / CELL, and 3 * sqrt(n) for very many, so that centroids and work grow as a root of n."""
    return max(1, round(n / (CELL + math.sqrt(n) / 3)))


def embed(docs: DataFrame, id_col: str, text_col: str, size_col: str | None = None) -> DataFrame:
    """``id``, ``n`` (words, or ``size_col``), ``node`` and ``v``: the projection, scaled to length one; zero for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        odd = mix(np.arange(1, DIM + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            for part in slices(b, "text"):
                w = lowered_words(part.column("text"))
                n = np.diff(w.offset)
                doc = np.repeat(np.arange(len(n)), n)
                v = np.empty((len(n), DIM), np.float32)
                for d in range(DIM):
                    sign = ((w.hash >> np.uint64(d + 5)) & np.uint64(1)).astype(np.float64) * 2 - 1
                    v[:, d] = np.bincount(doc, sign, len(n))
                v = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None] + np.float32(0)
                node = mix((v.view(np.uint32).astype(np.uint64) * odd).sum(1, dtype=np.uint64)).view(np.int64)
                size = pa.array(n) if size_col is None else part.column("size")
                yield pa.RecordBatch.from_arrays([part.column("id"), size, pa.array(node), ivf._binary(v)], names=["id", "n", "node", "v"])

    size = [] if size_col is None else [F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)).alias("size")]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *size)
    # an id that repeats is one document: the longest of its texts
    each = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, node bigint, v binary")
    return each.groupBy("id").agg(F.max(F.struct("n", "node", "v")).alias("x")).select("id", "x.n", "x.node", "x.v").where("n > 0")


def graph(vecs: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Edges (a, b, d) both ways between distinct vectors (id, v) and their K nearest neighbours."""
    found = ivf.neighbours(vecs, centroids, probes, K, DIM)
    near = found.select(F.col("query").alias("a"), F.explode("near").alias("e")).select("a", F.col("e.id").alias("b"), F.col("e.d").alias("d"))
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).distinct()


def walk(degree: np.ndarray, begin: np.ndarray, to: np.ndarray, cell: np.ndarray, centroids: np.ndarray, vectors: np.ndarray) -> list[int]:
    """All nodes 0..n-1, which are in the order of their ids, in the order of greedy paths.

    to: the neighbours of node i, nearest first, at ``begin[i]:begin[i+1]``; -1 for one of another
    region. The first path starts at the lowest node of lowest degree. Of several unvisited nodes of lowest
    degree a later one starts in the cell whose centroid is nearest to that of the last path's end,
    at the node whose vector is nearest to that end; ties go to the lower number.
    """
    visited = np.zeros(len(degree), bool)
    seen = memoryview(visited)
    order = np.stack([np.square(centroids - c).sum(1).argsort(kind="stable") for c in centroids]) if len(centroids) else centroids
    begin, to, out = begin.tolist(), to.tolist(), []
    for level in np.unique(degree):
        nodes = np.flatnonzero((degree == level) & ~visited)
        nodes = nodes[np.argsort(cell[nodes], kind="stable")]
        where, first = np.unique(cell[nodes], return_index=True)
        pools = dict(zip(where.tolist(), np.split(nodes, first[1:]), strict=True)) if len(nodes) else {}
        while pools:
            at = next(c for c in order[cell[out[-1]]].tolist() if c in pools) if out else int(cell[min(p[0] for p in pools.values())])
            pool = pools[at][~visited[pools[at]]]
            if not len(pool):
                del pools[at]
                continue
            pools[at] = pool
            node = int(pool[np.square(vectors[pool] - vectors[out[-1]]).sum(1).argmin()] if out else pool[0])
            while node >= 0:
                out.append(node)
                seen[node] = True
                node = next((x for x in to[begin[node] : begin[node + 1]] if x >= 0 and not seen[x]), -1)
    return out


def merge_cells(sizes: np.ndarray, edges: np.ndarray, one: np.ndarray, two: np.ndarray, limit: int) -> np.ndarray:
    """A region for each cell: cells joined by the most edges first, while a region holds at most ``limit`` nodes.

    edges: how many join cells ``one`` and ``two``.
    """
    order = np.lexsort((two, one, -edges))
    root, held = list(range(len(sizes))), sizes.astype(np.int64).tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(one[order].tolist(), two[order].tolist(), strict=True):
        a, b = sorted((find(a), find(b)))
        if a != b and held[a] + held[b] <= limit:
            root[b], held[a] = a, held[a] + held[b]
    return np.unique([find(x) for x in range(len(sizes))], return_inverse=True)[1]


def place(nodes: DataFrame, edges: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``cell`` and ``region``; edges (region, a, b, d, inside) by the region of a.

    A cell of more than REGION nodes is split by their hash.
    """
    spark = nodes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            cell = ivf.nearest(ivf.matrix(b.column("v"), DIM), centroids)[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    celled = persist(nodes.select("id", "v", "total").mapInArrow(run, "id bigint, v binary, total bigint, cell bigint"), "cells")
    end = lambda x: celled.select(F.col("id").alias(x), F.col("cell").alias(f"cell_{x}"))
    joined = persist(edges.join(end("a"), "a").join(end("b"), "b"), "joined")
    sizes = np.zeros(len(centroids), np.int64)
    for r in celled.groupBy("cell").count().collect():  # a row per cell, as many as there are centroids
        sizes[r["cell"]] = r["count"]
    held = spark.createDataFrame(list(enumerate(sizes.tolist())), "cell bigint, held bigint")
    side = lambda x: F.broadcast(held.select(F.col("cell").alias(f"cell_{x}"), F.col("held").alias(f"held_{x}")))
    # only cells that fit into a region together
    pairs = joined.where("cell_a < cell_b").groupBy("cell_a", "cell_b").count().join(side("a"), "cell_a").join(side("b"), "cell_b").where(F.col("held_a") + F.col("held_b") <= REGION).select("count", "cell_a", "cell_b").toArrow()
    region = merge_cells(sizes, *(pairs[c].to_numpy() for c in ("count", "cell_a", "cell_b")), REGION)
    parts = np.ones(int(region.max()) + 1, np.int64)
    np.maximum.at(parts, region, -(-sizes // REGION))
    first = np.cumsum(parts) - parts
    table = spark.createDataFrame([(c, int(first[r]), int(parts[r])) for c, r in enumerate(region.tolist())], "cell bigint, first bigint, parts bigint")
    of = lambda node: F.col("first") + F.pmod(F.xxhash64(node), F.col("parts"))
    placed = persist(celled.join(F.broadcast(table), "cell").select("id", "v", "total", "cell", of("id").alias("region")), "placed")
    named = lambda x: table.select(F.col("cell").alias(f"cell_{x}"), F.col("first").alias(f"first_{x}"), F.col("parts").alias(f"parts_{x}"))
    at = lambda x: F.col(f"first_{x}") + F.pmod(F.xxhash64(x), F.col(f"parts_{x}"))
    within = joined.join(F.broadcast(named("a")), "cell_a").join(F.broadcast(named("b")), "cell_b")
    out = persist(within.select(at("a").alias("region"), "a", "b", "d", (at("a") == at("b")).alias("inside")), "placed-edges")
    for t in (celled, joined):
        discard(t)
    return placed, out


def edges_between_regions(edges: DataFrame) -> float:
    """The share of edges that no walk can use, as they join two regions."""
    return edges.agg(F.avg((~F.col("inside")).cast("double"))).first()[0] or 0.0


def ordered(placed: DataFrame, edges: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``node``, ``region`` and ``start``: how many tokens of the region's paths come before the node."""
    shared = placed.sparkSession.sparkContext.broadcast(centroids)

    def lay(key: tuple, nodes: pa.Table, near: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("id")
        ids, x = nodes["id"].to_numpy(), ivf.matrix(nodes["v"], DIM)
        a, b, d = (near[c].to_numpy() for c in ("a", "b", "d"))
        order = np.lexsort((b, d, a))
        a, b = np.searchsorted(ids, a[order]), b[order]
        degree = np.bincount(a, minlength=len(ids))
        to = np.minimum(np.searchsorted(ids, b), max(len(ids) - 1, 0))
        to = np.where(ids[to] == b, to, -1) if len(ids) else to
        used, cell = np.unique(nodes["cell"].to_numpy(), return_inverse=True)
        path = np.array(walk(degree, np.concatenate([[0], np.cumsum(degree)]), to, cell, shared.value[used], x), np.int64)
        total = nodes["total"].to_numpy()[path]
        return pa.table({"node": ids[path], "region": np.full(len(path), key[0].as_py() if key else 0, np.int64), "start": np.cumsum(total) - total})

    return placed.groupBy("region").cogroup(edges.groupBy("region")).applyInArrow(lay, "node bigint, region bigint, start bigint")


def laid_out(embedded: DataFrame, order: DataFrame) -> DataFrame:
    """``id``, ``n``, ``region`` and ``begin``: how many tokens of the region come before the document.

    Documents of a node follow each other by id. Running sums are taken within ranges of (node, id), to
    which the sums of earlier ranges are added: a node may hold any number of documents.
    """
    split = persist(embedded.select("id", "n", "node").repartitionByRange("node", "id").withColumn("p", F.spark_partition_id()), "ranges")
    totals = split.groupBy("node", "p").agg(F.sum("n").alias("sum"))
    before = totals.select("node", "p", (F.sum("sum").over(Window.partitionBy("node").orderBy("p")) - F.col("sum")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("node", "p").orderBy("id")) - F.col("n")
    rows = split.withColumn("inside", inside).join(before, ["node", "p"]).join(order, "node")
    return rows.select("id", "n", "region", (F.col("start") + F.col("before") + F.col("inside")).alias("begin"))


def fill(docs: DataFrame, window: int, id_col: str) -> DataFrame:
    """Documents laid end to end, cut every ``window`` tokens."""
    first, last = F.expr(f"begin div {window}"), F.expr(f"(begin + n - 1) div {window}")
    pieces = docs.withColumn("no", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("no") * window, F.col("begin")) - F.col("begin")
    hi = F.least((F.col("no") + 1) * window, F.col("begin") + F.col("n")) - F.col("begin")
    rows = pieces.select((F.shiftleft("region", 40) + F.col("no")).alias("window_id"), "id", "begin", lo.alias("start_token"), hi.alias("end_token"))
    position = F.row_number().over(Window.partitionBy("window_id").orderBy("begin")) - 1  # of at most ``window`` rows
    return rows.select("window_id", position.alias("position"), F.col("id").alias(id_col), "start_token", "end_token")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, target: float = 0.95, size_col: str | None = None) -> DataFrame:
    """``window_id``, ``position`` (from 0), ``id_col``, ``start_token``, ``end_token``: which tokens of which documents fill which window.

    Tokens are words, unless ``size_col`` gives each document's number of tokens (those of
    ``bpe.count_tokens``, say). Every token of every document lies in exactly one window; a document that
    passes the end of a window goes on in the next one. Windows are full but for the last one of each
    region. Documents without tokens (null, empty, punctuation only; null or no size) and null ids fill nothing and are
    left out; of rows that repeat an id the longest text counts. Ids may be of any type that has an
    order. Equal vectors (copies, say) stand next to each other, by id, and are one node of the graph.
    An empty table gives no rows; other columns are ignored.
    """
    embedded = persist(embed(docs, id_col, text_col, size_col), "embedded")
    kind = embedded.schema["id"].dataType.simpleString()
    nodes = persist(embedded.groupBy("node").agg(F.min("v").alias("v"), F.sum("n").alias("total")).select(F.col("node").alias("id"), "v", "total"), "nodes")
    n = nodes.count()
    if not n:
        return docs.sparkSession.createDataFrame([], f"window_id bigint, position int, `{id_col}` {kind}, start_token bigint, end_token bigint")
    vecs = nodes.select("id", "v")
    centroids = ivf.coarse(vecs, cells_for(n), DIM)
    edges = persist(graph(vecs, centroids, ivf.probes_needed(vecs, centroids, K, DIM, target)), "graph")
    placed, linked = place(nodes, edges, centroids)
    order = persist(ordered(placed, linked, centroids), "order")
    for t in (nodes, edges, placed, linked):
        discard(t)
    out = persist(fill(laid_out(embedded, order), window, id_col), "packed")
    for t in (embedded, order):
        discard(t)
    return out
