"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic documents are the positives; all documents, whatever their labels, are the
unlabelled set. With class prior p and logistic loss the risk is
``p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-))``; where the second term turns negative, the step
goes the other way, which keeps the model from fitting the positives' noise.

Three passes over the documents. Sums and squares of every feature over all of them are one
aggregate, from which the features that tell toxic from other documents are chosen. Then every
chunk of CHUNK documents descends on the risk of its own unlabelled documents and all positives,
and the models are averaged, weighted by documents; only weights travel. Chunks are cut from
partitions, so weights differ a little with the partitioning; one chunk is the plain estimator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import Words, lowered_words, slices
from .store import discard, persist

BITS = 18
#: Byte lengths of the word beginnings that count as features beside whole words.
PREFIXES = (4, 5, 7)
#: Labelled toxic documents that the classifier is fitted on, at most about so many (hash-sampled).
MAX_POSITIVE = 4_000
#: Features that the classifier looks at. What isn't chosen has weight 0: toxic vocabulary that is
#: rarer than the KEEP most telling features goes unseen. Every task trains on CHUNK x KEEP numbers.
KEEP = 256
#: Largest share of a document that a feature counts with, so that one repeated word doesn't decide.
CLIP = 0.02
#: Welch's t that a feature must reach to be chosen.
LEAST_T = 2.5
#: Documents of one descent.
CHUNK = 8_192
#: Shares are summed as whole numbers of this unit, exactly, in any order.
_UNITS = 1_000_000


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    prior: float


class Chosen(NamedTuple):
    """Sorted feature numbers, and the deviations of their shares over all documents."""

    features: np.ndarray
    deviation: np.ndarray


def _hashes(words: Words) -> np.ndarray:
    """Hashed features: for each word its own and those of its beginnings, word after word."""
    shift = np.uint64(64 - BITS)
    return np.stack([h >> shift for h in (words.hash, *(words.prefix[k] for k in PREFIXES))], axis=1).astype(np.int64)


def margins(texts: pa.Array, model: Model) -> np.ndarray:
    """The model's log-odds: bias plus the mean weight of the features; bias alone without words."""
    words = lowered_words(texts, PREFIXES)
    table = model.weights
    shift = np.uint64(64 - BITS)
    total = np.zeros(len(words.hash))
    for h in (words.hash, *(words.prefix[k] for k in PREFIXES)):
        total += table[h >> shift]
    sums = np.zeros(len(total) + 1)
    np.cumsum(total, out=sums[1:])
    n = np.diff(words.offset)
    return np.where(n > 0, model.bias + (sums[words.offset[1:]] - sums[words.offset[:-1]]) / np.maximum(n * (1 + len(PREFIXES)), 1), -30.0)


def slopes(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The step's slopes by the log-odds of positives and unlabelled documents.

    Those of the risk itself, unless its unlabelled part is negative: then those of that part's
    negative alone, which lead back.
    """
    sig_p, sig_u = 1 / (1 + np.exp(-z_p)) / len(z_p), 1 / (1 + np.exp(-z_u)) / len(z_u)
    if np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean() >= 0:
        return np.full(len(z_p), -prior / len(z_p)), sig_u  # prior * (R_pos(+) - R_pos(-)) is linear in z_p
    return prior * sig_p, -sig_u


def descend(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 300, rate: float = 0.02, decay: float = 3e-3) -> tuple[np.ndarray, float]:
    """Weights and bias after Adam on the non-negative risk of dense positives and unlabelled documents."""
    x_p, x_u = np.asarray(x_p, np.float32), np.asarray(x_u, np.float32)
    n = x_p.shape[1]
    w, m, v = np.zeros(n + 1, np.float32), np.zeros(n + 1), np.zeros(n + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        z_p, z_u = (np.clip((x @ w[:-1] + w[-1]).astype(np.float64), -30, 30) for x in (x_p, x_u))
        slope_p, slope_u = slopes(z_p, z_u, prior)
        g = np.append(slope_p.astype(np.float32) @ x_p + slope_u.astype(np.float32) @ x_u + decay * w[:-1], slope_p.sum() + slope_u.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w[:-1].astype(np.float64), float(w[-1])


def _share(wanted: int, there: int, column: str, seed: int) -> F.Column:
    """Rows whose hashed id falls under the share that gives about ``wanted`` rows."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1 << 31)) < min(1 << 31, int((1 << 31) * wanted / max(there, 1)))


def _statistics(marked: DataFrame) -> DataFrame:
    """``feature`` (-1: the number of documents with words), ``s``, ``q``: sums and squares of clipped shares over all rows; ``ps``, ``pq``: over positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, n = np.zeros((4, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for part in slices(b, "_text"):
                words = lowered_words(part.column("_text"), PREFIXES)
                size = np.diff(words.offset)
                toxic = part.column("_positive").to_numpy(zero_copy_only=False)
                n += [(size > 0).sum(), (size[toxic] > 0).sum()]
                key, times = np.unique((np.repeat(np.arange(len(size)) << BITS, size)[:, None] | _hashes(words)).ravel(), return_counts=True)
                doc, feature = key >> BITS, key & ((1 << BITS) - 1)
                units = np.minimum(times * _UNITS // (size[doc] * (1 + len(PREFIXES))), int(CLIP * _UNITS))
                for k, (at, x) in enumerate(((feature, units), (feature[toxic[doc]], units[toxic[doc]]))):
                    total[2 * k] += np.bincount(at, x, 1 << BITS).astype(np.int64)
                    total[2 * k + 1] += np.bincount(at, x * x, 1 << BITS).astype(np.int64)
        used = np.flatnonzero(total[0])
        columns = [np.append(-1, used), *(np.append(x, t[used]) for x, t in zip((n[0], 0, n[1], 0), total, strict=True))]
        for at in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=["feature", "s", "q", "ps", "pq"])

    each = marked.mapInArrow(run, "feature bigint, s bigint, q bigint, ps bigint, pq bigint")
    return each.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("s", "q", "ps", "pq")])


def choose(statistics: DataFrame, keep: int) -> Chosen:
    """The ``keep`` features whose mean share differs most surely between positives and all, by Welch's t; ties by number."""
    n = statistics.where("feature = -1").first()
    none = Chosen(np.zeros(0, np.int64), np.zeros(0, np.float32))
    if n is None or not n["s"] or not n["ps"]:
        return none
    col = lambda c: F.col(c).cast("double")
    mean, mean_p = col("s") / n["s"] / _UNITS, col("ps") / n["ps"] / _UNITS
    var = F.greatest(col("q") / n["s"] / _UNITS**2 - mean * mean, F.lit(0.0))
    var_p = F.greatest(col("pq") / n["ps"] / _UNITS**2 - mean_p * mean_p, F.lit(0.0))
    t = F.abs(mean_p - mean) / F.sqrt(var / n["s"] + var_p / n["ps"] + (1e-3 / n["ps"]) ** 2)
    best = statistics.where("feature >= 0").select("feature", t.alias("t"), var.alias("var")).where(F.col("t") >= LEAST_T).orderBy(F.desc("t"), "feature").limit(keep)
    rows = sorted((r["feature"], r["var"]) for r in best.collect())
    if not rows:
        return none
    return Chosen(np.array([f for f, _ in rows]), np.sqrt(np.array([v for _, v in rows]) + (0.1 * CLIP) ** 2 / n["s"]).astype(np.float32))


def dense(texts: pa.Array, chosen: Chosen) -> np.ndarray:
    """A row per text with words: the clipped shares of the chosen features over their deviations."""
    words = lowered_words(texts, PREFIXES)
    size, width = np.diff(words.offset), len(chosen.features)
    where = np.full(1 << BITS, -1, np.int64)
    where[chosen.features] = np.arange(width)
    at = where[_hashes(words)]
    row, k = np.nonzero(at >= 0)
    doc = np.repeat(np.arange(len(size)) * width, size)[row]
    times = np.bincount(doc + at[row, k], minlength=len(size) * width).reshape(-1, width)[size > 0]
    return np.minimum(times / (size[size > 0, None] * (1 + len(PREFIXES))), CLIP).astype(np.float32) / chosen.deviation


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_positive: int = MAX_POSITIVE, keep: int = KEEP) -> Model:
    """A model from documents and a table of labels with ``id_col`` and ``toxic_col`` (1: confirmed toxic).

    max_positive bounds the labelled toxic documents that are sent to every task: about so many, by
    hash of their ids; more would sharpen the positives' side of the risk. Feature statistics and the
    unlabelled side cover every document. The class prior is the share of confirmed toxic among all
    labelled ids. Null ids and labels are ignored, repeated labels count once, and an id with several
    labels is toxic if one says so; of a toxic id's rows in ``docs`` one is a positive. No positives,
    no documents or no telling feature: a model that finds nothing toxic.
    """
    nothing = Model(np.zeros(1 << BITS, np.float32), -30.0, 0.0)
    known = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(id_col).agg(F.max(toxic_col).alias("toxic"))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not n_toxic:
        return nothing
    prior = min(max(n_toxic / n_known, 1e-4), 0.9)
    chosen_ids = known.where((F.col("toxic") == 1) & _share(max_positive, n_toxic, id_col, 1)).select(F.col(id_col).alias("_id"), F.lit(True).alias("_hit"))
    # bounded by max_positive, whatever the size of labels
    marked = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen_ids), F.col("_doc") == F.col("_id"), "left")
    statistics = persist(_statistics(marked.select("_text", F.coalesce("_hit", F.lit(False)).alias("_positive"))), "features")
    chosen = choose(statistics, keep)
    discard(statistics)
    if not len(chosen.features):
        return nothing
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chosen)

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "_text"):
                there = part.filter(pa.array(np.diff(lowered_words(part.column("_text")).offset) > 0))
                v = pa.array([x.tobytes() for x in dense(there.column("_text"), shared.value)], pa.binary())
                yield pa.RecordBatch.from_arrays([there.column("_doc"), v], names=["_doc", "v"])

    found = marked.where("_hit").select("_doc", "_text")
    rows = found.mapInArrow(positive, f"_doc {found.schema['_doc'].dataType.simpleString()}, v binary").groupBy("_doc").agg(F.min("v").alias("v")).select("v").toArrow()
    # by content: the order of tasks must not change the model
    x_p = spark.sparkContext.broadcast(np.frombuffer(b"".join(sorted(rows["v"].to_pylist())), np.float32).reshape(-1, len(chosen.features)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kept, n = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal kept, n
            w, bias = descend(x_p.value, np.concatenate(kept), prior)
            out = np.concatenate([[1.0], w, [bias]]) * n
            kept, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["at", "x"])

        for b in batches:
            for part in slices(b, "_text"):
                x = dense(part.column("_text"), shared.value)
                while len(x):
                    take = x[: CHUNK - n]
                    kept.append(take)
                    x, n = x[len(take) :], n + len(take)
                    if n == CHUNK:
                        yield flush()
        if n:
            yield flush()

    total = docs.select(F.col(text_col).alias("_text")).mapInArrow(learn, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    mean = np.array([r["x"] for r in total])
    mean = np.round(mean[1:] / mean[0], 9)
    table = np.zeros(1 << BITS, np.float32)
    table[chosen.features] = mean[:-1] / chosen.deviation
    return Model(table, float(mean[-1]), prior)


def _probability(texts: pa.Array, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins(texts, model), -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, ``toxicity`` (probability) and ``is_toxic`` (at ``threshold`` or above), one row per input row.

    Null, empty and wordless texts have probability 0. Ids may be null or repeat; equal texts get
    equal scores. Other columns are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text_col):
                p = np.round(_probability(part.column(text_col), shared.value), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= threshold)], names=[id_col, "toxicity", "is_toxic"])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, toxicity double, is_toxic boolean")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` doesn't call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text_col):
                yield part.filter(pa.array(np.round(_probability(part.column(text_col), shared.value), 6) < threshold))

    return docs.mapInArrow(run, docs.schema)
