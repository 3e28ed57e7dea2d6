"""Quality from weak labels: EM over heuristic labellers, then a hashed linear scorer.

Each labeller votes good (1), bad (0) or abstains (2) on a whole document. EM estimates every
labeller's accuracy on good and on bad documents and the share of good ones from the counts of vote
patterns over all documents; nothing else is needed, as a pattern determines the posterior. The
posteriors are the soft labels of a logistic scorer over hashed byte trigrams, which then judges
every document by its text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernel import Words, slices, text_bytes, words_of
from .toxicity import _share

LABELLERS = ("symbols", "capitals", "exclamations", "separators", "sentences", "repetition", "length", "short_words", "symbol_runs", "letters", "variety")
ABSTAIN = 2
#: A vote for bad is at least so many times as likely on a bad document as on a good one: without
#: it, EM can take rare kinds of junk for a habit of good documents.
LEAST_RATIO = 20
BITS = 16
#: Documents, hash-sampled, that the scorer is fitted on: about so many at most.
MAX_SAMPLE = 6_000
_kind = np.zeros((7, 256), np.float64)
_kind[0, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1  # printable ASCII symbols
_kind[0, [ord(c) for c in ".,'-;:\"()?"]] = 0
_kind[1, 65:91] = 1
_kind[2, 97:123] = 1
_kind[3, ord("!")] = 1
_kind[4, [ord(c) for c in "|{}<>~^"]] = 1
_kind[5, [ord(c) for c in ".?!"]] = 1
_kind[6, 128:] = 1
_mark = _kind[0] > 0


def _sums(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offset[1:]] - total[offset[:-1]]


def votes(texts: pa.Array) -> np.ndarray:
    """Votes of all labellers, a column each; an empty or null text gets bad for its length and no other vote."""
    raw, off = text_bytes(texts)
    words = words_of(raw, off)
    n_bytes, n_words = np.diff(off), np.diff(words.offset)
    symbol, upper, lower, shout, bar, stop, wide = (_sums(k.astype(np.uint8)[raw], off) for k in _kind)
    repeated = _repeats(words)
    short = _sums((words.end - words.start <= 3).astype(np.uint8), words.offset)
    per_byte, per_word, letters = np.maximum(n_bytes, 1), np.maximum(n_words, 1), np.maximum(upper + lower, 1)
    out = np.full((len(texts), len(LABELLERS)), ABSTAIN, np.int8)

    def vote(k: int, good: np.ndarray, bad: np.ndarray) -> None:
        out[good, k], out[bad, k] = 1, 0

    spoken = n_words > 0
    vote(0, spoken & (symbol < 0.02 * per_byte), spoken & (symbol > 0.05 * per_byte))
    vote(1, spoken & (upper < 0.1 * letters), (letters >= 20) & (upper > 0.3 * letters))
    vote(2, spoken & (shout < 0.02 * per_word), spoken & (shout > 0.1 * per_word))
    vote(3, spoken & (bar < 0.01 * per_word), spoken & (bar > 0.1 * per_word))
    vote(4, (n_words >= 20) & (stop > 0.02 * n_words) & (stop < 0.4 * n_words), (n_words >= 40) & (stop < 0.005 * n_words))
    vote(5, (n_words >= 10) & (repeated < 0.03 * n_words), (n_words >= 4) & (repeated > 0.3 * n_words))
    vote(6, n_words >= 30, n_words < 3)
    run = np.zeros(len(raw), np.uint8)
    run[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & _mark[raw[2:]]
    runs = _sums(run, off)
    distinct = np.bincount(_distinct_in(words), minlength=len(texts))
    vote(8, spoken & (runs < 0.02 * per_word), spoken & (runs > 0.2 * per_word))
    vote(9, spoken & (upper + lower + wide > 0.7 * n_bytes), (n_words >= 20) & (upper + lower + wide < 0.6 * n_bytes))
    vote(10, (n_words >= 10) & (distinct > 0.25 * n_words), (n_words >= 10) & (distinct < 0.12 * n_words))
    vote(7, (n_words >= 20) & (short > 0.1 * n_words) & (short < 0.8 * n_words), (n_words >= 20) & (short < 0.03 * n_words))
    return out


def _distinct_in(words: Words) -> np.ndarray:
    """The text that each distinct pair of text and word belongs to."""
    doc = np.repeat(np.arange(len(words.offset) - 1), np.diff(words.offset))
    key = np.unique((words.hash >> np.uint64(24)) | (doc.astype(np.uint64) << np.uint64(40)))
    return (key >> np.uint64(40)).astype(np.int64)


def _repeats(words: Words) -> np.ndarray:
    """How many of each text's words equal the word before."""
    same = np.zeros(len(words.hash), np.uint8)
    same[1:] = words.hash[1:] == words.hash[:-1]
    same[words.offset[:-1][words.offset[:-1] < len(same)]] = 0
    return _sums(same, words.offset)


def pattern_codes(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


class LabelModel(NamedTuple):
    """share of good documents; ``right[y, j]``: how often labeller j, when it votes, is right on class y."""

    share: float
    right: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        odds = np.full(len(v), np.log(self.share / (1 - self.share)))
        odds += np.where(v == 1, np.log(self.right[1] / (1 - self.right[0])), np.where(v == 0, np.log((1 - self.right[1]) / self.right[0]), 0.0)).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM from distinct vote patterns and how often each occurs; starts from the majority of votes.

    No patterns: share one half and accuracies at their starting value.
    """
    n = patterns.shape[1] if patterns.ndim == 2 else len(LABELLERS)
    model = LabelModel(0.5, np.full((2, n), 0.7))
    if not len(patterns):
        return model
    good, bad = (patterns == 1).sum(1), (patterns == 0).sum(1)
    p = np.clip((good + 0.5) / (good + bad + 1), 0.05, 0.95)
    p = np.where(bad >= 2, np.minimum(p, 0.3), p)  # labellers look for one fault each: two finds outweigh many passes
    for _ in range(rounds):
        w1, w0 = p * counts, (1 - p) * counts
        share = np.clip(w1.sum() / counts.sum(), 0.01, 0.99)
        right1 = ((patterns == 1) * w1[:, None]).sum(0) + 4.5
        right1 /= ((patterns != ABSTAIN) * w1[:, None]).sum(0) + 5
        right0 = ((patterns == 0) * w0[:, None]).sum(0) + 1.5
        right0 /= ((patterns != ABSTAIN) * w0[:, None]).sum(0) + 5
        right0 = np.clip(right0, 0.02, 0.99)
        right1 = np.clip(np.maximum(right1, 1 - right0 / LEAST_RATIO), 0.01, 0.9995)
        model = LabelModel(float(share), np.stack([right0, right1]))
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return model


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams; position i covers bytes i to i+2."""
    if len(raw) < 3:
        return np.zeros(0, np.uint16)
    x = raw.astype(np.uint32)
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)


#: The last feature: a word that equals the one before, which trigrams can't see.
REPEAT = 1 << BITS


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float


def _spans(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First trigram of each text, and the number of its trigrams."""
    return off[:-1], np.maximum(np.diff(off) - 2, 0)


def margins(texts: pa.Array, scorer: Scorer) -> np.ndarray:
    """Log-odds of good: bias, mean weight of the text's trigrams, and that of repeats; -30 for texts of under 3 bytes."""
    raw, off = text_bytes(texts)
    first, n = _spans(off)
    sums = np.zeros(max(len(raw) - 2, 0) + 1)
    np.cumsum(scorer.weights[trigrams(raw)], out=sums[1:])
    last = len(sums) - 1
    total = sums[np.minimum(first + n, last)] - sums[np.minimum(first, last)]
    words = words_of(raw, off)
    repeated = _repeats(words) / np.maximum(np.diff(words.offset), 1)
    return np.where(n > 0, scorer.bias + total / np.maximum(n, 1) + scorer.weights[REPEAT] * repeated, -30.0)


def fit_scorer(found: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 120, rate: float = 1.0, decay: float = 1e-6) -> Scorer:
    """Logistic regression on soft labels by Adam. found: for each document trigram ids, their shares, posterior."""
    weights, bias = np.zeros((1 << BITS) + 1, np.float64), 0.0
    if not found:
        return Scorer(weights.astype(np.float32), bias)
    target = np.array([t for _, _, t in found])
    size = np.array([len(i) for i, _, _ in found])
    index, value = np.concatenate([i for i, _, _ in found]).astype(np.int32), np.concatenate([x for _, x, _ in found])
    ends = np.cumsum(size)
    good = target.sum()
    weight = np.where(target > 0.5, 0.5 / max(good, 1), 0.5 / max(len(target) - good, 1))  # both classes count alike
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, steps + 1):
        sums = np.zeros(len(index) + 1)
        np.cumsum(weights[index] * value, out=sums[1:])
        z = np.clip(bias + sums[ends] - sums[ends - size], -30, 30)
        slope = (1 / (1 + np.exp(-z)) - target) * weight
        g = np.bincount(index, np.repeat(slope, size) * value, len(weights)) + decay * weights
        gb = slope.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        weights -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        bias -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
    return Scorer(weights.astype(np.float32), float(bias))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_sample: int = MAX_SAMPLE) -> tuple[LabelModel, Scorer]:
    """Labeller accuracies from all documents, and the scorer fitted on their posteriors.

    The patterns' counts cover every row; only those that occur reach the driver. An empty table
    gives a scorer with zero weights.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in batches:
            for part in slices(b, text_col):
                total += np.bincount(pattern_codes(votes(part.column(text_col))), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    rows = docs.select(text_col).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    codes = rows["code"].to_numpy(np.int64)
    model = fit_labellers((codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3, rows["n"].to_numpy(np.float64))
    n_docs = int(rows["n"].sum())

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text_col):
                texts = part.column(text_col)
                raw, off = text_bytes(texts)
                grams, posterior = trigrams(raw), model.posterior(votes(texts))
                words = words_of(raw, off)
                repeated = _repeats(words) / np.maximum(np.diff(words.offset), 1)
                ids, shares = [], []
                for i, n, r in zip(*_spans(off), repeated, strict=True):
                    index, times = np.unique(grams[i : i + n], return_counts=True)
                    ids.append(np.append(index.astype(np.int32), REPEAT).astype(np.int32).tobytes() if n else b"")
                    shares.append(np.append(times / max(n, 1), r).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(shares, pa.binary()), pa.array(posterior)], names=["ids", "shares", "good"])

    chosen = docs.where(F.coalesce(_share(max_sample, n_docs, id_col, 3), F.lit(False))).select(text_col)
    rows = chosen.mapInArrow(sample, "ids binary, shares binary, good double").toArrow()
    found = zip(*(rows[c] for c in ("ids", "shares", "good")), strict=True)
    found = [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.float32), g.as_py()) for i, s, g in found if len(i.as_buffer())]  # views, not copies
    # by content: the order of tasks must not change the model
    found.sort(key=lambda x: (len(x[0]), x[2], x[1].sum(), x[0].sum()))
    return model, fit_scorer(found)


def _probability(texts: pa.Array, scorer: Scorer) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-np.clip(margins(texts, scorer), -30, 30))), 6)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, ``quality`` (probability of good) and ``keep`` (at ``threshold`` or above), a row per input row.

    Null texts and those of under 3 bytes have quality 0. Ids may be null or repeat; equal texts get
    equal scores. Other columns are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text_col):
                p = _probability(part.column(text_col), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= threshold)], names=[id_col, "quality", "keep"])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, quality double, keep boolean")


def keep_good(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text_col):
                yield part.filter(pa.array(_probability(part.column(text_col), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
