"""A log-bilinear language model trained by noise-contrastive estimation (Mnih and Teh, 2012).

Tokens are words, all of the corpus: its vocabulary grows with it. A word's probability is that of its
class, given the two classes before, times its share of the class' words in the corpus. The FREQUENT most frequent words
are classes of their own; the others fall into BUCKETS classes by hash, so the neural part has a fixed
size and only tells rare words' buckets apart, while word counts tell the words.

A context is the two classes before; its predicted vector is the sum of their vectors, each weighted by a vector of its
position, and a class' score is the product with its output vector plus its bias. Training sees every
token of the corpus once: each partition turns its part into distinct trigrams with counts and descends
on them from a common start; the results are averaged, weighted by tokens, before the next part. Noise
comes from the corpus' unigram distribution. Scoring normalises exactly over the classes, by batched
matrix products over the contexts that occur. As models are averaged over partitions, scores
differ a little with the partitioning of the input.

Texts are handled in blocks of up to a megabyte, which list their distinct rare words. The counts of the HEADS most
frequent of these are broadcast, those of all others joined to the blocks that hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .kernel import lowered_words, slices
from .store import persist

#: Numbers of classes: 0 begins a text, then the frequent words, then the buckets of the others.
FREQUENT, BUCKETS = 767, 256
#: Words after the frequent ones whose counts are broadcast, a megabyte.
HEADS = 65_536
VOCABULARY = 1 + FREQUENT + BUCKETS
DIM, NOISE, ROUNDS = 32, 64, 3
MINIBATCH, RATE = 8192, 0.1
_BITS = np.int32(10)
assert VOCABULARY <= 1 << _BITS


class Vocabulary(NamedTuple):
    """Sorted hashes of the frequent words and their class numbers; sorted hashes of the words after them and their counts."""

    hashes: np.ndarray
    numbers: np.ndarray
    heads: np.ndarray
    counts: np.ndarray

    def encode(self, h: np.ndarray) -> np.ndarray:
        out = (h % np.uint64(BUCKETS)).astype(np.int16) + np.int16(1 + FREQUENT)
        known, at = _find(self.hashes, h)
        out[known] = self.numbers[at[known]]
        return out


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


class Model(NamedTuple):
    """input: token vectors; position: weights of the token before (0) and the one before it (1)."""

    input: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    position: np.ndarray

    def pack(self) -> bytes:
        return np.concatenate([np.asarray(x, np.float32).ravel() for x in self]).tobytes()

    @staticmethod
    def unpack(raw: np.ndarray) -> Model:
        n = VOCABULARY * DIM
        return Model(raw[:n].reshape(-1, DIM), raw[n : 2 * n].reshape(-1, DIM), raw[2 * n : 2 * n + VOCABULARY], raw[2 * n + VOCABULARY :].reshape(2, DIM))


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (hash) and ``n`` over all texts; each task counts its own part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not keys:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)

        def flush() -> Iterable[pa.RecordBatch]:
            key, n = merged()
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["word", "n"])

        for b in batches:
            for part in slices(b, text_col):
                key, n = np.unique(lowered_words(part.column(text_col)).hash, return_counts=True)
                keys.append(key)
                counts.append(n)
                size += len(key)
                if size > 2_000_000:
                    key, n = merged()
                    keys, counts, size = [key], [n], len(key)
                    if size > 1_500_000:  # bounds memory; the shuffle adds the pieces up
                        yield from flush()
                        keys, counts, size = [], [], 0
        yield from flush()

    return docs.select(text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame) -> Vocabulary:
    """From (word, n) over all texts: the FREQUENT words with the highest counts and the HEADS next ones; ties by hash."""
    rows = counted.orderBy(F.desc("n"), "word").limit(FREQUENT + HEADS).toPandas()
    h, n = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order, after = np.argsort(h[:FREQUENT]), np.argsort(h[FREQUENT:])
    return Vocabulary(h[:FREQUENT][order], (order + 1).astype(np.int16), h[FREQUENT:][after], n[FREQUENT:][after])


def tokenise(docs: DataFrame, words: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """A row per text: ``block``, ``id``, ``tokens`` (classes as int16 bytes, null for a null text) and ``rare``; and one per block with ``words``.

    words: the hashes of the block's distinct words in buckets, by bucket. rare: for each token in a bucket
    its place among the bucket's words, in as few bytes as the block's largest bucket takes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in slices(b, "text"):
                w = lowered_words(part.column("text"))
                codes = shared.value.encode(w.hash)
                bucketed = codes > FREQUENT
                listed, where = np.unique(w.hash[bucketed], return_inverse=True)
                order = np.argsort(listed % np.uint64(BUCKETS), kind="stable")
                listed = listed[order]
                first, kind = bucket_starts(listed)
                place = np.empty(len(listed), np.int64)
                place[order] = np.arange(len(listed)) - first[(listed % np.uint64(BUCKETS)).astype(np.int64)]
                rare, upto = place[where].astype(kind), np.concatenate([[0], np.cumsum(bucketed)])
                there = part.column("text").is_valid().to_pylist()
                lists = [codes[i:j].tobytes() if t else None for i, j, t in zip(w.offset[:-1], w.offset[1:], there, strict=True)]
                places = [rare[upto[i] : upto[j]].tobytes() if t else None for i, j, t in zip(w.offset[:-1], w.offset[1:], there, strict=True)]
                none = pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block)), part.column("id"), pa.array(lists, pa.binary()), pa.array(places, pa.binary()), none], names=["block", "id", "tokens", "rare", "words"])
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, part.column("id").type), *[pa.nulls(1, pa.binary())] * 2, pa.array([listed.tobytes()])], names=["block", "id", "tokens", "rare", "words"])
                block += 1

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"block bigint, id {picked.schema[0].dataType.simpleString()}, tokens binary, rare binary, words binary")


def bucket_starts(listed: np.ndarray) -> tuple[np.ndarray, np.dtype]:
    """Where each bucket's words begin in a block's list, and the type of places within a bucket."""
    size = np.bincount((listed % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return np.cumsum(size) - size, np.min_scalar_type(int(size.max()))


def tail_counts(encoded: DataFrame, counted: DataFrame, words: Vocabulary) -> DataFrame:
    """``block``, ``place`` and ``n``: the corpus count of every block's words beyond the broadcast ones."""
    shared = encoded.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for block, packed in zip(b.column("block").to_pylist(), b.column("words"), strict=True):
                h = np.frombuffer(packed.as_buffer(), np.uint64)
                place = np.flatnonzero(~_find(shared.value.heads, h)[0])
                yield pa.RecordBatch.from_arrays([pa.array(h[place].view(np.int64)), pa.array(np.full(len(place), block)), pa.array(place)], names=["word", "block", "place"])

    asked = encoded.where("words is not null").select("block", "words").mapInArrow(run, "word bigint, block bigint, place bigint")
    return asked.join(counted, "word").select("block", "place", "n")


def _token_counts(encoded: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join([x for x in b.column("tokens").to_pylist() if x]), np.int16), minlength=VOCABULARY)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(VOCABULARY)), pa.array(n)], names=["token", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in encoded.select("tokens").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


def trigram_codes(lists: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every token of all lists (two before << 20 | one before << 10 | token), and the sizes of the lists."""
    size = np.fromiter((len(x) // 2 if x else 0 for x in lists), np.int64, len(lists))
    t = np.frombuffer(b"".join([x for x in lists if x]), np.int16).astype(np.int32)
    first = np.cumsum(size) - size
    one, two = np.zeros_like(t), np.zeros_like(t)
    one[1:], two[2:] = t[:-1], t[:-2]
    begin = first[size > 0]
    one[begin] = two[begin] = 0
    two[first[size > 1] + 1] = 0
    return (two << (2 * _BITS)) | (one << _BITS) | t, size


def _token_counts(encoded: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join([x for x in b.column("tokens").to_pylist() if x]), np.int16), minlength=VOCABULARY)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(VOCABULARY)), pa.array(n)], names=["token", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in encoded.select("tokens").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray, rate: float, slow: np.ndarray) -> None:
    """Adagrad step on the rows ``at`` of ``to``, which may repeat."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    total, row = np.add.reduceat(rows[order], first, axis=0), at[order][first]
    slow[row] += (total * total).mean(axis=-1) if total.ndim > 1 else total * total
    step = rate / np.sqrt(slow[row])
    to[row] -= total * (step[:, None] if total.ndim > 1 else step)


def descend(model: Model, codes: np.ndarray, counts: np.ndarray, noise: np.ndarray, seed: int, rate: float = RATE) -> Model:
    """One pass of noise-contrastive estimation over weighted trigrams.

    A minibatch shares its NOISE noise tokens; the data's log-odds of not being noise are its score
    less the log of NOISE times the token's noise probability.
    """
    rng = np.random.default_rng(seed)
    inp, out, bias, position = (x.astype(np.float32).copy() for x in model)
    slow = [np.full(VOCABULARY, 1e-4, np.float32) for _ in range(3)]
    slow_p = np.full((2, DIM), 1e-2, np.float32)
    log_noise = np.log(NOISE * noise + 1e-12).astype(np.float32)
    cumulative = np.cumsum(noise)
    order = rng.permutation(len(codes))
    for at in range(0, len(order), MINIBATCH):
        pick = order[at : at + MINIBATCH]
        code, weight = codes[pick], counts[pick].astype(np.float32)
        weight /= weight.sum()
        two, one, token = code >> (2 * _BITS), (code >> _BITS) & 1023, code & 1023
        fake = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1], side="right"), VOCABULARY - 1)
        v1, v2, o, n = inp[one], inp[two], out[token], out[fake]
        predicted = v1 * position[0] + v2 * position[1]
        real = (predicted * o).sum(1) + bias[token] - log_noise[token]
        false = predicted @ n.T + bias[fake] - log_noise[fake]
        g = -weight / (1 + np.exp(np.clip(real, -30, 30)))
        h = weight[:, None] / (1 + np.exp(np.clip(-false, -30, 30)))
        back = g[:, None] * o + h @ n
        g1, g2 = (back * v1).sum(0), (back * v2).sum(0)
        _add_rows(out, np.concatenate([token, fake]), np.concatenate([g[:, None] * predicted, h.T @ predicted]), rate, slow[0])
        _add_rows(bias, np.concatenate([token, fake]), np.concatenate([g, h.sum(0)]), rate, slow[1])
        _add_rows(inp, np.concatenate([one, two]), np.concatenate([back * position[0], back * position[1]]), rate, slow[2])
        for k, gp in enumerate((g1, g2)):
            slow_p[k] += gp * gp
            position[k] -= rate * gp / np.sqrt(slow_p[k])
    return Model(inp, out, bias, position)


def start(counts: np.ndarray, seed: int = 5) -> tuple[Model, np.ndarray]:
    """The unigram model and the noise distribution (counts plus one, but never the beginning of a text)."""
    noise = counts + 1.0
    noise[0] = 0
    noise /= noise.sum()
    rng = np.random.default_rng(seed)
    vec = lambda: rng.normal(0, 0.1, (VOCABULARY, DIM)).astype(np.float32)
    return Model(vec(), vec(), np.log(noise + 1e-9).astype(np.float32), np.ones((2, DIM), np.float32)), noise


def train(encoded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model from all of ``encoded`` (tokens) and the counts of its classes: every text is in one of the rounds, by its hash."""
    spark = encoded.sparkSession
    model, noise = start(counts)
    tasks = encoded.rdd.getNumPartitions()
    groups = max(1, int(np.sqrt(tasks)))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model, noise))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterable[pa.RecordBatch]:
            current, q = shared.value
            kept, n_kept, total, any_rows = [], 0, 0, False
            part = TaskContext.get().partitionId()

            def learn() -> None:
                nonlocal current, kept, n_kept, total
                codes, counts = np.unique(np.concatenate(kept), return_counts=True)
                total += int(counts.sum())
                current = descend(current, codes, counts, q, seed=1000 * r + part)
                kept, n_kept = [], 0

            for b in batches:
                codes, _ = trigram_codes(b.column("tokens").to_pylist())
                kept.append(codes)
                n_kept += len(codes)
                if n_kept > 4_000_000:
                    learn()
            if n_kept:
                learn()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([part % groups]), pa.array([float(total)]), pa.array([current.pack()], pa.binary())], names=["g", "n", "model"])

        def average(pdf: pd.DataFrame) -> pd.DataFrame:
            n = pdf["n"].sum()
            mean = sum(np.frombuffer(m, np.float32).astype(np.float64) * w for m, w in zip(pdf["model"], pdf["n"], strict=True)) / n
            return pd.DataFrame({"g": [0], "n": [n], "model": [mean.astype(np.float32).tobytes()]})

        mine = encoded.where("words is null").where(F.pmod(F.xxhash64("tokens"), F.lit(rounds)) == r).select("tokens")
        # two levels, so that neither a task nor the driver receives every partition's model
        schema = "g bigint, n double, model binary"
        rows = mine.mapInArrow(run, schema).groupBy("g").applyInPandas(average, schema).toPandas()
        if len(rows):
            model = Model.unpack(np.frombuffer(average(rows.sort_values("n"))["model"][0], np.float32))
    return model


class Tables:
    """Scores by pair of token and context position, and log normalisers of contexts, as needed."""

    def __init__(self, model: Model):
        one, two = ((model.input * p) @ model.output.T for p in model.position)
        self.one, self.two, self.bias = one.astype(np.float32), two.astype(np.float32), model.bias.copy()
        self.bias[0] = -1e9  # no text goes back to its beginning
        self.log_z = np.full(1 << (2 * int(_BITS)), np.nan, np.float32)

    def log_probabilities(self, code: np.ndarray) -> np.ndarray:
        context = code >> _BITS
        new = np.unique(context[np.isnan(self.log_z[context])])
        for at in range(0, len(new), 2048):
            c = new[at : at + 2048]
            s = self.one[c & 1023] + self.two[c >> _BITS] + self.bias
            top = s.max(1)
            self.log_z[c] = top + np.log(np.exp(s - top[:, None]).sum(1))
        token = code & 1023
        return self.one[context & 1023, token] + self.two[context >> _BITS, token] + self.bias[token] - self.log_z[context]


_tables: dict[bytes, Tables] = {}


def score_tokens(encoded: DataFrame, tail: DataFrame, words: Vocabulary, counts: np.ndarray, model: Model, id_col: str) -> DataFrame:
    """``id_col``, ``n_tokens``, ``mean_logprob``, ``perplexity``, ``token_logprobs`` of every text of ``tokenise``.

    tail: of ``tail_counts``. counts: of the classes.
    """
    raw = model.pack()
    shared = encoded.sparkSession.sparkContext.broadcast((words, np.log(np.maximum(counts, 1)), model, hashlib.sha1(raw).digest()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, log_total, model, key = shared.value
        if key not in _tables:
            _tables.clear()
            _tables[key] = Tables(model)
        whole = left.combine_chunks()
        has_words = whole["words"].is_valid()
        packed = whole.filter(has_words)["words"]
        h = np.frombuffer(packed[0].as_buffer(), np.uint64) if len(packed) else np.zeros(0, np.uint64)
        known, at = _find(words.heads, h)
        n = np.ones(len(h), np.int64)
        n[known] = words.counts[at[known]]
        n[right["place"].to_numpy()] = right["n"].to_numpy()
        log_n = np.log(n)
        part = whole.filter(pc.invert(has_words))
        lists = part["tokens"].to_pylist()
        codes, size = trigram_codes(lists)
        p = _tables[key].log_probabilities(codes).astype(np.float64)
        token = codes & 1023
        bucketed = token > FREQUENT
        first, kind = bucket_starts(h)
        rare = first[token[bucketed] - 1 - FREQUENT] + np.frombuffer(b"".join([x for x in part["rare"].to_pylist() if x]), kind)
        p[bucketed] += log_n[rare] - log_total[token[bucketed]]
        sums, stop = np.concatenate([[0.0], np.cumsum(p)]), np.cumsum(size)
        none, empty = np.array([x is None for x in lists], bool), size == 0
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = (sums[stop] - sums[stop - size]) / size
        offset = pa.array(np.concatenate([[0], stop]).astype(np.int32))
        columns = [part["id"].combine_chunks(), pa.array(size, mask=none), pa.array(mean, mask=empty), pa.array(np.exp(-np.where(empty, 0, mean)), mask=empty), pa.ListArray.from_arrays(offset, pa.array(p.astype(np.float32)), mask=pa.array(none))]
        return pa.Table.from_arrays(columns, names=[id_col, "n_tokens", "mean_logprob", "perplexity", "token_logprobs"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.groupBy("block").cogroup(tail.groupBy("block")).applyInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, mean_logprob double, perplexity double, token_logprobs array<float>")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all of ``docs`` and score every token of it.

    One row per input row: ``id_col``; ``n_tokens``; ``mean_logprob`` and ``perplexity`` (both null
    without tokens); ``token_logprobs``, natural logarithms of probabilities that sum to one over all words of the corpus.
    Null text: null in all columns but the id. Empty or wordless text: 0 tokens and an empty list.
    Null and repeated ids stay; equal texts get equal scores, up to rounding. Other columns are left out. An empty
    table gives an empty result.
    """
    counted = persist(count_words(docs, text_col), "words")
    words = vocabulary(counted)
    encoded = persist(tokenise(docs, words, id_col, text_col), "tokens")
    counts = _token_counts(encoded)
    return score_tokens(encoded, tail_counts(encoded, counted, words), words, counts, train(encoded, counts), id_col)
