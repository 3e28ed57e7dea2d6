"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of ASCII letters, digits and non-ASCII characters of the lower-cased text. A word's
64-bit hash is a difference of prefix sums of ``byte * BASE**position``, so that all words of a
segment are hashed by a handful of vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 18
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SEGMENT * 2:  # one huge word: tables for it alone
        out = [np.full(n, b, np.uint64) for b in (_BASE, _BASE_INVERSE)]
    elif len(_powers[0]) < n:
        out = [np.full(SEGMENT * 2, b, np.uint64) for b in (_BASE, _BASE_INVERSE)]
    else:
        return _powers[0], _powers[1]
    for p in out:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    if n <= SEGMENT * 2:
        _powers[:] = out
    return out[0], out[1]


class Words(NamedTuple):
    """``hash``, ``start``, ``end`` (bytes) of all words; those of text i are ``offset[i]:offset[i+1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray
    prefix: dict[int, np.ndarray]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words_of(raw: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """All words. prefixes: also hash the first k bytes (or all, of shorter words) for each k."""
    is_word = _IS_WORD[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = is_word[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = is_word[1:]
    ends_at = off[1:] - 1
    after[ends_at[(ends_at >= 0)]] = False
    start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    out = np.empty(len(start), np.uint64)
    heads = {k: np.empty(len(start), np.uint64) for k in prefixes}
    at = 0
    while at < len(start):
        first = start[at]
        stop = max(at + 1, int(np.searchsorted(end, first + SEGMENT, side="right")))
        s, e = start[at:stop] - first, end[at:stop] - first
        n = int(e[-1])
        power, inverse = _power_tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw[first : first + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        base, back = sums[s], inverse[s]
        out[at:stop] = mix((sums[e] - base) * back)
        for k, h in heads.items():
            h[at:stop] = mix((sums[np.minimum(s + k, e)] - base) * back + np.uint64(k))
        at = stop
    return Words(out, start, end, np.searchsorted(start, off), heads)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def lowered_words(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> Words:
    return words_of(*text_bytes(pc.utf8_lower(texts)), prefixes)


def segment_sums(values: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Sums of ``values[offset[i]:offset[i+1]]``, also for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offset[1:]] - total[offset[:-1]]


def list_array(values: np.ndarray, offset: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offset.astype(np.int32), pa.int32()), pa.array(values, kind))


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type) for n in schema.names for c in [columns[n]]], schema=schema)
