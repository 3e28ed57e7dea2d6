"""Byte-level BPE over public vocabularies: exact token counts, encoding and decoding.

The vocabulary is a rank file (base64 token, rank) whose path is a parameter.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernel import list_array

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker keeps per cache before it starts anew; bounds memory, not the work.
CACHE = 400_000
_pattern = regex.compile(PATTERN)
_rare_space = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def count_merged(word: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one pre-token: its bytes minus the merges made.

    A heap holds (rank, position) of adjacent pairs, a linked list the symbols. The lowest rank is
    popped first, the leftmost on ties; an entry whose symbols have changed since is skipped.
    """
    n = len(word)
    if n < 2 or word in ranks:
        return min(n, 1)
    get, pop, push, step = ranks.get, heapq.heappop, heapq.heappush, n + 1
    end = [*range(1, step), -1]  # symbol i is word[i:end[i]], 0 once it is merged away; the next one begins at end[i]
    before = [*range(-1, n)]
    heap = [(r * step + i) * step + i + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        at, stop = divmod(pop(heap), step)
        left = at % step
        right = end[left]
        if not right or end[right] != stop:
            continue
        merges += 1
        end[right] = 0
        end[left] = stop
        if stop < n:
            before[stop] = left
            if (r := get(word[left : end[stop]])) is not None:
                push(heap, (r * step + left) * step + end[stop])
        if left and (r := get(word[before[left] : stop])) is not None:
            push(heap, (r * step + before[left]) * step + stop)
    return n - merges


class Encoder:
    """Exact merges in linear time by backtracking over longest matches.

    Tokens are strings of Latin-1 characters, one per byte, in an Aho-Corasick automaton. At each
    position the longest token is tried first, then its next shorter prefix that is a token. A
    choice stands if it is compatible with the token before it: merging the two tokens' bytes alone
    gives these two again. Compatibility depends on the pair only and is memoised.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.shorter: dict[bytes, bytes | None] = {}
        self.compatible: dict[tuple[bytes, bytes], bool] = {}

    def next_shorter(self, token: bytes) -> bytes | None:
        if token not in self.shorter:
            self.shorter[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), None)
        return self.shorter[token]

    def fits(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > 2 * CACHE:
                self.compatible.clear()
            known = self.compatible[key] = self._merges_to(left, right)
        return known

    def _merges_to(self, left: bytes, right: bytes) -> bool:
        """Whether byte-pair merging of ``left + right`` never crosses their boundary."""
        word, cut, get = left + right, len(left), self.ranks.get
        parts = list(range(len(word) + 1))
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 2) if (r := get(word[parts[i] : parts[i + 2]])) is not None), default=None)
            if best is None:
                break
            if parts[best[1] + 1] == cut:
                return False
            del parts[best[1] + 1]
        return parts == [0, cut, len(word)]

    def encode(self, word: bytes) -> list[int]:
        """Ranks of the tokens of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        longest = [0] * n
        for last, size in self.automaton.iter(word.decode("latin-1")):
            at = last - size + 1
            if size > longest[at]:
                longest[at] = size
        possible = bytearray(b"\1") * (n + 1)  # cleared where no exact encoding can begin
        tokens: list[bytes] = []
        at = 0
        token: bytes | None = word[: longest[0]] if n else None
        while token is not None:
            previous = tokens[-1] if tokens else None
            while True:
                stop = at + len(token)
                if possible[stop] and (previous is None or self.fits(previous, token)):
                    tokens.append(token)
                    at = stop
                    token = word[at : at + longest[at]] if at < n else None
                    break
                if (less := self.next_shorter(token)) is not None:
                    token = less
                    continue
                if previous is None:
                    raise ValueError("the vocabulary lacks single bytes of this text")
                possible[at] = 0
                tokens.pop()
                at -= len(previous)
                token = previous
                break
        return [ranks[t] for t in tokens]


class _Pieces(dict):
    """Caches a function of pieces of text, with bounded memory.

    When full, the entries become the old generation; those asked for again move to the new one.
    """

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, piece):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value


class _Split:
    """Values of the parts of a text.

    A text is cut where a pre-token surely begins: before a single space between visible
    characters. That leaves every pre-token whole, so values of parts can be cached and combined.
    Texts with other white space go through the pattern as a whole.
    """

    def __init__(self, make, combine):
        def spaced(part):
            return make(" " + part) if part.isalpha() else self.of(" " + part)

        self.combine, self.plain, self.first, self.rest = combine, _Pieces(make), _Pieces(self.of), _Pieces(spaced)

    def of(self, text: str):
        return self.combine(self.rest[w[1:]] if w[0] == " " and w[1:].isalpha() else self.plain[w] for w in _pattern.findall(text))

    def __call__(self, text: str) -> Iterator:
        parts = text.split(" ")
        if "" in parts or "\n " in text or " \n" in text or _rare_space.search(text):
            return iter((self.of(text),))
        return chain((self.first[parts[0]],), map(self.rest.__getitem__, islice(parts, 1, None)))


_state: dict[tuple[str, str], _Split] = {}


def _cached(kind: str, path: str) -> _Split:
    if (kind, path) not in _state:
        ranks = load_ranks(path)
        if kind == "count":
            _state[kind, path] = _Split(lambda w: count_merged(w.encode(), ranks), sum)
        else:
            encoder = Encoder(ranks)
            _state[kind, path] = _Split(lambda w: np.array(encoder.encode(w.encode()), np.int32).tobytes(), b"".join)
    return _state[kind, path]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``n_tokens`` (long): tokens of each row's whole text; one output row per input row.

    Null text: null. Empty text: 0. Ids may be null or repeat. Other columns are left out, so a
    column called n_tokens in the input does no harm. No rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces = _cached("count", vocabulary)
        for b in batches:
            counts = [None if t is None else sum(pieces(t)) if t else 0 for t in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=[id_col, "n_tokens"])

    picked = df.select(id_col, text_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, n_tokens bigint")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``token_ids`` (array of int): the exact byte-level BPE of each row's whole text.

    Null text: null. Empty text: an empty array. Ids may be null or repeat; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces = _cached("encode", vocabulary)
        for b in batches:
            encoded = [None if t is None else b"".join(pieces(t)) if t else b"" for t in _texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), _id_lists(encoded)], names=[id_col, "token_ids"])

    picked = df.select(id_col, text_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, token_ids array<int>")


def _texts(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def _id_lists(encoded: list[bytes | None]) -> pa.ListArray:
    size = np.fromiter((0 if x is None else len(x) // 4 for x in encoded), np.int32, len(encoded))
    offset = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum(size, out=offset[1:])
    values = pa.array(np.frombuffer(b"".join([x for x in encoded if x]), np.int32), pa.int32())
    missing = pa.array([x is None for x in encoded], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offset), values, mask=missing) if len(encoded) else list_array(values, offset, pa.int32())


def decode(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``text``: bytes of the tokens joined, read as UTF-8.

    Null list: null. Empty list: the empty text. Bytes that aren't UTF-8 become U+FFFD. An id that
    isn't in the vocabulary, or a null in the list, is an error that names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        by_rank = _tokens_by_rank(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_decoded(b.column(1), by_rank)), pa.string())], names=[id_col, "text"])

    picked = df.select(id_col, tokens_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, text string")


_by_rank: dict[str, dict[int, bytes]] = {}


def _tokens_by_rank(path: str) -> dict[int, bytes]:
    if path not in _by_rank:
        _by_rank[path] = {rank: token for token, rank in load_ranks(path).items()}
    return _by_rank[path]


def _decoded(lists: pa.Array, by_rank: dict[int, bytes]) -> Iterator[str | None]:
    for at in range(len(lists)):
        if not lists[at].is_valid:
            yield None
            continue
        ids = lists[at].values
        if ids.null_count:
            raise ValueError("a token list holds a null")
        try:
            yield b"".join(map(by_rank.__getitem__, ids.to_numpy(zero_copy_only=False).tolist())).decode(errors="replace")
        except KeyError as e:
            raise ValueError(f"no token has the id {e}") from None


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col``, ``token_ids``, ``n_tokens`` and ``exact``: whether decoding gives the text back.

    Encoding and decoding run in one pass, so that token lists don't travel twice. Null text: null
    in all three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces, by_rank = _cached("encode", vocabulary), _tokens_by_rank(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, column = b.column(0).slice(at, 256), b.column(1).slice(at, 256)
                texts = column.to_pylist()
                lists = _id_lists([None if t is None else b"".join(pieces(t)) if t else b"" for t in texts])
                sizes = [None if t is None else n for t, n in zip(texts, lists.value_lengths().to_pylist(), strict=True)]
                exact = [None if t is None else t == back for t, back in zip(texts, _decoded(lists, by_rank), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(sizes, pa.int64()), pa.array(exact, pa.bool_())], names=[id_col, "token_ids", "n_tokens", "exact"])

    picked = df.select(id_col, text_col)
    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, token_ids array<int>, n_tokens bigint, exact boolean")
