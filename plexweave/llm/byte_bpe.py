"""Byte-level BPE: pre-tokens found by scans of transition functions, merged by rank with a cache, decoded by offsets.

A text becomes an array of classes of code points. With up to three code points of what follows, a class becomes a
symbol, and a small automaton over the symbols tells where a pre-token begins. The function that a symbol is on the
states, and all that can be composed from such functions, are numbered, so a stretch of text is one number and two
stretches are joined by one table lookup. Joining is associative: blocks of a text are folded side by side in numpy,
then their totals in the same way, and at last each block's states follow from the state at its begin. No regular
expression takes part; only the classes come from a library's Unicode tables.

Pre-tokens are slices of the text. A slice's ids are merged by rank and remembered. The byte offset of every token is
kept with the ids; decoding copies each token's bytes to its offset.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches

#: The rank file that is used unless another is named.
RANKS = "byte_bpe_50k.tiktoken"
#: A worker remembers the ids of so many pre-tokens of up to CACHE_LETTERS letters; when full, the older half goes.
CACHE_PIECES, CACHE_LETTERS = 300_000, 64
#: Texts are joined to about so many code points, and a longer text is scanned in stretches of so many.
STRETCH = 1 << 19
#: Pieces beyond so many bytes are merged with a heap.
HEAP_BYTES = 64

LETTER, DIGIT, OTHER, WHITE, BLANK, QUOTE, END = range(7)
#: Symbols: the first three classes, a quote before a contraction's one or two letters, a blank and other white space
#: before something else, white space before white space or the end, and the end of a text.
S_LETTER, S_DIGIT, S_OTHER, S_ONE, S_TWO, S_JOIN, S_LAST, S_WHITE, S_END = range(9)
#: States: within a run of letters, digits, others or white space; after a blank that joins what follows; at a place
#: where a pre-token must begin; with one or two letters of a contraction to come.
LETTERS, DIGITS, OTHERS, JOINED, SPACES, FRESH, ONE, TWO = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and whether a pre-token begins, by state and symbol."""
    follows, begins = np.empty((8, 9), np.uint8), np.ones((8, 9), bool)
    for symbol, state in ((S_LETTER, LETTERS), (S_DIGIT, DIGITS), (S_OTHER, OTHERS), (S_ONE, ONE), (S_TWO, TWO), (S_JOIN, JOINED), (S_LAST, FRESH), (S_WHITE, SPACES), (S_END, FRESH)):
        follows[:, symbol] = state
    for state in (OTHERS, JOINED):  # a quote within a run of others is one of them
        follows[state, [S_ONE, S_TWO]] = OTHERS
    begins[LETTERS, S_LETTER] = begins[DIGITS, S_DIGIT] = begins[SPACES, S_WHITE] = False
    begins[OTHERS, [S_OTHER, S_ONE, S_TWO]] = False
    begins[JOINED, [S_LETTER, S_DIGIT, S_OTHER, S_ONE, S_TWO]] = False
    follows[TWO, :S_END], follows[ONE, :S_END] = ONE, FRESH
    begins[[ONE, TWO], :S_END] = False
    return follows, begins


class _Functions:
    """All functions on the states that words of symbols are, numbered: 0 is the identity, then the symbols' own."""

    def __init__(self, follows: np.ndarray):
        n_states, n_symbols = follows.shape
        known = {tuple(range(n_states)): 0}
        for s in range(n_symbols):
            known.setdefault(tuple(follows[:, s].tolist()), len(known))
        self.of_symbol = np.array([known[tuple(follows[:, s].tolist())] for s in range(n_symbols)], np.uint16)
        own, todo = [f for f in known], list(known)
        while todo:
            f = todo.pop()
            for g in own:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        self.size = len(known)
        apply = np.array(list(known), np.uint8)
        self.apply = apply.ravel()
        self.n_states = n_states
        joined = np.array([[known[tuple(apply[b][apply[a]].tolist())] for b in range(self.size)] for a in range(self.size)], np.uint16)
        self.join = joined.ravel()

    def states(self, functions: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """The state before each of a row of functions, and after all of them, from `state` on."""
        n = len(functions)
        if n <= 64:
            out = np.empty(n, np.uint8)
            for k, f in enumerate(functions.tolist()):
                out[k] = state
                state = int(self.apply[f * self.n_states + state])
            return out, state
        width = 32
        rows = -(-n // width)
        folded = np.zeros(rows * width, np.uint16)
        folded[:n] = functions
        folded = np.ascontiguousarray(folded.reshape(rows, width).T)
        for j in range(1, width):
            folded[j] = self.join.take(folded[j - 1].astype(np.int32) * self.size + folded[j])
        first, state = self.states(folded[-1], state)
        out = np.empty((width, rows), np.uint8)
        out[0] = first
        for j in range(1, width):
            out[j] = self.apply.take(folded[j - 1].astype(np.int32) * self.n_states + first)
        return out.T.reshape(-1)[:n], state


@cache
def _tables() -> tuple[np.ndarray, _Functions, np.ndarray]:
    """Classes of code points, the numbered functions, and where pre-tokens begin by state and symbol."""
    classes = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [c if not 0xD800 <= c < 0xE000 else 0x21 for c in range(0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, points):
            classes[m.start() : m.end()] = kind
    classes[ord(" ")], classes[ord("'")] = BLANK, QUOTE
    follows, begins = _automaton()
    return classes, _Functions(follows), begins.ravel()


#: Letters after a quote: one that is a contraction, and two that are.
_SHORT = np.array([ord(c) for c in "stmd"])
_LONG = np.array([ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])


def _symbols(codes: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
    """Symbols of the first `n` code points; up to two more are looked at."""
    symbols = np.array([S_LETTER, S_DIGIT, S_OTHER, S_LAST, S_JOIN, S_OTHER, S_END], np.uint8).take(kinds[:n])
    white = (kinds == WHITE) | (kinds == BLANK)
    goes_on = np.ones(n, bool)  # white space or the end follows
    m = min(n, len(kinds) - 1)
    goes_on[:m] = white[1 : m + 1] | (kinds[1 : m + 1] == END)
    symbols[white[:n] & goes_on] = S_WHITE
    quotes = np.flatnonzero(kinds[:n] == QUOTE)
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        ended = np.concatenate([kinds, np.full(2, END, np.uint8)]) == END
        a, b = padded[quotes + 1].astype(np.int64), padded[quotes + 2].astype(np.int64)
        symbols[quotes[np.isin(a, _SHORT) & ~ended[quotes + 1]]] = S_ONE
        symbols[quotes[(a < 256) & (b < 256) & np.isin(a * 256 + b, _LONG) & ~ended[quotes + 1] & ~ended[quotes + 2]]] = S_TWO
    return symbols


def starts(codes: np.ndarray, ends: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """Places at which a pre-token begins in texts that lie end to end; `ends` are places of their separators, which count
    as begins too."""
    classes, functions, begins = _tables()
    found, state = [], FRESH
    kinds = classes.take(codes)
    kinds[ends] = END
    for at in range(0, len(codes), stretch):
        n = min(stretch, len(codes) - at)
        symbols = _symbols(codes[at : at + n + 2], kinds[at : at + n + 2], n)
        before, state = functions.states(functions.of_symbol.take(symbols), state)
        found.append(np.flatnonzero(begins.take(before.astype(np.int16) * 9 + symbols)) + at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        #: By two tokens that make up another: that one.
        self.pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None:
                    self.pairs[left << 20 | right] = rank
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.pieces = _Pieces(self)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: a token as it is, or else neighbours joined by the lowest rank, the first of equal ones."""
        if (own := self.ranks.get(piece)) is not None:
            return [own]
        if len(piece) > HEAP_BYTES:
            return self._merged_by_heap(piece)
        none, pairs = len(self.size), self.pairs
        ids = [*map(self.of_byte.__getitem__, piece)]
        # by part: the id that the part and its next one would have, which is their rank
        rank = [pairs.get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while rank and (low := min(rank)) < none:
            i = rank.index(low)
            ids[i] = low
            del ids[i + 1], rank[i]
            if i < len(rank):
                rank[i] = pairs.get(low << 20 | ids[i + 1], none)
            if i:
                rank[i - 1] = pairs.get(ids[i - 1] << 20 | low, none)
        return ids

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        """Ids of a long piece: a heap of neighbours by rank and place; an entry counts if its parts still stand."""
        n, ranks = len(piece), self.ranks
        after, before = list(range(1, n + 2)), list(range(-1, n))

        def pair(i: int) -> None:
            if i >= 0 and after[i] < n:
                end = after[after[i]]
                if (rank := ranks.get(piece[i:end])) is not None:
                    heapq.heappush(heap, (rank, i, end))

        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            pair(i)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            gone = after[i]
            alive[gone] = 0
            after[i] = end
            if end < n:
                before[end] = i
            pair(i)
            pair(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; none for null and empty texts. Short texts are scanned together."""
        out: list[np.ndarray] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1]) + 1
            if size >= STRETCH:
                out += self._encode_joined(held)
                held, size = [], 0
        return out + self._encode_joined(held) if held else out

    def _encode_joined(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        cuts = starts(codes, ends[:-1] - 1)
        pieces, at = self.pieces, [*cuts.tolist(), len(joined)]
        packed = [pieces[joined[a:b]] for a, b in zip(at, at[1:])]
        firsts = np.searchsorted(cuts, np.r_[0, ends]).tolist()
        # between two texts, the last slice is the separator
        return [np.frombuffer(b"".join(packed[a : b - (k + 1 < len(texts))]), "<i4") for k, (a, b) in enumerate(zip(firsts, firsts[1:]))]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins, and the number of bytes at the end."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size.take(ids))])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The bytes of the tokens, each copied to its offset."""
        shift = self.at.take(ids) - offsets[:-1]
        return self.blob.take(np.arange(offsets[-1]) + np.repeat(shift, np.diff(offsets))).tobytes()


class _Pieces(dict):
    """Packed ids by pre-token."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self.bpe.merged(piece.encode())).tobytes()
        if len(piece) <= CACHE_LETTERS:
            if len(self) >= CACHE_PIECES:
                for old in list(islice(self, CACHE_PIECES // 2)):
                    del self[old]
            self[piece] = packed
        return packed


@cache
def tokenizer(path: str | None = None) -> ByteBpe:
    """The tokenizer of a rank file, once for each worker."""
    return ByteBpe(path or public_tokenizers.path(RANKS))


def byte_encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, offsets array<long>: the ids of each whole text, and where each token's bytes begin, with
    the number of bytes last.

    One row for each row of `docs`, repeated and null ids included; null and empty texts have no ids and the offset 0.
    Special tokens are ordinary text. Other columns are not read; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            ids = bpe.encode_all(b.column(1).to_pylist())
            lists = [_lists(ids, pa.int32()), _lists([bpe.offsets(i) for i in ids], pa.int64())]
            yield pa.record_batch([b.column(0), *lists], ["doc_id", "ids", "offsets"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, offsets array<long>")


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def byte_decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str = "offsets", path: str | None = None) -> DataFrame:
    """doc_id, data binary: the bytes of each row's ids, placed by their offsets. Null ids give no bytes; where only the
    offsets are null, they follow from the ids."""
    bound_batches(tokens.sparkSession)
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"), F.col(offsets_col).alias("offsets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            data = []
            for ids, offsets in zip(b.column(1), b.column(2)):
                some = np.array(ids.as_py() or [], np.int64)
                data.append(bpe.decode(some, np.array(offsets.as_py(), np.int64) if offsets.is_valid and len(some) else bpe.offsets(some)))
            yield pa.record_batch([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")
