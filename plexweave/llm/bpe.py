"""BPE encoding by backtracking over longest matches, and decoding through an offset table.

An Aho-Corasick automaton over the vocabulary gives every token that ends at a place of a word. A word is encoded
from left to right with the longest token that fits; where two neighbours could not stand side by side after the
merges, the last token gives way to its next shorter prefix, or, when there is none, the one before does. A bit per
position makes every dead end be seen once, so the time is linear in the word. Whether two tokens may be neighbours
depends on the pair alone and is kept in a table as it becomes known. The result equals that of merging by rank.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches, worker_cache, worker_memory

#: The vocabulary that the pipeline uses: a file of the public tokenizers.
VOCABULARY = "word_bpe_49k.json"
#: A worker remembers the ids of so many words; beyond that it starts anew.
CACHE_WORDS = 150_000
#: Texts encoded and handed on at once.
TEXTS = 200
PAIRS = 300_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file of the kind with word ends.

    In the automaton a word's end is a letter of its own (END), which follows the last letter.
    """

    END = ""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        size = max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens = [""] * size
        for t, i in self.vocab.items():
            self.tokens[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = _byte_letters()
        self._learn([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        blob = [t.encode() for t in self.tokens]
        self.offsets = np.concatenate([[0], np.cumsum([len(b) + 1 for b in blob])])
        self.blob = np.frombuffer(b"".join(b + b" " for b in blob), np.uint8)
        self.words = _Words(self)

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + self.END if token.endswith(self.suffix) else token

    def _learn(self, merges: list[tuple[str, str]]) -> None:
        self.rank_of: dict[tuple[int, int], int] = {}
        #: By token: its rank (-1: a letter) and its two parts.
        self.rank = [-1] * len(self.tokens)
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.tokens))]
        made = [-1] * len(merges)
        for r, (a, b) in enumerate(merges):
            left, right = self.vocab[a], self.vocab[b]
            self.rank_of.setdefault((left, right), r)
            made[r] = self.vocab[a + b]
            if self.rank[made[r]] < 0:
                self.rank[made[r]], self.parts[made[r]] = r, (left, right)
        self.fits: dict[tuple[int, int], bool] = {}
        self.length = [len(self._inner(t)) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        usable = {t: i for t, i in self.vocab.items() if self._stable(i)}
        for t, i in usable.items():
            self.automaton.add_word(self._inner(t), i)
        self.automaton.make_automaton()
        inner = {self._inner(t): i for t, i in usable.items()}
        self.whole = {t[: -len(self.suffix)]: i for t, i in usable.items() if t.endswith(self.suffix)}
        #: By token: the longest token that is a proper prefix of it, or -1.
        self.shorter = [-1] * len(self.tokens)
        for t, i in inner.items():
            self.shorter[i] = next((inner[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in inner), -1)

    def _stable(self, token: int) -> bool:
        """Whether a token's own letters merge into it: its parts do, and may not end up otherwise."""
        left, right = self.parts[token]
        return self.rank[token] < 0 or self._pair_holds(left, right, self.rank[token])

    def _pair_holds(self, left: int, right: int, limit: int) -> bool:
        """True if no merge of rank under `limit` joins a right edge of `left` to a left edge of `right`.

        Undoing the merges of both, latest first, passes through every state in which they stood side by side.
        """
        rank_of, rank, parts = self.rank_of, self.rank, self.parts
        while True:
            r = rank_of.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # on a tie of ranks both are the same token; the left of two merges first
                limit = min(limit, a)
                left = parts[left][1]
            else:
                limit = min(limit, b + 1)
                right = parts[right][0]

    def fit(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (known := self.fits.get(pair)) is None:
            if len(self.fits) >= PAIRS:  # rare; entries come back when asked for
                self.fits.clear()
            known = self.fits[pair] = self._pair_holds(left, right, len(self.rank_of) + 1)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given in byte letters."""
        text = word + self.END
        n = len(text)
        whole = self.whole.get(word)
        if whole is not None:
            return [whole]
        longest = [-1] * n
        length = self.length
        for end, token in self.automaton.iter(text):  # of those with one start the last is the longest
            longest[end - length[token] + 1] = token
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token, last, known, fit = 0, longest[0], -1, self.fits, self.fit
        while at < n:
            while token >= 0:
                end = at + length[token]
                # the last letter and the word's end are one symbol
                if end != n - 1 and open_[end] and (last < 0 or (known.get((last, token)) if (last, token) in known else fit(last, token))):
                    out.append(token)
                    at, last = end, token
                    token = longest[at] if at < n else -1
                    break
                token = self.shorter[token]
            else:
                open_[at] = 0
                if not out:
                    raise ValueError(f"no segmentation of {word[:50]!r}")
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = self.shorter[token]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for null and empty texts."""
        if not text:
            return np.zeros(0, np.int32)
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        packed = (np.uint32(self.special[p]).tobytes() if k % 2 else b"".join(map(self.words.__getitem__, self._words(p))) for k, p in enumerate(parts))
        return np.frombuffer(b"".join(packed), "<u4").astype(np.int32)

    @staticmethod
    def _words(text: str) -> list[str]:
        """Lower-cased runs between white space; nothing in the later steps looks beyond one."""
        if text.isascii():
            lowered = text.lower()
        else:
            lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in lowered for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split() only
            return regex.split(r"[\t-\r \x85\xa0  -     　]+", lowered)
        return lowered.split()

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of `ids` with a blank between each two, gathered from the token bytes by their offsets."""
        if not len(ids):
            return ""
        start = self.offsets[ids]
        size = self.offsets[np.asarray(ids, np.int64) + 1] - start
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
        return self.blob[at][:-1].tobytes().decode()


class _Words(dict):
    """Packed ids by run of letters between white space; when full, the older half goes."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.pieces: dict[str, list[int]] = {}

    def __missing__(self, run: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            for old in list(islice(self, CACHE_WORDS // 2)):
                del self[old]
        if len(self.pieces) >= CACHE_WORDS // 3:
            self.pieces.clear()
        bpe, ids, pieces = self.bpe, [], self.pieces
        for piece in (run,) if run.isascii() and run.isalpha() else bpe.pieces.findall(run):
            known = pieces.get(piece)
            if known is None:
                known = bpe.encode_word(piece if piece.isascii() and piece.isprintable() else "".join(map(bpe.letters.__getitem__, piece.encode())))
                if len(piece) < len(run) <= 64:
                    pieces[piece] = known
            ids += known
        packed = array("I", ids).tobytes()
        if len(run) <= 64:
            self[run] = packed
        return packed


_loaded: dict[str, WordBpe] = worker_cache("bpe")


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a file, once for each worker as long as it encodes or decodes."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text; null and empty texts have an empty list.

    One row for each row of `docs`, repeated ids and null ids included; other columns are not read. Texts that are
    spelled like a special token become that token, as in the library. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_memory("bpe"):
            bpe = tokenizer(path or public_tokenizers.path(VOCABULARY))
            for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
                ids = [bpe.encode(t.as_py()) for t in b.column(1)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.record_batch([b.column(0), lists], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, text: the ids of each row decoded; null ids give an empty text."""
    bound_batches(tokens.sparkSession)
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path or public_tokenizers.path(VOCABULARY))
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [bpe.decode(i if i is not None else []) for i in b["ids"]]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, text: encoding and decoding in one pass over the rows, so the ids cross to Python once."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path or public_tokenizers.path(VOCABULARY))
        for b in batches:
            ids = [bpe.encode(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "text": [bpe.decode(i) for i in ids]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
