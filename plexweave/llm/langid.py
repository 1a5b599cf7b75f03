"""Language identification by unigram piece models, marginalised over segmentations.

For each language a probability of every piece of a fixed public vocabulary is learned by expectation maximisation.
The probability of a word is the sum over all its segmentations into pieces, by the forward algorithm; a text is as
probable as its words together. Words are runs of letters, lower-cased, with the vocabulary's mark of a word's start.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches, held_out

#: The vocabulary: pieces of a public tokenizer. Only the strings are used.
VOCABULARY = "piece_bpe_32k.model"
#: Characters learned from for each language and for all together, about: documents are taken by a hash until the bound is met.
SAMPLE_CHARS, SAMPLE_TOTAL = 2_000_000, 20_000_000
#: Documents longer than this are not learned from.
SAMPLE_LONGEST = 200_000
ROUNDS = 3
#: Probability mass kept for each piece before the data, and for a letter outside the vocabulary.
SMOOTHING, UNKNOWN = 0.01, 1e-7
#: Runs of up to so many letters are swept whole; longer ones in parts, each of which goes on from the sums of the one
#: before. They are learned from in parts of that length.
LONGEST = 40
#: Words that a worker remembers.
CACHE_WORDS = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str], mark: str = START) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words as a matrix, padded with 0, each with the mark of a word's start; and the lengths."""
    lengths = np.array([len(w) + len(mark) for w in words], np.int64)
    width = int(lengths.max(initial=1))
    flat = "".join((mark + w).ljust(width, "\0") for w in words).encode("utf-32-le")
    return np.frombuffer(flat, np.uint32).reshape(len(words), width).astype(np.uint64), lengths


class Pieces:
    """All places of pieces in words, found by rolling hashes of each length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.names = sorted({p for p in names if p == p.lower() and (p == START or p.lstrip(START).isalpha()) and p.count(START) <= 1})
        #: by length: sorted hashes of the pieces, and the pieces
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(p) for p in self.names])
        for n in np.unique(sizes).tolist():
            ids = np.flatnonzero(sizes == n)
            value = np.zeros(len(ids), np.uint64)
            for c in np.array([list(map(ord, self.names[i])) for i in ids], np.uint64).T:
                value = (value + c + np.uint64(1)) * _BASE
            order = np.argsort(value)
            self.by_length[n] = value[order], ids[order]

    def places(self, words: list[str], mark: str = START) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word, start, end, piece of each match, in the order of end and word; and the words' lengths.

        A letter without a piece of its own has the piece -1, so every word has a segmentation.
        """
        codes, lengths = _codes(words, mark)
        found = []
        value = np.zeros_like(codes)
        for n in range(1, min(max(self.by_length), codes.shape[1]) + 1):
            starts = codes.shape[1] - n + 1
            value = (value[:, :starts] + codes[:, n - 1 : n - 1 + starts] + np.uint64(1)) * _BASE
            inside = np.arange(starts) + n <= lengths[:, None]
            if n not in self.by_length:
                continue
            known, ids = self.by_length[n]
            at = np.minimum(np.searchsorted(known, value), len(known) - 1)
            hit = known[at] == value
            word, start = np.nonzero(hit & inside if n > 1 else inside)
            piece = ids[at[word, start]]
            if n == 1:
                piece = np.where(hit[word, start], piece, -1)
            found.append((word, start, start + n, piece))
        word, start, end, piece = map(np.concatenate, zip(*found))
        order = np.argsort(end * len(words) + word, kind="stable")
        return word[order], start[order], end[order], piece[order], lengths


def _sweep(table: np.ndarray, to: np.ndarray, word: np.ndarray, at: np.ndarray, source: np.ndarray, weight: np.ndarray, levels: range) -> None:
    """table[word, at] gathers table[word, source] * weight, level by level of `at`; rows are in the order of level and word."""
    falling = levels.step < 0
    cuts = np.searchsorted(-to if falling else to, [-v for v in levels] if falling else list(levels), "left").tolist() + [len(to)]
    for level, first, last in zip(levels, cuts, cuts[1:]):
        if first == last:
            continue
        w = word[first:last]
        add = table[w, source[first:last]] * weight[first:last]
        heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        table[w[heads], level] += np.add.reduceat(add, heads, axis=0)


def forward(places, probability: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: the probability of all segmentations up to a position."""
    word, start, end, piece, lengths = places
    alpha = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1, probability.shape[1]))
    alpha[:, 0] = 1.0
    _sweep(alpha, end, word, end, start, probability[piece], range(1, alpha.shape[1]))
    return alpha


def word_scores(words: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations."""
    long = np.array([len(w) > LONGEST for w in words], bool)
    out = np.zeros((len(words), probability.shape[1]))
    short = [w for w, x in zip(words, long) if not x]
    if short:
        places = pieces.places(short)
        out[~long] = np.log(np.maximum(forward(places, probability)[np.arange(len(short)), places[4]], 1e-300))
    if long.any():
        out[long] = _long_scores([w for w, x in zip(words, long) if x], pieces, probability)
    return out


def _long_scores(words: list[str], pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """word_scores of words of any length: the sums of the last places, as many as a piece is long, go on to the next part."""
    texts, tail, langs = [START + w for w in words], max(pieces.by_length), probability.shape[1]
    lengths = np.array([len(t) for t in texts])
    alpha, scale, out = np.zeros((len(texts), tail, langs)), np.zeros((len(texts), langs)), np.zeros((len(texts), langs))
    alpha[:, -1] = 1.0
    rows, done = np.arange(len(texts)), 0
    while len(rows):
        # each part begins with the letters between the places that are known; the first has none before it
        parts = [("\0" * max(0, tail - 1 - done) + texts[i][max(0, done - tail + 1) : done + LONGEST]) for i in rows]
        word, start, end, piece, _ = pieces.places(parts, "")
        table = np.zeros((len(rows), tail + LONGEST, langs))
        table[:, :tail] = alpha[rows]
        _sweep(table, end, word, end, start, probability[piece], range(tail, tail + LONGEST))
        last = lengths[rows] - done + tail - 1
        ends = last < tail + LONGEST
        out[rows[ends]] = np.log(np.maximum(table[np.flatnonzero(ends), last[ends]], 1e-300)) + scale[rows[ends]]
        top = np.maximum(table[:, LONGEST:].max(axis=1), 1e-300)
        alpha[rows], scale[rows] = table[:, LONGEST:] / top[:, None], scale[rows] + np.log(top)
        rows, done = rows[~ends], done + LONGEST
    return out


def learn(counts: Counter, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, the last row for letters without a piece, from words and how often they occur."""
    size = len(pieces.names)
    probability = np.full((size + 1, 1), 1.0 / size)
    probability[-1] = UNKNOWN
    words = sorted(counts, key=len)
    chunks = [(pieces.places(words[k : k + 20_000]), np.array([counts[w] for w in words[k : k + 20_000]], float)) for k in range(0, len(words), 20_000)]
    for _ in range(rounds):
        expected = np.full(size + 1, SMOOTHING)
        for places, times in chunks:
            word, start, end, piece, lengths = places
            weight = probability[piece]
            alpha = forward(places, probability)
            beta = np.zeros_like(alpha)
            beta[np.arange(len(lengths)), lengths] = 1.0
            back = np.lexsort((word, -start))
            _sweep(beta, start[back], word[back], start[back], end[back], weight[back], range(alpha.shape[1] - 1, -1, -1))
            total = alpha[np.arange(len(lengths)), lengths, 0]
            share = alpha[word, start, 0] * weight[:, 0] * beta[word, end, 0] / np.maximum(total[word], 1e-300) * times[word]
            np.add.at(expected, piece, share)
        expected[-1] = 0
        probability = np.r_[expected[:-1] / expected.sum(), UNKNOWN][:, None]
    return probability


def runs(token: str) -> list[str]:
    """A token's runs of letters, lower-cased."""
    return _LETTERS.findall(token.lower())


class Identifier:
    """Scores texts for a fixed set of languages."""

    def __init__(self, languages: list[str], probability: np.ndarray, path: str):
        self.languages, self.probability, self.path = languages, probability, path
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(languages) + 1))
        self.pieces: Pieces | None = None

    def __getstate__(self):
        return self.languages, self.probability.astype(np.float32), self.path

    def __setstate__(self, state):
        self.__init__(*state)

    def _know(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.rows]
        if not new:
            return
        self.pieces = self.pieces or Pieces(self.path)
        if len(self.rows) + len(new) > CACHE_WORDS:
            self.rows, self.table, new = {}, self.table[:0], list(tokens)
        parts = [runs(t) for t in new]
        words = sorted({r for p in parts for r in p}, key=len)  # like lengths together, for little padding
        at = {w: k for k, w in enumerate(words)}
        scores = np.concatenate([np.zeros((0, len(self.languages)))] + [word_scores(words[k : k + 4000], self.pieces, self.probability) for k in range(0, len(words), 4000)])
        token = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        run = np.fromiter((at[r] for p in parts for r in p), np.int64, len(token))
        fresh = np.zeros((len(parts), len(self.languages) + 1))
        np.add.at(fresh, token, np.c_[scores[run], np.ones(len(run))])
        self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.concatenate([self.table, fresh])

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The most probable language of each text, `und` where there are no letters, and its share of the probability.

        For the share, a text of more than one word counts as the square root of its words.
        """
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        split = [(t or "").split() for t in texts]
        best, share = [], []
        self._know(set().union(*split))
        for tokens in split:
            total = self.table[list(map(self.rows.__getitem__, tokens))].sum(axis=0) if tokens else np.zeros(len(self.languages) + 1)
            if not total[-1]:
                best.append("und")
                share.append(0.0)
                continue
            scaled = total[:-1] / np.sqrt(total[-1])
            weight = np.exp(scaled - scaled.max())
            k = int(np.argmax(total[:-1]))
            best.append(self.languages[k])
            share.append(float(weight[k] / weight.sum()))
        return best, share


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, path: str | None = None) -> Identifier:
    """Learn from documents that are not held out and have a language: about `sample_chars` characters of each."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        ~held_out(F.col("id")) & F.col("lang").isNotNull() & (F.length("text") <= SAMPLE_LONGEST)
    )
    sizes = {r["lang"]: r["chars"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()}
    if not sizes:
        return Identifier([], np.zeros((1, 0)), path)
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) / 1e6
    sample_chars = min(sample_chars, SAMPLE_TOTAL / len(sizes))
    bound = F.element_at(F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_chars / max(n, 1))))), F.col("lang"))
    words: dict[str, Counter] = {lang: Counter() for lang in sorted(sizes)}
    for r in rows.where(part < bound).select("text", "lang").toLocalIterator():
        words[r["lang"]].update(w[k : k + LONGEST] for t in r["text"].split() for w in runs(t) for k in range(0, len(w), LONGEST))
    words = {lang: c for lang, c in words.items() if c}
    pieces = Pieces(path)
    learned = [learn(c, pieces) for c in words.values()]
    return Identifier(list(words), np.concatenate(learned, axis=1) if learned else np.zeros((1, 0)), path)


def identified(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of `docs`, whose whole texts are read.

    `lang_pred` is a learned language, or `und` with score 0 where the text is null, empty or has no letter, or
    nothing was learned. Equal texts have equal results; ties go to the language first in order. Null ids count as
    held out. An empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                best, share = shared.value.texts(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": best, "score": share})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
