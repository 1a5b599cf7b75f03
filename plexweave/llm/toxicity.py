"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the embeddings of its hashed features: the word, and its first and last letters.
Filters of several widths run over the words; each filter's maximum over the text feeds a logistic output. Training
is on a bounded sample of labelled rows that are not held out, in which a rare language has all of its rows. Scores by
networks that learned from the other folds of the sample calibrate the score and, for each language with toxic rows,
the threshold for rejecting, which few rows move little from that of all languages. For scoring, each word's share of
each filter is worked out once, so that a text takes only sums and maxima.

Texts of the sample are split into words where they lie: what is kept of them is a 32-bit hash for each word, and the
features of each distinct one. Each network is trained by a task of its own; the driver gets the last one and the scores.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches, checkpointed, held_out, worker_memory

#: Labelled rows and characters learned from at most, about: rows are taken by a hash of their ids.
SAMPLE_ROWS, SAMPLE_CHARS = 12_000, 40_000_000
#: Texts longer than this are not learned from.
SAMPLE_LONGEST = 200_000
BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
FEATURES = 6
EPOCHS, BATCH, RATE, L2 = 6, 32, 0.05, 1e-6
#: Folds of the sample for the scores that calibrate.
FOLDS = 3
#: Scores from here on predict 1; also the threshold of languages without toxic rows.
THRESHOLD = 0.3
#: Toxic rows at which a language's own threshold counts as much as the common one, and the common one as much as THRESHOLD.
SHRINK = 10
#: Words that a worker remembers.
CACHE_WORDS = 150_000
#: Places of texts at which filters are held at once for scoring.
PLACES = 1 << 15
#: Words that came with the sample are held at most so many together before those that repeat are dropped.
KNOWN_AT_ONCE = 1 << 17
_STRIP = ".,;:!?\"'()[]{}#$%&*|<>«»“”„‘’…-_/\\"


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word's features; bucket 0 is empty. A word that is too short for one has it empty."""
    w = word.strip(_STRIP)
    if not w:
        return [0] * FEATURES
    parts = (f"={w}", *(f"{n}{w[:n]}" if len(w) >= n else "" for n in (3, 4, 5, 6)), f"-{w[-4:]}" if len(w) > 4 else "")
    return [1 + zlib.crc32(p.encode()) % (BUCKETS - 1) if p else 0 for p in parts]


class _Vocabulary(dict):
    """A row number by word, from 1 on; row 0 is no word. `new` holds the words that came since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self) + 1
        self.new.append(word)
        return row


def _ids(vocabulary: _Vocabulary, text: str | None) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))


@dataclass
class Network:
    embeddings: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    #: the score is sigmoid(scale * output + shift)
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
        e[0] = 0
        filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(e, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), -2.0)

    def shares(self, buckets: np.ndarray) -> np.ndarray:
        """What words add to each filter at each of its places: (words, sum of widths, FILTERS)."""
        out = np.empty((len(buckets), sum(WIDTHS), FILTERS), np.float32)
        for at in range(0, len(buckets), 16_384):
            x = self.embeddings[buckets[at : at + 16_384]].sum(axis=1)
            for k, place in enumerate(f[j] for f in self.filters for j in range(len(f))):
                out[at : at + 16_384, k] = x @ place
        return out

    def pooled(self, shares: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maximum of each filter over each text, and the filters at all places. Texts in `ids` end in two zeros, at
        which a filter sees nothing: neither does it there see the next text."""
        n, at, maxima, places, gaps = len(ids), 0, [], [], ids == 0
        for w, bias in zip(WIDTHS, self.biases):
            conv = shares[ids, at]
            for j in range(1, w):
                conv[: n - j] += shares[ids[j:], at + j]
            conv[gaps] = 0
            at += w
            places.append(conv)
            maxima.append(np.maximum(np.maximum.reduceat(conv, starts, axis=0) + bias, 0))
        return np.concatenate(maxima, axis=1), places

    def maxima(self, shares: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The maxima of `pooled` from PLACES at a time, so that memory does not go by the length of texts."""
        n, at, out = len(ids), 0, []
        for w, bias in zip(WIDTHS, self.biases):
            top = np.full((len(starts), FILTERS), -np.inf, np.float32)
            for a in range(0, n, PLACES):
                b = min(a + PLACES, n)
                conv = shares[ids[a:b], at]
                for j in range(1, w):
                    conv[: max(n - j - a, 0)] += shares[ids[a + j : b + j], at + j]
                conv[ids[a:b] == 0] = 0
                # the text that the part begins in, and those that begin within it
                first, last = np.searchsorted(starts, (a, b - 1), "right") - 1
                own = np.r_[0, starts[first + 1 : last + 1] - a]
                top[first : last + 1] = np.maximum(top[first : last + 1], np.maximum.reduceat(conv, own, axis=0))
            at += w
            out.append(np.maximum(top + bias, 0))
        return np.concatenate(out, axis=1)


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each with two zeros after it, and their starts."""
    gap = np.zeros(2, np.int32)
    starts = np.cumsum([0] + [len(t) + 2 for t in texts])[:-1]
    return np.concatenate([x for t in texts for x in (t, gap)]), starts


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """Adagrad over mini-batches. `buckets` has the features of each word, row 0 for no word."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed + 1)
    net.out_bias = float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    seen = [np.full_like(p, 1e-6) for p in (net.embeddings, *net.filters, *net.biases, net.out)]
    bias_seen = 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            ids, starts = _laid([texts[i] for i in rows])
            words, local = np.unique(ids, return_inverse=True)
            own = buckets[words]
            x = net.embeddings[own].sum(axis=1)
            shares = np.stack([x @ f[j] for f in net.filters for j in range(len(f))], axis=1)
            top, places = net.pooled(shares, local, starts)
            error = (_sigmoid(top @ net.out + net.out_bias) - labels[rows]) / len(rows)
            back = np.outer(error, net.out) * (top > 0)
            grad_out = top.T @ error + L2 * net.out
            grad_x, grad_f, grad_b = np.zeros_like(x), [np.zeros_like(f) for f in net.filters], []
            ends = np.r_[starts[1:], len(ids)]
            for k, (w, conv) in enumerate(zip(WIDTHS, places)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad_b.append(g.sum(axis=0))
                for d in np.flatnonzero(np.abs(g).max(axis=1) > 0):
                    best = starts[d] + conv[starts[d] : ends[d]].argmax(axis=0)
                    for j in range(w):
                        place = np.minimum(best + j, len(ids) - 1)
                        some = np.where(local[best] == 0, 0, local[place])
                        grad_f[k][j] += (x[some] * g[d][:, None]).T
                        np.add.at(grad_x, some, (net.filters[k][j] * g[d]).T)
            for p, s, g in zip((*net.filters, *net.biases, net.out), seen[1:], (*grad_f, *grad_b, grad_out)):
                s += g * g
                p -= RATE * g / np.sqrt(s)
            bias_seen += float(error.sum()) ** 2
            net.out_bias -= RATE * float(error.sum()) / np.sqrt(bias_seen)
            moved = np.flatnonzero(np.abs(grad_x).max(axis=1) > 0)
            if len(moved):
                rows_, inverse = np.unique(own[moved], return_inverse=True)
                g = np.zeros((len(rows_), DIMS), np.float32)
                np.add.at(g, inverse.reshape(-1), np.repeat(grad_x[moved], FEATURES, axis=0))
                seen[0][rows_] += g * g
                net.embeddings[rows_] -= RATE * g / np.sqrt(seen[0][rows_])
                net.embeddings[0] = 0
    return net


def _outputs(net: Network, shares: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(texts))
    for at in range(0, len(texts), 64):
        ids, starts = _laid(texts[at : at + 64])
        out[at : at + 64] = net.maxima(shares, ids, starts) @ net.out + net.out_bias
    return out


def _outputs_of(net: Network, buckets: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """_outputs with the shares of a few texts' words at a time."""
    out = np.zeros(len(texts))
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        words, local = np.unique(np.concatenate([np.zeros(1, np.int32), *part]), return_inverse=True)
        cuts = np.cumsum([1, *map(len, part)])
        out[at : at + 64] = _outputs(net, net.shares(buckets[words]), [local[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])])
    return out


def _best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The middle of the gap below the lowest accepted score at the largest F1; the highest such gap on ties."""
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + label.sum())
    k = int(np.argmax(f1))
    below = score[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(np.clip((score[order[k]] + below) / 2, 0.05, 0.95))


def calibrate(net: Network, output: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
    """Scale and shift of the output by logistic regression, then a threshold for each language with toxic rows.

    The regression is held near scale 1 and shift 0, so few rows move it little.
    """
    if 0 < labels.sum() < len(labels):
        a, b = 1.0, 0.0
        for _ in range(200):
            p = _sigmoid(a * output + b)
            e = p - labels
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * output * output).sum() + 1.0, (w * output).sum()], [(w * output).sum(), w.sum() + 1.0]])
            step = np.linalg.solve(h, np.array([(e * output).sum() + (a - 1.0), e.sum() + b]))
            a, b = float(np.clip(a - step[0], 0.2, 5.0)), float(np.clip(b - step[1], -5, 5))
        net.scale, net.shift = a, b
    score = _sigmoid(net.scale * output + net.shift)
    shrunk = lambda own, n, common: (n * own + SHRINK * common) / (n + SHRINK)
    n = float(labels.sum())
    common = shrunk(_best_threshold(score, labels), n, THRESHOLD) if n else THRESHOLD
    known = np.array([x or "" for x in langs])
    for lang in np.unique(known).tolist():
        some = known == lang
        n = float(labels[some].sum())
        if lang and n:
            net.thresholds[lang] = shrunk(_best_threshold(score[some], labels[some]), n, common)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Network:
    """Learn from labelled documents that are not held out. Null labels count as no label; without rows the score is 0.5
    of an untrained network's constant."""
    marks = (
        labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    )
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang")).where(
        ~held_out(F.col("id")) & (F.length("text") <= SAMPLE_LONGEST)
    )
    # labelled ids by language, and their mean length; languages share the sample evenly, and what one leaves goes to the others
    lengths = rows.select("id", "lang", F.length("text").alias("chars")).join(marks, "id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("chars").alias("mean"))
    sizes = {r["lang"]: (r["n"], r["mean"]) for r in lengths.collect()}
    if not sizes:
        net = Network.fresh()
        net.out = np.zeros_like(net.out)
        return net
    shares = _sample_shares(sizes, sample_rows, sample_chars)
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) / 1e6
    share = F.lit(shares.get(None, 0.0))
    for lang, x in shares.items():
        if lang is not None:
            share = F.when(F.col("lang") == lang, F.lit(x)).otherwise(share)
    # about sample_rows ids at most, so these go to the texts
    drawn = rows.select("id", "lang").join(marks, "id").where(part < share).select("id", "toxic").distinct()
    drawn = rows.join(F.broadcast(drawn), "id").where(part < share)
    bound_batches(docs.sparkSession)
    sample = drawn.select(F.col("id").cast("string").alias("id"), (F.col("toxic") != 0).cast("int").alias("toxic"), "lang", "text").mapInArrow(_hashed, "id string, toxic int, lang string, words binary, known binary")
    # each network is one task's work, over the whole sample, which is bounded
    copies = checkpointed(sample).withColumn("net", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
    rows = copies.repartitionByRange(FOLDS + 1, "net").groupBy("net").applyInArrow(_trained_on, _TRAINED).collect()
    if not rows:
        net = Network.fresh()
        net.out = np.zeros_like(net.out)
        return net
    net = next(pickle.loads(r["network"]) for r in rows if r["network"] is not None)  # noqa: S301
    scored_rows = sorted((x for r in rows for x in zip(r["place"], r["output"], r["label"], r["lang"])), key=lambda x: x[0])
    _, output, y, langs = zip(*scored_rows)
    calibrate(net, np.array(output), np.array(y, np.float32), list(langs))
    return net


_TRAINED = "network binary, place array<int>, output array<double>, label array<float>, lang array<string>"


def _trained_on(key: tuple, sample: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_trained for batches as they come, of which none stays beside what is learned from."""
    yield from _trained(key, sample).to_batches()


def _trained(key: tuple, sample: pa.Table | Iterator[pa.RecordBatch]) -> pa.Table:
    """For a fold's number, the outputs of a network that learned from the other folds, with the rows' places in the order
    of ids; for the number after these, the network that learned from all rows."""
    with worker_memory():
        number = key[0].as_py()
        texts, y, langs, fold, buckets = _learnable(sample)
        kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float32()), pa.list_(pa.string()))
        made = lambda *row: pa.table([pa.array([x], t) for x, t in zip(row, kinds)], ["network", "place", "output", "label", "lang"])
        if number == FOLDS:
            return made(pickle.dumps(train(texts, y, buckets)), [], [], [], [])
        rest = fold == number
        if not rest.any():
            return made(None, [], [], [], [])
        net = train([t for t, r in zip(texts, rest) if not r], y[~rest], buckets) if not rest.all() else Network.fresh()
        output = _outputs_of(net, buckets, [t for t, r in zip(texts, rest) if r])
        return made(None, np.flatnonzero(rest), output, y[rest], [x for x, r in zip(langs, rest) if r])


#: A word's hash and the buckets of its features.
_KNOWN = np.dtype([("word", "<u4"), ("features", "<u2", FEATURES)])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, text, becomes the hashes of its words, and with them the features of words that are new to the task."""
    seen: dict[str, int] = {}
    with worker_memory():
        for b in batches:
            words, known = [], []
            for text in b.column(3).to_pylist():
                new, ids = [], []
                for w in text.lower().split():
                    x = seen.get(w)
                    if x is None:
                        x = seen[w] = zlib.crc32(w.encode())
                        new.append((x, tuple(features(w))))
                    ids.append(x)
                words.append(np.array(ids, "<u4").tobytes())
                known.append(np.array(new, _KNOWN).tobytes())
            yield pa.record_batch([*b.columns[:3], pa.array(words, pa.binary()), pa.array(known, pa.binary())], ["id", "toxic", "lang", "words", "known"])


def _first_of_words(known: list[np.ndarray]) -> np.ndarray:
    """One entry for each word, sorted by word; words of one hash go by their first features, so that the order of tasks has no
    part in it."""
    found = np.concatenate(known)
    key = (found["word"].astype(np.uint64) << np.uint64(32)) | (found["features"][:, 0].astype(np.uint64) << np.uint64(16)) | found["features"][:, 1]
    found = found[np.argsort(key)]
    del key
    return found[np.r_[True, found["word"][1:] != found["word"][:-1]][: len(found)]]


def _learnable(sample: pa.Table | Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, list[str | None], np.ndarray, np.ndarray]:
    """Texts as row numbers of the buckets, labels, languages, folds, and the buckets of each word, in the order of ids."""
    known, new, rows = np.zeros(0, _KNOWN), [], []
    for b in sample.to_batches() if isinstance(sample, pa.Table) else sample:
        new += [np.frombuffer(k.as_buffer(), _KNOWN).copy() for k in b["known"]]
        words = [np.frombuffer(w.as_buffer(), "<u4").copy() for w in b["words"]]
        rows += zip(b["id"].to_pylist(), words, b["toxic"].to_pylist(), b["lang"].to_pylist())
        if sum(map(len, new)) > KNOWN_AT_ONCE:
            known, new = _first_of_words([known, *new]), []
    known = _first_of_words([known, *new])
    new.clear()
    for _, words, _, _ in rows:  # in place
        words[:] = np.searchsorted(known["word"], words) + 1
    buckets = np.zeros((len(known) + 1, FEATURES), np.uint16)
    buckets[1:] = known["features"]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes() if len(r[1]) < 1000 else b""))
    fold = np.array([zlib.crc32(f"calibrate:{r[0]}".encode()) % FOLDS for r in rows])
    return [r[1].view(np.int32) for r in rows], np.array([r[2] for r in rows], np.float32), [r[3] for r in rows], fold, buckets


def _sample_shares(sizes: dict[str | None, tuple[int, float]], sample_rows: int, sample_chars: int) -> dict[str | None, float]:
    """The share of each language's rows (number, mean length) to draw: the smallest languages whole, the others alike in rows and characters."""
    out, left_rows, left_chars = {}, float(sample_rows), float(sample_chars)
    for k, (lang, (n, mean)) in enumerate(sorted(sizes.items(), key=lambda x: (x[1][0], x[0] or ""))):
        others = len(sizes) - k
        out[lang] = min(1.0, left_rows / others / n, left_chars / others / max(n * mean, 1))
        left_rows, left_chars = left_rows - out[lang] * n, left_chars - out[lang] * n * mean
    return out


class Scorer:
    """Scores texts in a worker, with each word's shares kept."""

    def __init__(self, net: Network):
        self.net = net
        # filled from the front, again and again; memory is there once it is filled
        self.shares = np.zeros((CACHE_WORDS * 4 // 3, sum(WIDTHS), FILTERS), np.float32)
        self._clear()

    def _clear(self) -> None:
        self.vocabulary = _Vocabulary()
        self.filled = 1

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 64):
            if len(self.vocabulary) > CACHE_WORDS:
                self._clear()
            ids = [_ids(self.vocabulary, t) for t in texts[at : at + 64]]
            if new := self.vocabulary.new:
                need = self.filled + len(new)
                if need > len(self.shares):
                    self.shares = np.concatenate([self.shares, np.zeros((max(need - len(self.shares), len(self.shares) // 2), *self.shares.shape[1:]), np.float32)])
                self.shares[self.filled : need] = self.net.shares(np.array(list(map(features, new)), np.int32))
                self.filled = need
                new.clear()
            out[at : at + 64] = _outputs(self.net, self.shares, ids)
        return _sigmoid(self.net.scale * out + self.net.shift)


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, rejected: one row for each row of `docs`, from its whole text.

    `predicted` is 1 from a score of 0.3 on. `rejected` goes by the threshold of the row's language, which has no part
    in the score; null languages and those without toxic labels have the threshold 0.3. Null and empty texts have the score of no
    words. Null ids count as held out. An empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with worker_memory():
            scorer = Scorer(shared.value)
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang": b["lang"], "score": scorer.scores(b["text"].tolist())})

    found = rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang string, score double")
    return (
        found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
        .withColumn("threshold", _threshold(net, F.col("lang")))
        .withColumn("rejected", F.col("score") >= F.col("threshold"))
        .drop("lang")
    )


def _threshold(net: Network, lang: Column) -> Column:
    out = F.lit(THRESHOLD)
    for known, t in sorted(net.thresholds.items()):
        out = F.when(lang == known, F.lit(t)).otherwise(out)
    return out


def drop_toxic(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without the rows that the classifier rejects, all columns as they were; rows with null and empty texts stay
    or go by the score of no words. No row moves: the score is a filter on the scan."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with worker_memory():
            scorer = Scorer(shared.value)
            for t in texts:
                yield pd.Series(scorer.scores(t.tolist()))

    return docs.where(score(F.col(text_col)) < _threshold(net, F.col(lang_col)))
