"""Removal of word runs that also occur in an earlier document.

Suffixes of texts are split into groups of a size that fits in memory, and each group is searched as one sparse suffix
tree, cut at the depth of a window: its internal nodes at that depth are the repeats, and repeats that follow each other
in a text make up a maximal one. What names the group of a suffix is not its first words but the run of GROUP words in
its window with the smallest hash. So equal windows meet in one group wherever they stand, neighbouring suffixes mostly
share their group, and one row carries the words of several suffixes once; under their own first words each suffix would
carry all of its words. Groups that a sample shows to be large are split by all words of the window.

Rows of a batch that fall into one group are packed together: where they stand, and their words, compressed. Nodes are
found by hashes of their words and confirmed by the words themselves, so what is removed is a repeat in any case.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches
from plexweave.llm.words import line_hashes, mixed, rolling, split

#: Words of a window.
WINDOW = 13
#: Words of the run that names a group of suffixes.
GROUP = 3
#: Suffixes of a group, about; runs that name more than a quarter of that are split.
TARGET = 600_000
#: Sizes are estimated from one document in so many; they only set how groups are split.
SAMPLED = 64
#: Fewest groups.
LEAST_GROUPS = 8
_LAST = (1 << 63) - 1


def _planes(a: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones: small values then compress well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


class Places:
    """Runs of `size` windows from word `at` on in documents, each told by its id and a checksum of its text."""

    def __init__(self, doc: np.ndarray, tag: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.doc, self.tag, self.at, self.size = doc, tag, at, size

    def take(self, some: np.ndarray) -> Places:
        return Places(self.doc[some], self.tag[some], self.at[some], self.size[some])

    def pack(self) -> bytes:
        """As bytes; runs of a document should stand together, in order."""
        n = len(self.doc)
        heads = np.flatnonzero(np.r_[True, (self.doc[1:] != self.doc[:-1]) | (self.tag[1:] != self.tag[:-1])][:n])
        gap = np.diff(self.at, prepend=0)
        gap[heads] = self.at[heads]
        parts = (self.doc[heads], self.tag[heads].astype(np.uint32), np.diff(np.r_[heads, n]).astype(np.uint32), gap.astype(np.int32), self.size.astype(np.uint8))
        return np.array([n, len(heads)], np.uint32).tobytes() + b"".join(map(_planes, parts))

    @classmethod
    def unpack(cls, data: bytes) -> Places:
        n, d = np.frombuffer(data, np.uint32, 2).tolist()
        at, out = 8, []
        for count, kind in ((d, np.int64), (d, np.uint32), (d, np.uint32), (n, np.int32), (n, np.uint8)):
            width = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, count * width, at).reshape(width, count).T).view(kind).ravel())
            at += count * width
        doc, tag, runs, gap, size = out
        place = np.cumsum(gap.astype(np.int64))
        heads = np.cumsum(runs.astype(np.int64)) - runs
        if d:
            place -= np.repeat(place[heads] - gap[heads], runs)
        return cls(np.repeat(doc, runs), np.repeat(tag, runs), place, size)

    @classmethod
    def join(cls, parts: list[Places]) -> Places:
        return cls(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("doc", "tag", "at", "size")))


def _group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return ((key >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)


def _bucket(doc: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    return _group_of(mixed(mixed(doc.astype(np.int64).view(np.uint64)) ^ tag.astype(np.uint64)), buckets)


def _record(rows: list[tuple[int, int, bytes, bytes | None]]) -> pa.RecordBatch:
    bucket, kind, places, words = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(places, pa.binary()), pa.array(words, pa.binary())], ["bucket", "kind", "places", "words"])


def _hit_rows(hits: Places, buckets: int) -> list[tuple[int, int, bytes, None]]:
    """`hits` by the bucket of their document, as rows of kind 0."""
    bucket = _bucket(hits.doc, hits.tag, buckets)
    order = np.lexsort((hits.at, hits.tag, hits.doc, bucket))
    cuts = np.flatnonzero(np.r_[True, bucket[order[1:]] != bucket[order[:-1]]][: len(order)]).tolist()
    return [(int(bucket[order[a]]), 0, hits.take(order[a:b]).pack(), None) for a, b in zip(cuts, [*cuts[1:], len(order)])]


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, groups: int, large: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, places, words) of (doc, text): kind 1 has suffixes of group `bucket` with their words.

    Suffixes whose words a smaller document of the batch has just so are hits already, so a passage that very many
    documents share comes about once from each batch.
    """
    span = window - GROUP + 1
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        docs, tags, ats, sizes, keys, lines = [], [], [], [], [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = split(text)
            n = len(words) - window + 1
            if n < 1:
                continue
            line = b" ".join(words)
            hashed, starts, stops = line_hashes(line)
            runs = rolling(hashed, GROUP)
            least = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(n)
            heads = np.r_[True, least[1:] != least[:-1]]
            apart = np.isin(runs[least], large) if len(large) else np.zeros(n, bool)
            first = np.flatnonzero(heads | apart)
            keys.append(np.where(apart[first], mixed(rolling(hashed, window)[first]), mixed(runs[least[first]])))
            ends = np.r_[first[1:], n]
            lines += [line[x:y] for x, y in zip(starts[first].tolist(), stops[ends + window - 2].tolist())]
            docs.append(np.full(len(first), doc, np.int64))
            tags.append(np.full(len(first), zlib.crc32(text.encode()), np.uint32))
            ats.append(first)
            sizes.append(ends - first)
        if not lines:
            continue
        places = Places(*map(np.concatenate, (docs, tags, ats, sizes)))
        group = _group_of(np.concatenate(keys), groups)
        same = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
        order = np.lexsort((places.doc, same))
        heads = np.flatnonzero(np.r_[True, same[order[1:]] != same[order[:-1]]])
        owner = np.empty(len(lines), np.int64)
        owner[order] = np.repeat(order[heads], np.diff(np.r_[heads, len(order)]))
        known = np.zeros(len(lines), bool)
        for k in np.flatnonzero(places.doc > places.doc[owner]).tolist():
            known[k] = lines[k] == lines[owner[k]]
        rows = _hit_rows(places.take(known), groups)
        rest = np.flatnonzero(~known)
        rest = rest[np.argsort(group[rest], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, group[rest[1:]] != group[rest[:-1]]][: len(rest)]).tolist()
        for x, y in zip(cuts, [*cuts[1:], len(rest)]):
            some = rest[x:y]
            rows.append((int(group[some[0]]), 1, places.take(some).pack(), squeeze.compress(b"\n".join(lines[k] for k in some.tolist()))))
        yield _record(rows)


def _repeats(places: Places, texts: list[bytes], window: int) -> Places:
    """The hits among the suffixes of one group, whose words are in `texts`: windows that a smaller document has too."""
    data = b"\n".join(texts)
    hashed, starts, ends = line_hashes(data)
    size = places.size.astype(np.int64)
    lengths = size + window - 1
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    word = (np.cumsum(lengths) - lengths)[row] + place
    node, doc = rolling(hashed, window)[word], places.doc[row]
    order = np.lexsort((doc, node))
    heads = np.flatnonzero(np.r_[True, node[order[1:]] != node[order[:-1]]][: len(order)])
    counts = np.diff(np.r_[heads, len(order)])
    owner = np.empty(len(order), np.int64)
    owner[order] = np.repeat(order[heads], counts)
    hit = doc > doc[owner]
    # windows that follow each other, and so do their owners, are compared at once
    likely = np.flatnonzero(hit)
    if len(likely):
        follows = (np.diff(likely) == 1) & (np.diff(row[likely]) == 0) & (np.diff(word[owner[likely]]) == 1) & (np.diff(row[owner[likely]]) == 0)
        first = likely[np.r_[True, ~follows]]
        last = likely[np.r_[~follows, True]]
        words = lambda k: data[starts[word[k]] : ends[word[k] + window - 1]]
        wrong = []
        spans = (starts[word[first]], ends[word[last] + window - 1], starts[word[owner[first]]], ends[word[owner[last]] + window - 1])
        for k, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in spans))):
            if data[a:b] != data[c:d]:
                wrong += [i for i in range(first[k], last[k] + 1) if words(i) != words(owner[i])]
        if wrong:  # hashes that collide: the leaves of these nodes are told apart by their words
            number = np.empty(len(order), np.int64)
            number[order] = np.repeat(np.arange(len(heads)), counts)
            for k in np.unique(number[wrong]).tolist():
                least: dict[bytes, int] = {}
                for i in order[heads[k] : heads[k] + counts[k]].tolist():  # in the order of doc
                    hit[i] = doc[i] > least.setdefault(words(i), int(doc[i]))
    found = np.flatnonzero(hit)
    if not len(found):
        return places.take(found)
    new = np.r_[True, (np.diff(found) != 1) | (np.diff(row[found]) != 0)]
    first = found[new]
    return Places(places.doc[row[first]], places.tag[row[first]], places.at[row[first]] + place[first], np.diff(np.r_[np.flatnonzero(new), len(found)]))


def _trees(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 for the hits, of rows sorted by bucket; hits that are known already pass through."""
    group, places, texts = None, [], []
    expand = zstandard.ZstdDecompressor()

    def solved() -> pa.RecordBatch:
        hits = _repeats(Places.join(places), texts, window)
        return _record(_hit_rows(hits, buckets))

    for b in batches:
        for bucket, kind, data, words in zip(*(c.to_pylist() for c in b.columns)):
            if kind == 0:
                yield _record([(bucket, 0, data, None)])
                continue
            if bucket != group and places:
                yield solved()
                places, texts = [], []
            group = bucket
            places.append(Places.unpack(data))
            texts.append(expand.decompress(words))
    if places:
        yield solved()


def _texts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, kind 1, doc_id, places: none, words: the text) of (doc, text, doc_id)."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        made = [(t or "").encode() for t in b.column(1).to_pylist()]
        tags = np.array([zlib.crc32(t) for t in made], np.uint32)
        bucket = _bucket(b.column(0).to_numpy(), tags, buckets).astype(np.int32)
        arrays = [pa.array(bucket), pa.array(np.ones(len(made), np.int32)), b.column(2), pa.nulls(len(made), pa.binary()), pa.array([squeeze.compress(t) for t in made], pa.binary())]
        yield pa.record_batch(arrays, ["bucket", "kind", "doc_id", "places", "words"])


def covered(n: int, at: np.ndarray, size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words the windows from `at` on, `size` in a row each, cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size + (window - 1), -1)
    return np.cumsum(edge[:n]) > 0


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[int | None, list[bytes], np.ndarray]]:
    """Each document of rows sorted by bucket and kind: its id, its words, and which of them hits cover."""
    group, found = None, {}
    expand = zstandard.ZstdDecompressor()
    for b in batches:
        for bucket, kind, doc_id, data, text in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != group:
                group, found = bucket, {}
            if kind == 0:
                p = Places.unpack(data)
                heads = np.flatnonzero(np.r_[True, (p.doc[1:] != p.doc[:-1]) | (p.tag[1:] != p.tag[:-1])][: len(p.doc)]).tolist()
                for x, y in zip(heads, [*heads[1:], len(p.doc)]):
                    found.setdefault((int(p.doc[x]), int(p.tag[x])), []).append((p.at[x:y], p.size[x:y].astype(np.int64)))
                continue
            raw = expand.decompress(text) if text else b""
            words = raw.split()
            hits = found.get((_LAST if doc_id is None else doc_id, zlib.crc32(raw)))
            gone = covered(len(words), *map(np.concatenate, zip(*hits)), window) if hits else np.zeros(len(words), bool)
            yield doc_id, words, gone


def _large_runs(rows: DataFrame, window: int) -> tuple[int, np.ndarray]:
    """The number of windows, and the hashes of the runs that name more than TARGET / 4 of them, by a sample of documents."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = window - GROUP + 1
        for b in batches:
            keys = [np.zeros(0, np.uint64)]
            for text in b.column(1).to_pylist():
                words = split(text)
                if len(words) >= window:
                    runs = rolling(line_hashes(b" ".join(words))[0], GROUP)
                    keys.append(np.lib.stride_tricks.sliding_window_view(runs, span).min(axis=1))
            run, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.record_batch([pa.array(run.view(np.int64)), pa.array(n)], ["run", "n"])

    part = rows.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).select("doc", "text")
    counted = part.mapInArrow(sizes, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))
    # there are few large runs, as each names so many windows
    marked = counted.agg(F.sum("n").alias("total"), F.collect_list(F.when(F.col("n") * SAMPLED > TARGET // 4, F.col("run"))).alias("large")).first()
    return (marked["total"] or 0) * SAMPLED, np.array(marked["large"], np.int64).view(np.uint64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and doc, the id or the largest long for null."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))


def with_kept(docs: DataFrame, columns: Callable[[list[bytes], np.ndarray], tuple], schema: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id and what `columns`, given a document's words and which of them are repeats, makes of it."""
    if not GROUP < window <= GROUP + 200:
        raise ValueError(f"a window has {GROUP + 1} to {GROUP + 200} words")
    bound_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    total, large = _large_runs(rows, window)
    groups = max(LEAST_GROUPS, -(-total // TARGET))
    columns_of = "bucket int, kind int, places binary, words binary"
    suffixes = rows.select("doc", "text").mapInArrow(lambda batches: _suffixes(batches, window, groups, large), columns_of)
    hits = suffixes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _trees(batches, window, groups), columns_of)
    texts = rows.select("doc", "text", "doc_id").mapInArrow(lambda batches: _texts(batches, groups), "bucket int, kind int, doc_id long, places binary, words binary")
    both = texts.unionByName(hits.withColumn("doc_id", F.lit(None).cast("long")))
    out = f"doc_id long, {schema}"
    types = [f.dataType for f in docs.sparkSession.createDataFrame([], out).schema]
    names = [f.name for f in docs.sparkSession.createDataFrame([], out).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        made: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), to_arrow_type(t)) for c, t in zip(zip(*made), types)], names)

        held = 0
        for doc_id, words, gone in _kept(batches, window):
            made.append((doc_id, *columns(words, gone)))
            held += len(words)
            if len(made) >= 1000 or held > 500_000:
                yield batch()
                made, held = [], 0
        if made:
            yield batch()

    return both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, out)


def kept_words(words: list[bytes], gone: np.ndarray) -> list[bytes]:
    return [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text: each text without the words of windows that start in an earlier document too.

    Kept words are joined by one space. Null and empty texts have no words and give an empty text; texts shorter than
    a window stay whole. Documents of one id do not count as earlier than each other. Rows with a null id come after
    all others. An empty table gives an empty result; other columns are not read.
    """

    def columns(words: list[bytes], gone: np.ndarray) -> tuple:
        return len(words), int(gone.sum()), b" ".join(kept_words(words, gone)).decode()

    return with_kept(docs, columns, "n_words long, n_removed long, text string", id_col, text_col, window)


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, repeats array<struct<start, n_words>>: the stretches of each text that windows of earlier documents cover."""

    def columns(words: list[bytes], gone: np.ndarray) -> tuple:
        edges = np.diff(np.r_[0, gone.astype(np.int8), 0])
        return ([{"start": a, "n_words": b - a} for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())],)

    return with_kept(docs, columns, "repeats array<struct<start: long, n_words: long>>", id_col, text_col, window)
