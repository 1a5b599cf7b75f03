"""Spelling variants: words that differ by one code point, found in shards of tries, and the form that each stands for.

Runs of letters are counted by document and then by task, so only sums are shuffled. The words are dealt out by ranges
and written as shards of a bounded number of words: a trie of these and a trie of the same words read backwards, in
which a word that no longer shares its begin with another is a leaf with the rest of its letters. Shards are broadcast,
so many at a time as fit a bounded number of bytes; each task takes its words through every shard, depth first, with
the automaton that accepts what is one edit away. An edit leaves one half of a word as it is: so the automaton takes
the first half without an edit in the forward trie, and the second half in the other, and branches only beyond. What
the rounds find is summed, and the best form is the least of a pair of keys. At last forms are followed to their ends
by joins that double their reach.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import Scratch, bound_batches

#: Letters, all of which Latin-1 has as one byte.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words have so many code points and occurrences at least.
LEAST_LETTERS, LEAST_TIMES = 7, 2
#: A form is so many times as frequent as the word at least.
RATIO = 10
#: One in so many runs of a document, by a hash, loses a code point.
DAMAGE = 31
#: A task sends its counts on when it holds so many words or letters.
HELD_WORDS, HELD_LETTERS = 200_000, 4_000_000
#: A shard has at most so many words, and so many letters but for one word; a round broadcasts at most so many bytes of
#: shards, but for one shard. A task searches about so many words.
SHARD_WORDS, SHARD_LETTERS, ROUND_BYTES = 250_000, 4_000_000, 48_000_000
TASK_WORDS = 20_000


def damaged(doc_id: str, run: str) -> str:
    """The lower-cased run, or for one in DAMAGE by a hash of both the run without one code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    gone = h % len(run)
    return run[:gone] + run[gone + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], damage: bool, least: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    letters = 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            lowered = text.encode().lower().decode()  # A-Z only
            for run, n in Counter(RUN.findall(lowered)).items():
                if len(run) < least:
                    continue
                word = damaged(doc_id or "", run) if damage else run
                if len(word) >= least:
                    if word not in held:
                        letters += len(word)
                    held[word] += n
            if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                yield batch()
                held.clear()
                letters = 0
    if held:
        yield batch()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = True, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """word, n: how often each lower-cased run of letters occurs in whole texts, of those long and frequent enough.

    With `damage` one run in DAMAGE loses a code point, by the crc32 of its document's id and itself. Null and empty
    texts have no words; a null id counts as an empty one; repeated rows count each time. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(lambda batches: _counted(batches, damage, least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


class Trie:
    """A trie over sorted words.

    A node stands for a begin that two words share at least. Its children lie at first[node] to first[node + 1] in
    `labels` (a byte each) and `child`: a node, or -1 - k where only word k goes on that way. `ends` has the word that
    ends at a node, or -1. Letters of a leaf beyond its label are read from the word itself.
    """

    KINDS = "Iiii"

    def __init__(self, words: list[bytes]):
        first, labels, child, ends = array("i"), bytearray(), array("i"), array("i")
        lows, highs, depths = array("i", [0]), array("i", [len(words)]), array("i", [0])
        node = 0
        while node < len(lows):  # nodes by their depth
            low, high, depth = lows[node], highs[node], depths[node]
            node += 1
            first.append(len(labels))
            own = low < high and len(words[low]) == depth
            ends.append(low if own else -1)
            low += own
            while low < high:
                letter = words[low][depth]
                # the first word that goes on with a later letter
                top = high if words[high - 1][depth] == letter else bisect_left(words, letter + 1, low, high, key=lambda w: w[depth])  # noqa: B023
                labels.append(letter)
                if top - low == 1:
                    child.append(-1 - low)
                else:
                    child.append(len(lows))
                    lows.append(low)
                    highs.append(top)
                    depths.append(depth + 1)
                low = top
        first.append(len(labels))
        offsets = array("I", [0])
        for w in words:
            offsets.append(offsets[-1] + len(w))
        self.numbers, self.labels, self.blob = (offsets, first, child, ends), bytes(labels), b"".join(words)
        self.offsets, self.first, self.child, self.ends = self.numbers

    def pack(self) -> bytes:
        head = struct.pack("<6q", len(self.blob), len(self.labels), *map(len, self.numbers))
        return b"".join((head, *(x.tobytes() for x in self.numbers), self.labels, self.blob))

    @classmethod
    def unpack(cls, data: bytes) -> Trie:
        n_blob, n_labels, *sizes = struct.unpack_from("<6q", data)
        view, at, trie = memoryview(data), 48, cls.__new__(cls)
        trie.numbers = []
        for n, kind in zip(sizes, cls.KINDS):
            trie.numbers.append(view[at : at + 4 * n].cast(kind))
            at += 4 * n
        trie.offsets, trie.first, trie.child, trie.ends = trie.numbers
        trie.labels, trie.blob = data[at : at + n_labels], data[at + n_labels : at + n_labels + n_blob]
        return trie

    def word(self, k: int) -> bytes:
        return self.blob[self.offsets[k] : self.offsets[k + 1]]

    def near(self, word: bytes, exact: int = 0) -> list[int]:
        """The words one edit away from `word` that have its first `exact` letters; it may be in the trie itself or not.

        The automaton's state after `depth` letters of the trie is a set of places in `word`, as bits: 1 stands for
        place `depth` with no edit yet; 2, 4 and 8 for places depth - 1, depth and depth + 1 after an inserted, a
        replaced and a deleted letter.
        """
        first, labels, child, ends, offsets, blob = self.first, self.labels, self.child, self.ends, self.offsets, self.blob
        node = 0
        for depth in range(exact):
            k = labels.find(word[depth], first[node], first[node + 1])
            if k < 0:
                return []
            node = child[k]
            if node < 0:
                only = self.word(-1 - node)
                return [-1 - node] if only.startswith(word[:exact]) and one_edit(only, word) else []
        m, found = len(word), []
        stack = [(node, exact, 1)]
        while stack:
            node, depth, state = stack.pop()
            rest = m - depth
            if ends[node] >= 0 and (state & 9 and rest == 1 or state & 2 and rest == -1 or state & 4 and rest == 0):
                found.append(ends[node])
            a, b = first[node], first[node + 1]
            back = word[depth - 1] if 0 < depth <= m else -1
            here = word[depth] if rest > 0 else -1
            ahead = word[depth + 1] if rest > 1 else -1
            if state & 1:
                ways = range(a, b)
            else:
                letters = {back} if state & 2 else set()
                if state & 4:
                    letters.add(here)
                if state & 8:
                    letters.add(ahead)
                ways = [k for c in letters if c >= 0 and (k := labels.find(c, a, b)) >= 0]
            for k in ways:
                c, new = labels[k], 0
                if state & 1:
                    new = 3 if c == here else 6 if rest > 0 else 2
                    if c == ahead:
                        new |= 8
                if state & 2 and c == back:
                    new |= 2
                if state & 4 and c == here:
                    new |= 4
                if state & 8 and c == ahead:
                    new |= 8
                to = child[k]
                if to >= 0:
                    stack.append((to, depth + 1, new))
                    continue
                start, end = offsets[-1 - to] + depth + 1, offsets[-to]
                longer = end - start - (m - depth - 1)  # letters of the leaf beyond those of the word
                if -2 < longer < 2:
                    tail = blob[start:end]
                    if (
                        new & 1 and one_edit(tail, word[depth + 1 :])
                        or new & 2 and longer == 1 and tail == word[depth:]
                        or new & 4 and longer == 0 and tail == word[depth + 1 :]
                        or new & 8 and longer == -1 and tail == word[depth + 2 :]
                    ):
                        found.append(-1 - to)
        return found


class Shard:
    """Sorted words with their counts, in a trie forwards and one backwards."""

    def __init__(self, words: list[bytes], counts: list[int]):
        backwards = [w[::-1] for w in words]
        self.order = array("i", sorted(range(len(words)), key=backwards.__getitem__))
        self.ahead, self.back = Trie(words), Trie([backwards[k] for k in self.order])
        self.counts = array("q", counts)

    def pack(self) -> bytes:
        parts = [self.counts.tobytes(), self.order.tobytes(), self.ahead.pack(), self.back.pack()]
        return struct.pack("<4q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        shard, at, parts = cls.__new__(cls), 32, []
        for n in struct.unpack_from("<4q", data):
            parts.append(data[at : at + n])
            at += n
        shard.counts, shard.order = memoryview(parts[0]).cast("q"), memoryview(parts[1]).cast("i")
        shard.ahead, shard.back = map(Trie.unpack, parts[2:])
        return shard

    def near(self, word: bytes) -> list[int]:
        """Places of the words one edit away: those with its first half, and those with its second half only."""
        half = len(word) // 2
        found, ahead = self.ahead.near(word, half), self.ahead
        for k in self.back.near(word[::-1], len(word) - half):
            if not ahead.word(self.order[k]).startswith(word[:half]):
                found.append(self.order[k])
        return found


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two strings differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of sorted words."""
    words: list[bytes] = []
    counts: list[int] = []
    letters = 0

    def shard() -> pa.RecordBatch:
        packed = Shard(words, counts).pack()
        return pa.record_batch([pa.array([words[0].decode("latin-1")]), pa.array([len(packed)], pa.int64()), pa.array([packed], pa.binary())], ["first", "size", "shard"])

    for b in batches:
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words.append(word.encode("latin-1"))
            counts.append(n)
            letters += len(word)
            if len(words) >= SHARD_WORDS or letters >= SHARD_LETTERS:
                yield shard()
                words, counts, letters = [], [], 0
    if words:
        yield shard()


def _searched(batches: Iterator[pa.RecordBatch], packed: list[bytes]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best_n, best: of the shards' words near each word, their number and the best one."""
    shards = [Shard.unpack(p) for p in packed]
    for b in batches:
        rows = []
        for word in b.column(0).to_pylist():
            own, near, best = word.encode("latin-1"), 0, None
            for shard in shards:
                found = shard.near(own)
                near += len(found)
                for k in found:
                    n = shard.counts[k]
                    if best is None or n > best[0] or n == best[0] and shard.ahead.word(k) < best[1]:
                        best = n, shard.ahead.word(k)
            if best:
                rows.append((word, near, best[0], best[1].decode("latin-1")))
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near, best_n, best: how many of `words` (word, n; distinct) are one edit away from each, and the most
    frequent of them, of equal ones the first; no row for a word without any."""
    spark = words.sparkSession
    bound_batches(spark)
    n = words.count()
    shards = scratch.keep(words.repartitionByRange(max(1, -(-n // SHARD_WORDS)), "word").sortWithinPartitions("word").mapInArrow(_sharded, "first string, size long, shard binary"))
    rounds: list[list[str]] = []
    room = 0
    for r in shards.select("first", "size").orderBy("first").collect():  # about a row for each 250,000 words
        if not rounds or r["size"] > room:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(r["first"])
        room -= r["size"]
    found = []
    for firsts in rounds:
        own = shards.where((F.col("first") >= firsts[0]) & (F.col("first") <= firsts[-1])).select("shard")
        shared = spark.sparkContext.broadcast([bytes(r["shard"]) for r in own.collect()])
        # dealt out by a hash, as words that lie together take alike long
        part = words.select("word").repartition(max(1, -(-n // TASK_WORDS)), F.xxhash64("word")).mapInArrow(lambda batches: _searched(batches, shared.value), "word string, n_near long, best_n long, best string")  # noqa: B023
        found.append(scratch.keep(part))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    summed = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return summed.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each of `words` (word, n; distinct).

    `form` is the near word with the largest n, of equal ones the smallest, if that is `ratio` times the word's n at
    least. `root` is where following forms from the word ends, itself without a form. No words give no rows.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.keep(words.select("word", "n"))
    near = near_words(words, scratch)
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = scratch.keep(joined.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    # n grows at least `ratio` times with each step, so no path is longer than this
    most, steps = rows.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0], 1
    while ratio**steps <= most:
        steps += 1
    links, reach = rows.where("form is not null").select("word", F.col("form").alias("root")), 1
    while reach < steps:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = scratch.keep(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variant_groups of the words of `docs`, with word_counts' reading of nulls, empty texts and repeated rows."""
    return variant_groups(word_counts(docs, id_col, text_col))
