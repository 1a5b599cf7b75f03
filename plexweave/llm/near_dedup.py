"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

A signature is a bottom-k sketch: the K smallest hashes of a document's shingles, so that of two documents each of the
K smallest of their union is in both signatures with their similarity for chance. Up to K shingles a signature holds
the whole set by itself, and what is said of it is exact; that matters for short documents, of which a shared line can
make up half, and needs no path of its own.

A document is posted under each of its coordinates. Two signatures with at least `need` coordinates in common must
share one among the rarest of either, as many as its size less `need` plus one; so only that prefix is posted.
Coordinates that occur once take up places of the prefix but need no posting, and a document with fewer than `need`
shared ones is skipped. What many unlike documents have in common (a line, a passage) is frequent and so falls out of
the prefixes. A posting tells how many rarer coordinates the document has: a pair that first meets in a list can have
no more in common than what is left of either from there on, so what has been edited too much to meet any size in a
list leaves it. Documents with equal shingle sets are one node and are posted once.

Large posting lists are not expanded: each list first links its members to one of them, its hub, which is a member
with few rarer coordinates, as an original has among its edited copies. What is then in one component needs no further
comparison. Where many are left in different components there are more rounds of hubs. Then the members of all lists
with one hub are compared in tiles of bounded size, which count the coordinates in common of all their pairs at once
and put out only those that have enough. Every such candidate is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import Scratch, bound_batches, worker_memory
from plexweave.llm.components import components
from plexweave.llm.words import hashes, mixed, rolling, split

#: Words of a shingle, and the similarity that links two documents.
SHINGLE, SIMILARITY = 5, Fraction(3, 4)
#: Signature length.
COORDINATES = 160
#: Standard deviations that a similar pair of documents beyond COORDINATES shingles may have fewer coordinates in common
#: than on average. At 4.2 a pair at 0.75 is missed less than once in 10,000.
SLACK = 4.2
#: Rounds of hubs end when the pairs left are at most so many times the postings, or after so many rounds.
PAIRS_PER_POSTING, HUB_ROUNDS = 1, 2
#: Documents of a tile, about.
TILE = 1024
#: Up to so many candidate ids (8 bytes each) are broadcast to pick out their texts; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000
#: Hubs are the best members of their lists in one of so many orders, so lists alike mostly have one of as many hubs.
HUB_ORDERS = 4


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = hashes().of(split(text, lower=True))
    if not len(words):
        return words
    return np.unique(rolling(words, min(size, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDINATES smallest of sorted distinct hashes."""
    return shingles[:COORDINATES]


def _slack(big: Column, similarity: Fraction) -> Column:
    """What a sample of COORDINATES of `big` shingles may lack; nothing where it is all of them."""
    s = float(similarity)
    return SLACK * F.sqrt(COORDINATES * s * (1 - s) * F.greatest(F.lit(0.0), 1 - COORDINATES / big))


def need_both(n: Column, m: Column, similarity: Fraction) -> Column:
    """Coordinates that documents of n and m shingles have in common if they are similar: exact for whole sets."""
    s, big = float(similarity), F.greatest(n, m)
    return F.ceil(s / (1 + s) * (n + m) * F.least(F.lit(1.0), COORDINATES / big) - _slack(big, similarity) - 1e-6)


def _enough(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """need_both of all pairs of sizes, and beyond reach where the sizes differ too much."""
    big, small = np.maximum(n[:, None], m), np.minimum(n[:, None], m)
    lacks = SLACK * np.sqrt(COORDINATES * similarity * (1 - similarity) * np.maximum(0.0, 1 - COORDINATES / big))
    least = np.ceil(similarity / (1 + similarity) * (big + small) * np.minimum(1.0, COORDINATES / big) - lacks - 1e-6)
    return np.where(small < similarity * big - 1e-6, np.inf, least)


def _tile(rows: pa.Table, similarity: float) -> pa.Table:
    """(a, b): pairs of `rows` (…, side, id, n, component, keys) in different components, with enough coordinates in common.

    Pairs are of both sides, or of all rows where there is one side only.
    """
    side, ids, n, component = (rows[c].to_numpy() for c in ("side", "id", "n", "component"))
    lists = rows["keys"].combine_chunks()
    owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    known, key, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = count[key] > 1
    owner, key = owner[several], (np.cumsum(count > 1) - 1)[key[several]]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(ids)),) * 2
    common = np.zeros((len(left), len(right)), np.float32)
    width = int((count > 1).sum())
    for at in range(0, width, 2048):
        some = (key >= at) & (key < at + 2048)
        has = np.zeros((len(ids), 2048), np.float32)
        has[owner[some], key[some] - at] = 1
        common += has[left] @ has[right].T
    hit = (common >= _enough(n[left], n[right], similarity)) & (component[left][:, None] != component[right])
    x, y = (ids[k[w]] for k, w in zip((left, right), np.nonzero(hit)))
    return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})


def need(n: Column, similarity: Fraction) -> Column:
    """Coordinates that a document of n shingles has in common with any similar one."""
    s = float(similarity)
    return F.ceil(F.least(s * n, s * COORDINATES - _slack(n / s, similarity)) - 1e-6)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, set1, set2, print, keys) of (doc_id, text, print): sizes, 128-bit digests of sets, signatures."""
    with worker_memory("words"):
        for b in batches:
            sizes, first, second, keys = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text)
                sizes.append(len(s))
                # order-free digests of the set
                first.append(mixed(s).sum(dtype=np.uint64))
                second.append(mixed(s + np.uint64(len(s))).sum(dtype=np.uint64))
                keys.append(signature(s).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            digests = [pa.array(np.array(d, np.uint64).view(np.int64)) for d in (first, second)]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), *digests, b.column(2), lists], ["doc_id", "n_shingles", "set1", "set2", "print", "keys"])


def _confirmed(batches: Iterator[pa.RecordBatch], numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text_a, text_b), the pairs linked by their full sets. Rows of one document mostly come together."""
    held: dict[int, np.ndarray] = {}

    def of(doc: int, text: str) -> np.ndarray:
        if doc not in held:
            if len(held) >= 64:
                held.clear()
            held[doc] = shingle_set(text)
        return held[doc]

    with worker_memory("words"):
        for batch in batches:
            out_a, out_b = [], []
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = of(a, text_a), of(b, text_b)
                if denominator * min(len(x), len(y)) < numerator * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if shared and denominator * shared >= numerator * (len(x) + len(y) - shared):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def prefix_postings(heads: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """key, id, n, before: each signature of `heads` (id, n, keys) under the rarest of its shared keys, as many as its
    prefix has, and how many of its keys are rarer."""
    posted = heads.select("id", "n", F.explode("keys").alias("key")).repartition("key")  # one exchange for both uses
    often = posted.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    shared = posted.join(often, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("shared"))
    least, lone = need(F.col("n"), similarity), F.least("n", F.lit(COORDINATES)) - F.size("shared")
    prefix = F.slice("shared", F.lit(1), (F.size("shared") - least + 1).cast("int"))
    found = shared.where(F.size("shared") >= least).select("id", "n", lone.alias("lone"), F.posexplode(prefix["key"]).alias("place", "key"))
    return found.select("key", "id", "n", (F.col("lone") + F.col("place")).alias("before"))


def _possible(n: Column, before: Column, m: Column, other_before: Column, similarity: Fraction) -> Column:
    """Whether documents of n and m shingles that first meet after so many of their coordinates can be similar enough."""
    left = F.least(F.least(n, F.lit(COORDINATES)) - before, F.least(m, F.lit(COORDINATES)) - other_before)
    alike = similarity.denominator * F.least(n, m) >= similarity.numerator * F.greatest(n, m)
    return alike & (left >= need_both(n, m, similarity))


def with_partners(posted: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The postings that have a member of a fitting size in their list."""
    sizes = posted.groupBy("key").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high")).where("members > 1")
    n, s = F.col("n"), float(similarity)
    left = F.least(n, F.lit(COORDINATES)) - F.col("before")
    # what a partner needs is least for the smallest or the largest that there may be
    least = F.least(need_both(n, F.greatest(F.col("low"), F.ceil(n * s)), similarity), need_both(n, F.least(F.col("high"), F.floor(n / s)), similarity))
    return posted.join(sizes, "key").where(left >= least).select(*posted.columns)


def _linked(pairs: DataFrame, signed: DataFrame, texts: DataFrame, similarity: Fraction, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are similar enough, as their coordinates in common tell where both signatures are whole
    sets, and else the full sets of their texts."""
    of = lambda x: signed.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}"))
    counted = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").withColumn("m", F.size(F.array_intersect("ka", "kb")))
    n, d = similarity.numerator, similarity.denominator
    whole = F.greatest("na", "nb") <= COORDINATES
    likely = F.when(whole, d * F.col("m") >= n * (F.col("na") + F.col("nb") - F.col("m"))).otherwise(F.col("m") >= need_both(F.col("na"), F.col("nb"), similarity))
    matched = scratch.keep(counted.where(likely).select("a", "b", whole.alias("whole")))
    with_a = matched.where("not whole").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    links = scratch.keep(matched.where("whole").select("a", "b").union(rows.mapInArrow(lambda batches: _confirmed(batches, n, d), "a long, b long")))
    scratch.drop(matched)
    return links


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: each row of `docs` with the smallest doc_id that links reach.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows that repeat a
    doc_id are linked with each other, and each has the links of its own text. A row with a null doc_id is linked with
    nothing (component_id null) and kept. An empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    signed = scratch.keep(rows.mapInArrow(_signed, "doc_id long, n_shingles long, set1 long, set2 long, print long, keys array<long>"))
    sets = ["set1", "set2", "n_shingles"]
    # nodes are equal shingle sets; the smallest row of each stands for it
    nodes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*sets).agg(F.min(F.struct("doc_id", "print")).alias("low"), F.first("keys").alias("keys"))
    heads = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("id"), *sets, F.col("n_shingles").alias("n"), "low", "keys"))
    placed = signed.select("doc_id", *sets).join(heads.select("id", *sets), sets, "left")
    placed = scratch.keep(placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")))
    scratch.drop(signed)
    posted = scratch.keep(prefix_postings(heads.select("id", "n", "keys"), similarity))
    for _ in range(2):  # who leaves a list may have been the only one of a fitting size
        fewer = scratch.keep(with_partners(posted, similarity))
        scratch.drop(posted)
        posted = fewer
    # only documents in a list with others can have a partner; their signatures and texts are set apart once
    candidates = scratch.keep(posted.select("id").distinct())
    few = candidates.count() <= BROADCAST_IDS
    chosen = F.broadcast(candidates) if few else candidates
    single = scratch.keep(heads.select("id", "n", "low", "keys").join(chosen, "id", "left_semi"))
    # partners of documents beyond COORDINATES may have fewer by the similarity
    of_long = single.where(F.col("n") > float(similarity) * COORDINATES).select("id", "low.doc_id", "low.print")
    texts = rows.join(F.broadcast(of_long) if few else of_long, ["doc_id", "print"]).select("id", "text")
    texts = scratch.keep(texts)
    narrow = scratch.keep(heads.select("id", F.col("low.doc_id").alias("low")))
    scratch.drop(heads, candidates)
    # rows of one doc_id with different texts are in several nodes, which are linked through it
    ends = placed.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("z")).where("b <> z").select("doc_id", "b")
    bridges = placed.join(ends, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")

    def hub_pairs(lists: DataFrame, salt: int) -> DataFrame:
        order = F.xxhash64("id", F.pmod("key", F.lit(HUB_ORDERS)), F.lit(salt))
        # later rounds look further among the members with few rarer coordinates
        hub = F.min_by(F.struct("id", "n", "before"), F.struct(F.col("before") + F.pmod(order, F.lit(1 + 4 * salt)), order, "id")).alias("hub")
        hubs = lists.groupBy("key").agg(hub).select("key", F.col("hub.id").alias("b"), F.col("hub.n").alias("m"), F.col("hub.before").alias("hub_before"))
        met = lists.join(hubs, "key").where((F.col("id") != F.col("b")) & _possible(F.col("n"), F.col("before"), F.col("m"), F.col("hub_before"), similarity))
        return met.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()

    def tile_pairs(lists: DataFrame) -> DataFrame:
        # lists of one hub mostly have the same members, which are compared once
        hubs = lists.groupBy("key").agg(F.min_by("id", F.struct("before", "id")).alias("hub"))
        members = lists.join(hubs, "key").groupBy("hub", "id").agg(F.first("n").alias("n"), F.first("component").alias("component"))
        members = scratch.keep(members)
        sizes = members.groupBy("hub").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"), F.count_distinct("component").alias("c")).where("c > 1")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        dealt = members.join(sizes.drop("c"), "hub").join(single.select("id", "keys"), "id").withColumn("block", block)
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = dealt.select("hub", "id", "n", "component", "keys", "block", other.alias("other"))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        dealt = dealt.select("hub", low.alias("low"), high.alias("high"), (F.col("block") > low).cast("int").alias("side"), "id", "n", "component", "keys")
        share = float(similarity)
        return dealt.groupBy("hub", "low", "high").applyInArrow(lambda rows: _tile(rows, share), "a long, b long").distinct()

    links = [scratch.keep(bridges), _linked(hub_pairs(posted, 0), single, texts, similarity, scratch)]
    joined = lambda: reduce(DataFrame.union, links)
    postings = posted.count()
    for salt in range(1, HUB_ROUNDS + 1):
        found = components(joined(), scratch)
        in_lists = scratch.keep(posted.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "n", "before", F.coalesce("component", "id").alias("component")))
        # lists whose members are not all in one component, and the pairs of members in different ones
        sizes = in_lists.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("c"), F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
        open_lists = scratch.keep(sizes.where("c > 1").select("key", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")))
        open_pairs = open_lists.agg(F.sum("pairs")).first()[0] or 0
        last = open_pairs <= PAIRS_PER_POSTING * postings + 100_000 or salt == HUB_ROUNDS
        left = in_lists.join(open_lists.select("key"), "key", "left_semi")
        if open_pairs and last:
            links.append(_linked(tile_pairs(left), single, texts, similarity, scratch))
            scratch.drop(found)
            found = components(joined(), scratch)
        elif open_pairs:
            links.append(_linked(hub_pairs(left, salt), single, texts, similarity, scratch))
            scratch.drop(found)
        scratch.drop(in_lists, open_lists)
        if last:
            break
    scratch.drop(posted, single, texts, *links)
    labels = narrow.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "low", F.coalesce("component", "id").alias("component"))
    lows = labels.groupBy("component").agg(F.min("low").alias("reached"))
    result = placed.join(labels.join(lows, "component").select("id", "reached"), "id", "left")
    reached = F.coalesce("reached", "doc_id")
    return result.select("doc_id", "n_shingles", reached.alias("component_id"), F.coalesce(F.col("doc_id") == reached, F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, the one with the smallest doc_id; all columns as they were.

    Rows with a null doc_id stay, and so do all rows that repeat the doc_id of one that stays.
    """
    stay = near_groups(docs, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(stay, id_col, "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
