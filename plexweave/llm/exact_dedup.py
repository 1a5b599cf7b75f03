"""Exact deduplication over counting quotient filters.

Every partition packs the 64-bit fingerprints of its texts into counting quotient filters, one for each
block of the fingerprint space. The filters of a block merge without loss, as each is a sorted list of
remainders by quotient. Only texts whose fingerprint was counted more than once go on to verification: they are grouped
by fingerprint and by their bytes, partition by partition first, so that a text is shuffled about once from each. All
others are known to be unique already.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches, checkpointed, worker_memory

#: A block's filters hold about so many fingerprints, so that one task merges them in little memory.
BLOCK_ROWS = 1 << 20
#: A partition closes its filters after so many fingerprints.
FLUSH_ROWS = 1 << 20
#: Up to so many repeated fingerprints are broadcast to the texts.
BROADCAST_PRINTS = 1_000_000


class CountingQuotientFilter:
    """A multiset of fingerprints of `bits` bits, stored as quotients in unary, packed remainders and counters.

    The quotient is the fingerprint's upper `q` bits. `runs` has, for each quotient, a one for each of its
    remainders and then a zero. A remainder has `bits - q` bits, in whole bytes. Counts over one lie apart, behind a
    bitmap.
    """

    def __init__(self, prints: np.ndarray, counts: np.ndarray, bits: int):
        self.prints, self.counts, self.bits = prints, counts, bits

    @classmethod
    def of(cls, prints: np.ndarray, bits: int) -> CountingQuotientFilter:
        return cls(*np.unique(prints.astype(np.uint64), return_counts=True), bits)

    def pack(self) -> bytes:
        n = len(self.prints)
        q = min(max(n - 1, 1).bit_length(), self.bits)
        width = -(-(self.bits - q) // 8)
        q = max(self.bits - 8 * width, 0)
        r = self.bits - q
        quotient = (self.prints >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
        runs = np.zeros(n + (1 << q), np.uint8)
        runs[np.arange(n) + quotient] = 1
        remainders = np.ascontiguousarray(self.prints).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        many = self.counts > 1
        parts = [np.packbits(runs), np.ascontiguousarray(remainders), np.packbits(many), self.counts[many].astype("<u8")]
        return struct.pack("<BBI", self.bits, q, n) + b"".join(p.tobytes() for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n = struct.unpack_from("<BBI", data)
        r, at = bits - q, 6
        width = -(-r // 8)
        size = -(-(n + (1 << q)) // 8)
        runs = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n + (1 << q))
        at += size
        low = np.zeros((n, 8), np.uint8)
        low[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        remainder = low.view("<u8").ravel() & np.uint64((1 << r) - 1)
        many = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
        at += -(-n // 8)
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(data, "<u8", int(many.sum()), at)
        quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
        return cls((quotient << np.uint64(r)) | remainder if r < 64 else remainder, counts, bits)

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The sum of two multisets: both are in the order of quotient and remainder, so each goes where it belongs in the other."""
        place = np.arange(len(self.prints)) + np.searchsorted(other.prints, self.prints, "left")
        total = len(self.prints) + len(other.prints)
        prints, counts, own = np.empty(total, np.uint64), np.empty(total, np.int64), np.zeros(total, bool)
        own[place] = True
        prints[own], prints[~own] = self.prints, other.prints
        counts[own], counts[~own] = self.counts, other.counts
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]][:total])
        return CountingQuotientFilter(prints[first], np.add.reduceat(counts, first) if total else counts, self.bits)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The sum of the multisets, two by two; nothing is lost."""
        while len(filters) > 1:
            filters = [a.merged(b) for a, b in zip(filters[::2], filters[1::2])] + filters[len(filters) // 2 * 2 :]
        return filters[0]


def _block_bits(rows: int) -> int:
    return min(max(-(-rows // BLOCK_ROWS) - 1, 0).bit_length(), 24)


def _packed(batches: Iterator[pa.RecordBatch], block_bits: int) -> Iterator[pa.RecordBatch]:
    bits = 64 - block_bits

    def close(prints: np.ndarray) -> pa.RecordBatch:
        prints = np.sort(prints)
        block = (prints >> np.uint64(bits)).astype(np.int64) if block_bits else np.zeros(len(prints), np.int64)
        low = prints & np.uint64((1 << bits) - 1)
        ids, starts = np.unique(block, return_index=True)
        packed = [CountingQuotientFilter.of(low[a:b], bits).pack() for a, b in zip(starts, np.r_[starts[1:], len(low)])]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["block", "filter"])

    held: list[np.ndarray] = []
    with worker_memory():
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= FLUSH_ROWS:
                yield close(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield close(np.concatenate(held))


def _merged(group: pa.Table, block_bits: int) -> pa.Table:
    bits = 64 - block_bits
    whole = CountingQuotientFilter.merge([CountingQuotientFilter.unpack(x.as_py()) for x in group["filter"]])
    many = whole.counts > 1
    block = np.uint64(group["block"][0].as_py())
    prints = whole.prints[many] | (block << np.uint64(bits) if block_bits else np.uint64(0))
    return pa.table({"fp": pa.array(prints.view(np.int64), pa.int64()), "n": pa.array(whole.counts[many], pa.int64())})


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """fp long, n long: the fingerprints of `prints` (one column, long) that occur more than once.

    `rows` is the number of rows, which sets the number of blocks.
    """
    b = _block_bits(rows)
    bound_batches(prints.sparkSession)
    filters = prints.mapInArrow(lambda batches: _packed(batches, b), "block long, filter binary")
    return filters.groupBy("block").applyInArrow(lambda group: _merged(group, b), "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    Texts are equal when their bytes are; null counts as the empty text, which groups like any other. Of equal
    texts the row with the largest doc_id stays (a null id only where all are null). Rows that repeat a doc_id
    count one by one and share their fate. An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = lambda c: F.unhex(F.sha2(c.cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("fp"), sha(text).alias("sha"))
    often = checkpointed(repeated_fingerprints(docs.select(F.xxhash64(text).alias("fp")), docs.count()).select("fp"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    candidates = texts.join(F.broadcast(often) if often.count() <= BROADCAST_PRINTS else often, "fp", "left_semi")
    # the bytes are the key, so what falls into one group is equal; the digest only names the group to its rows
    groups = (
        candidates.groupBy("fp", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("fp", sha(F.col("text")).alias("sha"), "keep_id", "group_size")
    )
    return rows.join(groups, ["fp", "sha"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were.

    Of rows that repeat both the doc_id and the text of the row that stays, any one remains. Rows with a null doc_id are compared with each
    other only, and one of each text stays.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    kept = exact_groups(docs, id_col, text_col).where("kept and doc_id is not null")
    stay = kept.groupBy(F.col("doc_id").alias("__stay_id"), F.col("text_sha256").alias("__stay_sha")).agg(F.count("*").alias("__stay_rows"))
    same = (F.col(id_col) == F.col("__stay_id")) & (sha == F.col("__stay_sha"))
    once = docs.join(stay.where("__stay_rows = 1"), same, "left_semi")
    again = docs.join(stay.where("__stay_rows > 1"), same, "left_semi").dropDuplicates([id_col, text_col])
    nulls = docs.where(F.col(id_col).isNull()).dropDuplicates([text_col])
    return once.unionByName(again).unionByName(nulls).select(docs.columns)
