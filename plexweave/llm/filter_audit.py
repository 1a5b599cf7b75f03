"""What each filter removes in each order of filters, from counts of the sets of filters that documents fail.

Copies are found by sorting: rows are dealt out by ranges of the text's fingerprint and the id, so that a text which a
third of all rows have is many tasks' work, and each range is sorted by fingerprint, whole text and id. A row then
fails iff an earlier row of its run has a smaller id, which the row before tells. A run may begin in an earlier range:
so a range also gives the smallest id of each text with its first or its last fingerprint, under a digest of the
text, and the rows that only these can decide wait for the minimum over all ranges. The other filters are read off the
text in the same pass. What is left of a document is a mask of filters; their counts by part add up over tasks, and
every order of filters is worked out from 32 counts of a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexweave.llm.common import Scratch, bound_batches

FILTERS = "ABCDE"
#: A text fails with fewer words, fewer distinct ones in a hundred, or more capitals in a hundred code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_CAPITALS, _MARKS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"
COPY = 1 << FILTERS.index("E")
#: Kinds of rows: a document whose mask is known, a text at the end of a range, a document that waits for its run's begin.
KNOWN, EDGE, OPEN = range(3)
_ROWS = "kind int, doc_id long, part string, mask int, digest binary"


def text_mask(text: str) -> int:
    """The filters A to D that a text fails, as bits from the lowest."""
    data = text.encode()
    words = data.split()
    few = len(words) < LEAST_WORDS
    alike = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text)
    marked = len(data.translate(None, _MARKS)) < len(data)
    return few | alike << 1 | loud << 2 | marked << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, text, doc_id, part) of one range in their order become documents and edges."""
    lead = fp = text = least = None
    base, runs = 0, []  # the runs of the fingerprint at hand: text and least id

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "doc_id", "part", "mask", "digest"])

    began = False
    for b in batches:
        rows = []
        for new_fp, new_text, doc_id, part in zip(*(b.column(k).to_pylist() for k in range(4))):
            if not began or new_fp != fp or new_text != text:
                if began and new_fp == fp:
                    runs.append((text, least))
                else:
                    runs = []
                if not began:
                    began, lead = True, new_fp
                fp, text, least, base = new_fp, new_text, None, text_mask(new_text)
            if doc_id is None:
                rows.append((KNOWN, None, part, base, None))
                continue
            if least is None:
                least = doc_id
            if doc_id > least:
                rows.append((KNOWN, doc_id, part, base | COPY, None))
            elif fp == lead:
                rows.append((OPEN, doc_id, part, base, sha256(text.encode()).digest()))
            else:
                rows.append((KNOWN, doc_id, part, base, None))
        if rows:
            yield out(rows)
    edges = [(EDGE, i, None, None, sha256(t.encode()).digest()) for t, i in [*runs, (text, least)] if i is not None] if began else []
    if edges:
        yield out(edges)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, part, mask: the filters that each row of `docs` fails, a bit for each of FILTERS from the lowest.

    Null texts are empty, and a null part is the empty string. E fails where a row with a smaller id has the same text;
    so rows that repeat an id fail together, and a null id neither fails nor makes another fail. Other columns are not
    read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("fp"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    # the ends of ranges are short keys, as some of them go through the driver
    ranges = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    found = scratch.keep(ranges.mapInArrow(_masks, _ROWS))
    # a few rows for each range
    begins = found.where(F.col("kind") != KNOWN).groupBy("digest").agg(F.min("doc_id").alias("least"))
    waiting = found.where(F.col("kind") == OPEN).join(begins, "digest")
    decided = waiting.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), COPY).otherwise(0)).alias("mask"))
    return found.where(F.col("kind") == KNOWN).select("doc_id", "part", "mask").unionByName(decided)


def mask_counts(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and mask, and of these the ones labelled as of quality and as toxic.

    Several labels of one id count as the strongest; null labels and ids as none.
    """
    yes = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def _orders() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Orders and steps, and by these the filter, and which masks are kept after, removed at, and redundant at the step."""
    names = [("".join(p), step) for p in permutations(FILTERS) for step in range(1, len(FILTERS) + 1)]
    masks = np.arange(1 << len(FILTERS))
    which = np.array([FILTERS.index(order[step - 1]) for order, step in names])
    before = np.array([sum(1 << FILTERS.index(f) for f in order[: step - 1]) for order, step in names])
    fails = (masks[:, None] >> which) & 1 == 1
    earlier = (masks[:, None] & before) > 0
    return names, which, ~earlier & ~fails, ~earlier & fails, earlier & fails


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, which, kept, removed, redundant = _orders()
    steps = {"filter_order": [o for o, _ in names], "step": [s for _, s in names]}
    for b in batches:
        for part, counts in zip(b["part"], b["counts"]):
            n, good, toxic = (np.zeros(len(kept), np.int64) for _ in range(3))
            for r in counts:
                n[r["mask"]], good[r["mask"]], toxic[r["mask"]] = r["n"], r["good"], r["toxic"]
            gone = n @ removed
            each = np.bincount(which, gone, len(FILTERS)).astype(np.int64)
            yield pd.DataFrame({"part": part, **steps, "kept": n @ kept, "removed": gone, "redundant": n @ redundant, "unique_fails": n[1 << which], "good_lost": good @ removed, "toxic_lost": toxic @ removed, "shapley": each[which]})


def audit(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from `counts` (part, mask, n, good, toxic): kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley. No counts give no rows."""
    bound_batches(counts.sparkSession)
    whole = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 32 at most
    columns = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return whole.mapInPandas(_audited, f"part string, filter_order string, step int, {columns}")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all of `docs`, with failures' and mask_counts' reading of nulls and repeated rows."""
    return audit(mask_counts(failures(docs), labels))
