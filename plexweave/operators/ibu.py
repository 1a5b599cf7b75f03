"""Operators on molecule records (barcode, umi, index), kept as distinct triples with their number of reads (n_reads).

All of them take further grouping columns (`by`), so one plan serves all aliases at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexweave.functions.sequence import decode
from plexweave.session import kept, ship

#: UMIs of one barcode and index that are clustered in the memory of one task; larger groups go through joins.
GROUP_ROWS = 1_000_000


class EmptyStreamError(ValueError):
    """No records to count."""


class UnsortedError(ValueError):
    """Records out of the order by barcode, umi, index."""


@dataclass(frozen=True)
class Header:
    """What a table of records tells of itself, kept as metadata of its barcode column."""

    bc_len: int = 16
    umi_len: int = 12
    version: int = 1
    is_sorted: bool = False

    def lines(self) -> list[str]:
        return header(self.bc_len, self.umi_len, self.version, self.is_sorted)


def with_header(records: DataFrame, head: Header) -> DataFrame:
    """`records` that carry `head`; a Parquet table keeps it, and reading it gives it back."""
    return records.withMetadata("barcode", {"bc_len": head.bc_len, "umi_len": head.umi_len, "version": head.version, "sorted": head.is_sorted})


def header_of(records: DataFrame) -> Header | None:
    """The header that `records` carry; None for a table that was made without one."""
    found = records.schema["barcode"].metadata
    return Header(found["bc_len"], found["umi_len"], found["version"], found["sorted"]) if "bc_len" in found else None


def common_header(parts: list[DataFrame], bc_len: int | None = None, umi_len: int | None = None) -> Header:
    """The one header of all parts, which must not differ from it nor from the lengths given, if any.

    A part without a header has the lengths given, or the usual ones. Several parts after another are not sorted, even
    if each of them is.
    """
    heads = [header_of(p) for p in parts]
    told = set(filter(None, heads))
    if len(told) > 1:
        raise ValueError(f"headers differ: {sorted(map(str, told))}")
    head = told.pop() if told else Header(bc_len or Header.bc_len, umi_len or Header.umi_len)
    if bc_len not in (None, head.bc_len) or umi_len not in (None, head.umi_len):
        raise ValueError(f"lengths of {bc_len} and {umi_len} are asked for, the header has {head.bc_len} and {head.umi_len}")
    return replace(head, is_sorted=head.is_sorted and len(parts) == 1 and None not in heads)


def weigh(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Records, with or without n_reads, as distinct triples with their number of reads."""
    n = F.sum("n_reads") if "n_reads" in records.columns else F.count("*")
    return records.groupBy(*by, "barcode", "umi", "index").agg(n.cast("long").alias("n_reads"))


def view(records: DataFrame, decoded: bool = False, bc_len: int = 16, umi_len: int = 12, features: DataFrame | None = None, column: str = "unit") -> DataFrame:
    """barcode, umi, and index or the feature's name; `decoded` shows sequences."""
    out = records
    last = "index"
    if features is not None:
        out, last = out.join(features.select("index", F.col(column).alias("feature")), "index", "left"), "feature"
    bc, umi = (decode(F.col("barcode"), bc_len), decode(F.col("umi"), umi_len)) if decoded else (F.col("barcode"), F.col("umi"))
    return out.select(bc.alias("barcode"), umi.alias("umi"), last)


def header(bc_len: int, umi_len: int, version: int = 1, is_sorted: bool = False) -> list[str]:
    """The lines that a text view begins with."""
    return ["# IBU", f"# version: {version}", f"# bc_len: {bc_len}", f"# umi_len: {umi_len}", f"# sorted: {str(is_sorted).lower()}"]


def cat(parts: list[DataFrame], lengths: list[tuple[int, int]] | None = None) -> DataFrame:
    """All records of the parts; barcode and UMI lengths must be the same in all."""
    if lengths and len(set(lengths)) > 1:
        raise ValueError(f"headers differ: {sorted(set(lengths))}")
    return reduce(DataFrame.unionByName, parts)


def sort(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The total order by barcode, umi, index."""
    return records.orderBy(*by, "barcode", "umi", "index")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each unbroken run of a file's rows: where it lies, its first and last record, and whether it is in order."""
    held: dict | None = None
    names = ("barcode", "umi", "index")

    def out(run: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: v for k, v in run.items() if k != "next"}], schema)

    triple = pa.struct([(n, pa.int64()) for n in names])
    schema = pa.schema([("folder", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("first", triple), ("last", triple), ("in_order", pa.bool_())])
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch["at"].to_numpy()
        path = batch["path"].dictionary_encode()
        codes = path.indices.to_numpy()
        values = [batch[n].to_numpy() for n in names]
        cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        b, u, i = values
        less = (b[1:] < b[:-1]) | (b[1:] == b[:-1]) & ((u[1:] < u[:-1]) | (u[1:] == u[:-1]) & (i[1:] < i[:-1]))
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            folder, _, file = path.dictionary[int(codes[lo])].as_py().rpartition("/")
            first, last = ({n: int(v[k]) for n, v in zip(names, values)} for k in (lo, hi - 1))
            good = not less[lo : hi - 1].any()
            if held and (held["folder"], held["file"], held["next"]) == (folder, file, at[lo]):
                good = good and tuple(held["last"].values()) <= tuple(first.values())
                held |= {"last": last, "in_order": held["in_order"] and good, "next": at[hi - 1] + 1}
                continue
            if held:
                yield out(held)
            held = {"folder": folder, "file": file, "start": int(at[lo]), "first": first, "last": last, "in_order": bool(good), "next": at[hi - 1] + 1}
    if held:
        yield out(held)


def disorder(table: DataFrame) -> DataFrame:
    """folder, file, start: the runs of a Parquet table of records that are out of order, none for a sorted table.

    The order is that of the files by name and of the rows within; each folder (an alias) has an order of its own. Tasks
    look through their own parts of files and tell the edges, so only a row for each part meets its neighbours.
    """
    ship(table.sparkSession)
    rows = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), *(F.col(c).cast("long").alias(c) for c in ("barcode", "umi", "index")))
    triple = "struct<barcode: long, umi: long, index: long>"
    runs = rows.mapInArrow(_runs, f"folder string, file string, start long, first {triple}, last {triple}, in_order boolean")
    before = F.lag("last").over(Window.partitionBy("folder").orderBy("file", "start"))
    return runs.withColumn("before", before).where(~F.col("in_order") | (F.col("before") > F.col("first"))).select("folder", "file", "start")


def require_sorted(table: DataFrame) -> None:
    """An error if a Parquet table of records is out of order."""
    found = disorder(table).orderBy("folder", "file", "start").first()
    if found:
        raise UnsortedError(f"records are not sorted: see {found['folder']}/{found['file']} from row {found['start']}")


def reads_per_barcode(weighted: DataFrame, whitelist: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """barcode, n_umis (distinct within the barcode), n_reads; only barcodes of `whitelist` (barcode), if given."""
    rows = weighted if whitelist is None else weighted.join(whitelist.select("barcode"), "barcode", "left_semi")
    # distinct UMIs first, so that both counts are plain sums
    return rows.groupBy(*by, "barcode", "umi").agg(F.sum("n_reads").alias("r")).groupBy(*by, "barcode").agg(F.count("*").alias("n_umis"), F.sum("r").cast("long").alias("n_reads"))


def _clustered(table: pa.Table, group: np.ndarray) -> pa.Table:
    """`table` (…, umi, n_reads) with `corrected`: the representative of each UMI's component within its group."""
    umi, n = table["umi"].to_numpy(), table["n_reads"].to_numpy()
    label = np.arange(len(umi))
    if len(umi) > 1:
        ends = []
        top = int(umi.max()).bit_length()
        for shift in range(0, top + (top & 1), 2):  # UMIs of a group that are alike but for one base
            rest = umi & ~np.int64(3 << shift)
            order = np.lexsort((rest, group))
            same = (rest[order[1:]] == rest[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
            ends.append(np.stack([order[:-1][same], order[1:][same]]))
        a, b = np.concatenate(ends, axis=1)
        while True:  # the smallest label spreads along links, and labels along themselves
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    order = np.lexsort((umi, n, label))
    last = np.flatnonzero(np.r_[label[order[1:]] != label[order[:-1]], True][: len(order)])
    chosen = np.empty(len(umi), np.int64)
    chosen[label[order[last]]] = umi[order[last]]
    return table.append_column("corrected", pa.array(chosen[label], pa.int64()))


def _clusters(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Clusters of rows sorted by `keys`, many groups at once; the last group of a batch waits for what follows."""

    def groups(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for k in keys:
            codes = pc.fill_null(pc.dictionary_encode(table[k].combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    held: list[pa.Table] = []
    held_key = None
    solved = lambda tables, group: _clustered(pa.concat_tables(tables), group).combine_chunks().to_batches()
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        first, last = (tuple(table[k][i].as_py() for k in keys) for i in (0, len(table) - 1))
        if held and first != held_key:
            yield from solved(held, np.zeros(sum(map(len, held)), np.int64))
            held = []
        group = groups(table)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            before = np.zeros(sum(map(len, held)), np.int64)
            yield from solved([*held, table.slice(0, cut)], np.r_[before, group[:cut]])
            held = []
        held.append(table.slice(cut))
        held_key = last
    if held:
        yield from solved(held, np.zeros(sum(map(len, held)), np.int64))


def _in_arrays(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` (keys, umi, n_reads and more) with `corrected`, by groups of `keys` in the memory of tasks."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in rows.columns) + ", corrected long"
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _clusters(batches, keys), schema)


def _by_halves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As _in_arrays, for groups of any size: UMIs that differ in one base are alike in their first or last half.

    Groups of UMIs with the same half are small enough for arrays (4^10 of 20 bases). Each UMI thus gets two partial
    clusters, and the clusters of these are found by passing on the smallest label within either, and the label's own
    label, until none changes; each round is a table in the shared folder.
    """
    top = rows.agg(F.max("umi")).first()[0] or 0
    half = 2 * -(-((int(top).bit_length() + 1) // 2) // 2)  # bits of the last half of the bases
    halves = rows.withColumn("__half", F.shiftright("umi", half))
    first = _in_arrays(halves, [*keys, "__half"]).withColumnRenamed("corrected", "__a").withColumn("__half", F.col("umi").bitwiseAND((1 << half) - 1))
    state = kept(_in_arrays(first, [*keys, "__half"]).withColumnRenamed("corrected", "__b").drop("__half").withColumn("__label", F.col("umi")))
    while True:
        least = lambda c: F.min("__label").over(Window.partitionBy(*keys, c))
        passed = state.withColumn("__new", least("__a")).withColumn("__new", F.least("__new", least("__b")))
        own = state.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("umi").alias("__at"), F.col("__label").alias("__further"))
        same = F.col("__new") == F.col("__at")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        jumped = passed.join(own, same).withColumn("__new", F.least("__new", "__further"))
        after = kept(jumped.select(*rows.columns, "__a", "__b", F.col("__new").alias("__label"), (F.col("__new") != F.col("__label")).alias("__changed")))
        moved = not after.where("__changed").isEmpty()
        state = after.drop("__changed")
        if not moved:
            break
    chosen = F.max(F.struct("n_reads", "umi")).over(Window.partitionBy(*keys, "__label"))["umi"]
    return state.withColumn("corrected", chosen).select(*rows.columns, "corrected")


def umi_clusters(weighted: DataFrame, by: tuple[str, ...] = (), group_rows: int = GROUP_ROWS) -> DataFrame:
    """`weighted` with `corrected`: UMIs of one barcode and index that a chain of single mismatches connects become one.

    The representative is the UMI with the most reads, of equal ones the largest. Rows are dealt and sorted by group, and
    many groups are clustered at once in arrays; groups of over `group_rows` UMIs are split by halves of the UMIs and put
    together by joins, with the same result. So `weighted` is read once more, for the sizes of groups, and had better be
    a table.
    """
    ship(weighted.sparkSession)
    keys = [*by, "barcode", "index"]
    rows = weighted.select(*keys, "umi", "n_reads")
    large = kept(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > group_rows).drop("__n"))
    if large.isEmpty():
        return _in_arrays(rows, keys)
    other = large.select(*(F.col(k).alias(f"__{k}") for k in keys))  # a row for at least `group_rows` of the records
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return _in_arrays(rows.join(other, same, "left_anti"), keys).unionByName(_by_halves(rows.join(other, same, "left_semi"), keys))


def with_corrected(clusters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Records with corrected UMIs, summed up, from their clusters."""
    return clusters.groupBy(*by, "barcode", F.col("corrected").alias("umi"), "index").agg(F.sum("n_reads").cast("long").alias("n_reads"))


def umi_correct(weighted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Records with corrected UMIs, summed up."""
    return with_corrected(umi_clusters(weighted, by), by)


def umi_stats(clusters: DataFrame) -> DataFrame:
    """total, corrected, fraction_corrected: reads, and those whose UMI changed."""
    changed = F.coalesce(F.sum(F.when(F.col("umi") != F.col("corrected"), F.col("n_reads"))), F.lit(0))
    total = F.coalesce(F.sum("n_reads"), F.lit(0))
    return clusters.agg(total.cast("long").alias("total"), changed.cast("long").alias("corrected"), F.coalesce(F.try_divide(changed, total), F.lit(0.0)).alias("fraction_corrected"))


def count(weighted: DataFrame, by: tuple[str, ...] = (), ties: str = "reference", n_features: int | None = None, allow_empty: bool = True) -> DataFrame:
    """barcode, index, count: molecules, one for each UMI of a barcode, given to the index with the most reads.

    With `ties` = reference a UMI is dropped iff several indices have the most reads and the highest index of all is one
    of them, and else goes to the lowest of these; with strict it is dropped on any tie. Indices from `n_features` on are
    an error, as is an empty input unless allowed.
    """
    if ties not in ("reference", "strict"):
        raise ValueError(ties)
    if not allow_empty and weighted.isEmpty():
        raise EmptyStreamError("no records")
    rows = weighted
    if n_features is not None:
        bad = F.raise_error(F.concat(F.lit("index beyond the features: "), F.col("index").cast("string")))
        rows = rows.withColumn("index", F.when(F.col("index") < n_features, F.col("index")).otherwise(bad.cast("long")))
    # one pass: most reads, then the lowest and highest index with it, and the highest of all
    of_umi = rows.groupBy(*by, "barcode", "umi").agg(
        F.max(F.struct("n_reads", (-F.col("index")).alias("low"))).alias("first"),
        F.max(F.struct("n_reads", "index")).alias("last"),
        F.max("index").alias("highest"),
    )
    winner, rival = -F.col("first.low"), F.col("last.index")
    tied = winner != rival
    dropped = tied & (rival == F.col("highest")) if ties == "reference" else tied
    return of_umi.where(~dropped).groupBy(*by, "barcode", winner.alias("index")).agg(F.count("*").alias("count"))


def by_aggregate(counts: DataFrame, features: DataFrame, column: str = "gene", by: tuple[str, ...] = ()) -> DataFrame:
    """barcode, `column`, count: counts of units summed over what they belong to. `features` has index and `column`."""
    return counts.join(features.select("index", column), "index").groupBy(*by, "barcode", column).agg(F.sum("count").cast("long").alias("count"))


def with_suffix(rows: DataFrame, suffix: str | None, column: str = "barcode") -> DataFrame:
    """Barcodes as barcode-suffix."""
    return rows.withColumn(column, F.concat_ws("-", F.col(column).cast("string"), F.lit(suffix))) if suffix else rows


def bijection(rows: DataFrame, value: str, position: str) -> DataFrame:
    """value, index: distinct values numbered in the order in which they first occur. Meant for reference tables."""
    first = rows.groupBy(value).agg(F.min(position).alias("__first"))
    return first.withColumn("index", (F.row_number().over(Window.orderBy("__first")) - 1).cast("long")).drop("__first")


def keep_large(records: DataFrame, alias: str = "alias", at_least: int = 1000) -> DataFrame:
    """Only records of aliases with enough reads (never fewer than one)."""
    n = F.sum("n_reads") if "n_reads" in records.columns else F.count("*")
    kept = records.groupBy(alias).agg(n.alias("__n")).where(F.col("__n") >= max(at_least, 1)).select(alias)
    return records.join(kept, alias, "left_semi")
