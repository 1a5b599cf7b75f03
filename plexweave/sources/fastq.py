"""Paired sequence files.

FASTQ goes through Spark's text reader, on any file system it knows: large plain files are split into blocks, lines are
numbered by their block and place, and the two mates meet by their number. What that reader cannot take, FASTA and files whose
compression only their first bytes tell, goes through a data source with one partition for each pair of files.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import reduce
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plexweave.session import kept

BATCH = 10_000
SCHEMA = "r1_seq string, r2_seq string, r1_qual string, r2_qual string, input_id int"


def parse(lines: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """(sequence, quality) of each record; quality is None for FASTA, whose sequences may take several lines."""
    seq: list[str] = []
    in_fasta = False
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if in_fasta:
                yield "".join(seq), None
            seq, in_fasta = [], True
        elif in_fasta:
            seq.append(line)
        elif line.startswith("@"):
            try:
                sequence, plus, quality = (next(lines).rstrip("\r\n") for _ in range(3))
            except (StopIteration, RuntimeError):
                raise ValueError(f"a FASTQ record is cut off: {line[:60]}") from None
            if not plus.startswith("+") or len(quality) != len(sequence):
                raise ValueError(f"not a FASTQ record: {line[:60]}")
            yield sequence, quality
        elif line:
            raise ValueError(f"neither FASTQ nor FASTA: {line[:60]}")
    if in_fasta:
        yield "".join(seq), None


def _open(path: str):
    with open(path, "rb") as f:
        zipped = f.read(2) == b"\x1f\x8b"
    return gzip.open(path, "rt") if zipped else open(path)


class Pair(InputPartition):
    def __init__(self, first: str, second: str, number: int):
        self.first, self.second, self.number = first, second, number


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [Pair(a, b, k) for k, (a, b) in enumerate(zip(self.paths[::2], self.paths[1::2]))]

    def read(self, partition: Pair) -> Iterator[pa.RecordBatch]:
        names = ["r1_seq", "r2_seq", "r1_qual", "r2_qual", "input_id"]
        with _open(partition.first) as a, _open(partition.second) as b:
            rows = []

            def batch():
                cols = list(zip(*rows))
                return pa.record_batch([*(pa.array(c, pa.string()) for c in cols), pa.array([partition.number] * len(rows), pa.int32())], names)

            for x, y in zip_longest(parse(a), parse(b)):
                if x is None or y is None:
                    raise ValueError(f"{partition.first} and {partition.second} differ in their number of reads")
                rows.append((x[0], y[0], x[1], y[1]))
                if len(rows) >= BATCH:
                    yield batch()
                    rows.clear()
            if rows:
                yield batch()


class FastqPairs(DataSource):
    """Option `paths`: files in the order R1, R2, R1, R2 and so on, one on a line."""

    @classmethod
    def name(cls) -> str:
        return "fastq_pair"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options.get("paths", "").split("\n") if p]
        if not paths or len(paths) % 2:
            raise ValueError("an even number of sequence files is needed")
        return _Reader(paths)


def first_bytes(spark: SparkSession, path: str, n: int = 4) -> bytes:
    """The begin of a file on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def is_text(spark: SparkSession, path: str) -> bool:
    """Whether Spark's text reader can take the file as FASTQ: plain, or gzip by both its bytes and its name."""
    begin = first_bytes(spark, path)
    if begin[:2] == b"\x1f\x8b":
        first = spark.read.text(path).head() if path.endswith(".gz") else None
        return bool(first) and first["value"].startswith("@")
    return begin[:1] == b"@"


def _checked(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.substring(F.coalesce(value, F.lit("")), 1, 60))).cast("string"))


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, line, value: the lines of text files with the file's place in `paths` and their numbers from 0.

    A task reads blocks one after the other, and each block's lines in their order, so a line's place in its block is
    the distance of its running number within the task from the block's first. The blocks' numbers of lines are counted
    before, all files in one job, and added up in the order of the blocks: one row for each 128 MB, as Spark splits files.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    read = [spark.read.text(p).select(F.lit(k).alias("file"), F.col("_metadata.file_block_start").alias("block"), within.alias("at"), "value") for k, p in enumerate(paths)]
    lines = reduce(DataFrame.unionByName, read)
    starts, before, last = [], 0, -1
    for r in kept(lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))).orderBy("file", "block").collect():
        before = before if r["file"] == last else 0
        starts.append((r["file"], r["block"], r["first"] - before))
        before, last = before + r["n"], r["file"]
    shift = F.broadcast(spark.createDataFrame(starts or [(0, 0, 0)], "file int, block long, shift long"))
    return lines.join(shift, ["file", "block"]).select("file", (F.col("at") - F.col("shift")).alias("line"), "value")


def split_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SCHEMA from FASTQ files in the order R1, R2, R1, R2 and so on, read by as many tasks as the files have blocks.

    Records have four lines; blank lines may follow the last one. Other records, and mates that differ in number, are
    an error. One shuffle brings the lines of a pair together.
    """
    part = (F.col("line") % 4).cast("int")
    value = F.when(part == 0, _checked(F.col("value").startswith("@") | (F.col("value") == ""), F.substring("value", 1, 1), "neither FASTQ nor FASTA"))
    value = value.when(part == 2, _checked(F.col("value").startswith("+") | (F.col("value") == ""), F.substring("value", 1, 1), "not a FASTQ record")).otherwise(F.col("value"))
    lines = numbered_lines(spark, paths).select(
        F.floor(F.col("file") / 2).cast("int").alias("input_id"), F.floor(F.col("line") / 4).alias("record"), (F.col("file") % 2 * 4 + part).alias("place"), value.alias("value")
    )
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("value"))).alias(f"v{k}")
    pairs = lines.groupBy("input_id", "record").agg(*(at(k) for k in range(8)))
    blank = lambda first: F.concat_ws("", *(f"v{k}" for k in range(first, first + 4))) == ""
    pairs = pairs.where(~(blank(0) & blank(4)))
    whole = lambda first: (F.col(f"v{first}") == "@") & (F.col(f"v{first + 2}") == "+") & F.coalesce(F.length(f"v{first + 1}") == F.length(f"v{first + 3}"), F.lit(False))
    fine = F.coalesce(whole(0), F.lit(False)) & F.coalesce(whole(4), F.lit(False))
    here = F.concat_ws(" ", F.lit("pair"), F.col("input_id").cast("string"), F.lit("record"), F.col("record").cast("string"))
    lone = blank(0) | blank(4)
    problem = F.when(lone, F.concat(F.lit("mates differ in their number of reads: "), here)).otherwise(F.concat(F.lit("a FASTQ record is cut off, or not a FASTQ record: "), here))
    first = F.when(fine, F.col("v1")).otherwise(F.raise_error(problem).cast("string"))
    return pairs.select(first.alias("r1_seq"), F.col("v5").alias("r2_seq"), F.col("v3").alias("r1_qual"), F.col("v7").alias("r2_qual"), F.col("input_id"))
