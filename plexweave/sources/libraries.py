"""Reference files and record tables as DataFrames. Compressed text is told by its first bytes, whatever its name."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexweave.session import ship, spread


def plain(data: bytes) -> bytes:
    """The bytes of a file that may be gzip or Zstandard, also of several members."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    return data


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = [plain(data).decode().splitlines() for data in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(lines, pa.list_(pa.string()))], ["path", "lines"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, at, value: the lines that are not blank of a reference file, or of a folder of them. A file is one task's."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    split = files.mapInArrow(_split, "path string, lines array<string>")
    return split.select("path", F.posexplode("lines").alias("at", "value")).where(F.trim("value") != "")


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    parts = F.split("value", "\t")
    return _lines(spark, path).select("path", "at", *(F.nullif(F.get(parts, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns)))


def in_file_order(rows: DataFrame) -> DataFrame:
    """Reference rows (path, at, …) numbered from 0 by their place; these files are small, and their order is their meaning."""
    return rows.withColumn("idx", (F.row_number().over(Window.orderBy("path", "at")) - 1).cast("long")).drop("path", "at")


def gex_library(spark: SparkSession, path: str) -> DataFrame:
    """idx, probe_name, gene_name, seq."""
    return in_file_order(_tsv(spark, path, ["probe_name", "gene_name", "seq"]))


def guide_library(spark: SparkSession, path: str) -> DataFrame:
    """idx, name, anchor, protospacer."""
    return in_file_order(_tsv(spark, path, ["name", "anchor", "protospacer"]))


def probe_barcodes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """seq, alias; only aliases in which `pattern` is found."""
    probes = _tsv(spark, path, ["seq", "canonical", "alias"]).select("seq", "alias")
    return probes.where(F.col("alias").rlike(pattern)) if pattern else probes


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """seq: the first column."""
    return _tsv(spark, path, ["seq"]).select("seq").where("seq is not null")


def strict_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """barcode (packed): one key a line, all of one length and of ACGT, else an error."""
    from plexweave.functions.sequence import encode

    rows = _lines(spark, path).select(F.trim("value").alias("seq"))
    low, high, bad = rows.agg(F.min(F.length("seq")), F.max(F.length("seq")), F.sum((~F.col("seq").rlike("^[ACGT]+$")).cast("int"))).first()
    if low != high or bad:
        raise ValueError(f"whitelist keys of one length and of ACGT are needed: lengths {low} to {high}, {bad or 0} with other letters")
    return rows.select(encode(F.col("seq")).alias("barcode"))


def features(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    """index, feature: the `column`-th word of each line; a line without it is an error."""
    words = F.split(F.trim("value"), r"\s+")
    rows = in_file_order(_lines(spark, path))
    name = F.when(F.size(words) > column, F.get(words, F.lit(column))).otherwise(F.raise_error(F.concat(F.lit("no such column: "), F.col("value"))).cast("string"))
    return rows.select(F.col("idx").alias("index"), name.alias("feature"))


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Record tables (barcode, umi, index, and alias and n_reads where they have them) of one or more Parquet folders."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(p) for p in paths))


def reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Read pairs: Parquet tables, or pairs of FASTQ or FASTA files in the order R1, R2, R1, R2 and so on."""
    if all(p.rstrip("/").endswith(".parquet") for p in paths):
        parts = (spread(spark.read.parquet(p)).withColumn("input_id", F.lit(k)) for k, p in enumerate(paths))
        return reduce(DataFrame.unionByName, parts)
    from plexweave.sources.fastq import FastqPairs, is_text, split_reads

    if len(paths) % 2:
        raise ValueError("an even number of sequence files is needed")
    if all(is_text(spark, p) for p in paths):
        return split_reads(spark, paths)
    ship(spark)
    spark.dataSource.register(FastqPairs)
    return spark.read.format("fastq_pair").option("paths", "\n".join(paths)).load()
