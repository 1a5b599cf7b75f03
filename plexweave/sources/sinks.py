"""Where results go: partitioned records, text tables, sparse matrices, statistics."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexweave.functions.sequence import decode
from plexweave.operators.ibu import with_suffix
from plexweave.session import kept


def write_records(records: DataFrame, path: str, force: bool = False) -> None:
    """One folder for each alias; several tasks may write a large alias. An existing path is an error unless forced."""
    records.write.mode("overwrite" if force else "errorifexists").partitionBy("alias").parquet(path)


#: Codecs of text by extension. Zstandard is Hadoop's, which needs its native library on the cluster.
CODECS = {"gz": "gzip", "gzip": "gzip", "zst": "org.apache.hadoop.io.compress.ZStandardCodec", "zstd": "org.apache.hadoop.io.compress.ZStandardCodec"}


def _codec(path: str) -> str:
    return CODECS.get(path.rsplit(".", 1)[-1], "none")


def write_text(lines: DataFrame, path: str, force: bool = False, compression: str | None = None) -> None:
    """A folder of text files, in the order of the partitions. Compression follows the path's extension unless given."""
    found = compression or _codec(path)
    lines.write.mode("overwrite" if force else "errorifexists").option("compression", found).text(path)


def write_tsv(rows: DataFrame, path: str, header: bool = False, force: bool = False) -> None:
    rows.write.mode("overwrite" if force else "errorifexists").option("compression", _codec(path)).csv(path, sep="\t", header=header)


def count_table(counts: DataFrame, bc_len: int = 16, encoded: bool = False, features: DataFrame | None = None, column: str = "gene", suffix: str | None = None, swapped: bool = False) -> DataFrame:
    """The columns of a count table in each of its four layouts.

    With `features` (or a `column` in the counts already): barcode, feature, count, and a suffix on decoded barcodes.
    Without: barcode, index, count; `swapped` puts the count before the index for decoded barcodes, as some readers want.
    """
    barcode = F.col("barcode") if encoded else decode(F.col("barcode"), bc_len)
    rows = counts
    if column not in rows.columns and features is not None:
        rows = rows.join(features.select("index", column), "index")
    if column in rows.columns:
        out = rows.select(barcode.alias("barcode"), F.col(column).alias("feature"), "count")
        return out if encoded else with_suffix(out, suffix)
    out = rows.select(barcode.alias("barcode"), "index", "count")
    return out.select("barcode", "count", "index") if swapped and not encoded else out


def numbered(values: DataFrame, column: str, number: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values with dense numbers from 1 in their order, by two levels: ranges of values, then places within.

    With `by`, each group has numbers of its own. The ranges' ends are some hundred quantiles of all values, worked out
    once, so every use of the plan has the same.
    """
    distinct = values.select(*by, column).where(F.col(column).isNotNull()).distinct()
    n = 16 * max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = distinct.select(F.col(column), F.xxhash64(*by, column).alias("__h")).orderBy("__h").limit(n).select(column)
    ends = sorted(r[0] for r in sample.collect())
    part = F.lit(0)
    if ends:
        bounds = F.array(*map(F.lit, ends[16::16]))
        part = F.size(F.filter(bounds, lambda x: x <= F.col(column))) if len(ends) > 16 else part
    parts = distinct.withColumn("__p", part)
    sizes = parts.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = F.broadcast(sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(*by, "__p", "__start"))
    inside = Window.partitionBy(*by, "__p").orderBy(column)
    return parts.join(starts, [*by, "__p"]).select(*by, column, (F.row_number().over(inside) + F.col("__start")).cast("long").alias(number))


def matrix_entries(counts: DataFrame, column: str, barcodes: DataFrame, features: DataFrame) -> DataFrame:
    """feature_id, barcode_id, count, both ids from 1."""
    return counts.join(features, column).join(barcodes, "barcode").select("feature_id", "barcode_id", "count")


def matrix_parts(counts: DataFrame, column: str = "gene") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered barcodes, numbered features, and entries."""
    barcodes = numbered(counts, "barcode", "barcode_id")
    features = numbered(counts, column, "feature_id")
    return barcodes, features, matrix_entries(counts, column, barcodes, features)


def write_matrix(counts: DataFrame, path: str, column: str = "gene", bc_len: int = 16, suffix: str | None = None, force: bool = False) -> None:
    """matrix.mtx.gz, barcodes.tsv.gz and features.tsv.gz as folders of gzip parts, whose concatenation is the file.

    The header is the first part; entries follow in the order of barcodes and features.
    """
    barcodes, features, entries = matrix_parts(counts, column)
    nf, nb, nnz = matrix_size(counts, column).first()
    spark = counts.sparkSession
    head = spark.createDataFrame([(0, 0, MATRIX_BANNER + f"\n{nf} {nb} {nnz}")], "b long, f long, value string")
    body = entries.select(F.col("barcode_id").alias("b"), F.col("feature_id").alias("f"), F.concat_ws(" ", "feature_id", "barcode_id", "count").alias("value"))
    write_text(head.union(body).orderBy("b", "f").select("value"), f"{path}/matrix.mtx.gz", force)
    names = with_suffix(barcodes.select("barcode_id", decode(F.col("barcode"), bc_len).alias("barcode")), suffix)
    write_text(names.orderBy("barcode_id").select("barcode"), f"{path}/barcodes.tsv.gz", force)
    write_text(features.orderBy("feature_id").select(column), f"{path}/features.tsv.gz", force)


#: First line of a sparse matrix.
MATRIX_BANNER = "%%MatrixMarket matrix coordinate integer general"


def write_matrices(counts: DataFrame, path: str, column: str = "gene", bc_len: int = 16, bare: str = "output", force: bool = False) -> None:
    """The three files of write_matrix for every alias of `counts` (alias, barcode, `column`, count), as `path`/alias/file.

    One write makes all of them: lines of all files are sorted by alias, file and place, and dealt to folders by the
    first two. Barcodes get their alias as suffix but for that of `bare`. The folders are renamed at the end.
    """
    spark = counts.sparkSession
    alias = F.coalesce(F.col("alias"), F.lit(bare)).alias("alias")  # never null, so that the sort below is the write's own
    own = kept(counts.select(alias, "barcode", F.col(column).alias("feature"), "count").where("feature is not null"))
    by = ("alias",)
    barcodes, features = kept(numbered(own, "barcode", "b", by)), kept(numbered(own, "feature", "f", by))
    line = lambda file, value, b=F.lit(0), f=F.lit(0): (alias, F.lit(file).alias("file"), b.cast("long").alias("b"), f.cast("long").alias("f"), value.alias("value"))
    entries = own.join(features, [*by, "feature"]).join(barcodes, [*by, "barcode"])
    size = lambda rows, n: rows.groupBy("alias").agg(F.count("*").alias(n))
    sizes = size(features, "nf").join(size(barcodes, "nb"), "alias").join(size(own, "nnz"), "alias")
    name = decode(F.col("barcode"), bc_len)
    lines = [
        sizes.select(*line("matrix.mtx.gz", F.concat(F.lit(MATRIX_BANNER + "\n"), F.concat_ws(" ", "nf", "nb", "nnz")))),
        entries.select(*line("matrix.mtx.gz", F.concat_ws(" ", "f", "b", "count"), F.col("b"), F.col("f"))),
        barcodes.select(*line("barcodes.tsv.gz", F.when(F.col("alias") == bare, name).otherwise(F.concat_ws("-", name, "alias")), F.col("b"))),
        features.select(*line("features.tsv.gz", F.col("feature"), F.lit(0), F.col("f"))),
    ]
    rows = reduce(DataFrame.union, lines).orderBy("alias", "file", "b", "f").select("alias", "file", "value")
    made = f"{path.rstrip('/')}/_made"
    rows.write.mode("overwrite" if force else "errorifexists").option("compression", "gzip").partitionBy("alias", "file").text(made)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(made)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{made}/alias=*/file=*")):
        at = found.getPath()
        name_of = lambda p: jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(p.getName().partition("=")[2])
        target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name_of(at.getParent())}/{name_of(at)}")
        if fs.exists(target):
            if not force:
                raise FileExistsError(target.toString())
            fs.delete(target, True)
        fs.mkdirs(target.getParent())
        if not fs.rename(at, target):
            raise OSError(f"cannot rename {at.toString()} to {target.toString()}")
    fs.delete(root, True)


def write_with_header(header: list[str], lines: DataFrame | None, spark: SparkSession, path: str, force: bool = False) -> None:
    """Text of `lines` (value) after `header`, which is the first part of the folder. Lines keep the order of their partitions."""
    top = spark.createDataFrame([(line,) for line in header], "value string").coalesce(1)
    write_text(top if lines is None else top.union(lines.select("value")), path, force)


def write_json(row: DataFrame, path: str) -> dict:
    """A table of one row as a JSON file on the driver; the row is returned."""
    found = row.first().asDict()
    write_json_rows(found, path)
    return found


def write_json_rows(found: dict | list[dict], path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(found, indent=2))


def matrix_size(counts: DataFrame, column: str = "gene") -> DataFrame:
    """n_features, n_barcodes, nnz: the numbers of a matrix's header, as one row."""
    return counts.agg(F.count_distinct(column).alias("n_features"), F.count_distinct("barcode").alias("n_barcodes"), F.count("*").alias("nnz"))
