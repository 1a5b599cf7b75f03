"""What every job needs of its session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark context.

    Workers may start without the driver's import path; a zip file of a few kB goes through Spark's own file server.
    """
    context = spark.sparkContext
    if getattr(context, "_plexweave_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="plexweave-")) / "plexweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(target))
    context._plexweave_shipped = True


def kept(df: DataFrame) -> DataFrame:
    """`df` written as Parquet and read again, so that what follows does not work it out anew for each use.

    It goes to the folder that spark.checkpoint.dir names, which the driver and all executors share, and is deleted when
    Spark ends. A local run without that setting uses a folder of its own; on a cluster the setting must be there.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(context, "_plexweave_folder", None) or tempfile.mkdtemp(prefix="plexweave-")
        context._plexweave_folder = root
    folder = f"{root.rstrip('/')}/plexweave-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def spread(rows: DataFrame) -> DataFrame:
    """`rows` of a table, dealt out to all cores where it has less than one part of a file for each.

    A task reads whole row groups, so a table of one leaves all cores but one idle, however its bytes are split. Larger
    tables have parts enough and are read in place, and so are those of unknown size.
    """
    context = rows.sparkSession.sparkContext
    part = rows.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(context.defaultParallelism) if size < part * context.defaultParallelism else rows
