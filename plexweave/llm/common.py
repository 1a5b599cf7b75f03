"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexweave.session import ship

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches handed to Python hold at most so many rows and bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: send the package, and keep Arrow batches small, so that very long texts do not add up."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_KEPT: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What a worker keeps under a name between its tasks, until one begins there that does not name it."""
    return _KEPT.setdefault(name, {})


def _give_back() -> None:
    """What Arrow and the C library hold unused goes back to the system; where the latter has no call for that, it stays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


@contextmanager
def worker_memory(*names: str) -> Iterator[None]:
    """Around the Python of one task, which uses the caches of these names.

    Workers outlive stages and serve one operator after another: what others have left is dropped first, and unused memory
    goes back to the system, at the end too, as an idle worker has it beside the JVM.
    """
    if others := [cache for name, cache in _KEPT.items() if cache and name not in names]:
        for cache in others:
            cache.clear()
        gc.collect()
    _give_back()
    try:
        yield
    finally:
        _give_back()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, as in tests, a local run gets one of its own; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(context, "_plexweave_folder", None) or tempfile.mkdtemp(prefix="plexweave-")
        context._plexweave_folder = root
    return f"{root.rstrip('/')}/plexweave-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate results as Parquet in the shared folder, so that lineage is cut and superseded ones can go at once.

    What is still there when Spark ends is deleted then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        """`df`, written and read again."""
        folder = shared_folder(self.spark)
        df.write.parquet(folder)
        path, system = self._path(folder)
        system.deleteOnExit(path)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.folders.append((out, folder))
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete what these were read from; nothing may read them any more."""
        for df in kept:
            for pair in [x for x in self.folders if x[0] is df]:
                self.folders.remove(pair)
                path, system = self._path(pair[1])
                system.delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    return Scratch(df.sparkSession).keep(df)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model may learn from; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
