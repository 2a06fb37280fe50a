"""Levels that several later steps read are written once, to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def _own_folder(spark: SparkSession) -> str:
    """Where tables go if spark.checkpoint.dir is unset: in local mode a folder of this process, elsewhere the default file system, unless that is each machine's own."""
    if spark.sparkContext.master.split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
        return f"file://{folder}"
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if default.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return f"{default.rstrip('/')}/tmp/leafmill"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, as a full URI. It goes when this process ends, or before by dropped()."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:"):
        atexit.register(shutil.rmtree, "/" + full[5:].lstrip("/"), ignore_errors=True)
    return full


def dropped(spark: SparkSession, folder: str) -> None:
    """Remove a folder of shared_folder() that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str = "levels") -> DataFrame:
    """df written and reread as Parquet."""
    return _written(df, shared_folder(df.sparkSession, name))


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(f"{folder}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")


class Scratch:
    """Tables that are needed for a while: written and reread, and removed together."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.folders = spark, name, []

    def keep(self, df: DataFrame) -> DataFrame:
        folder = shared_folder(self.spark, self.name)
        out = _written(df, folder)
        self.folders.append((folder, out))
        return out

    def slim(self, df: DataFrame) -> DataFrame:
        """keep() for tables of a few numbers a row: in at most four files for each core, as starting a file costs more than it holds."""
        return self.keep(df.coalesce(4 * self.spark.sparkContext.defaultParallelism))

    def tidy(self, *done: DataFrame) -> None:
        """Remove tables that are done with, and let the driver forget finished plans, so that Spark removes their shuffle files now and not when memory happens to run short."""
        for folder, df in self.folders:
            if any(df is d for d in done):
                dropped(self.spark, folder)
        self.folders = [(f, df) for f, df in self.folders if not any(df is d for d in done)]
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        self.tidy(*[df for _, df in self.folders])


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    """A Scratch whose tables go at the end; what is returned from the block must not read them."""
    own = Scratch(spark, name)
    try:
        yield own
    finally:
        own.clear()
