"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes a query's shuffle files when it ends instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local master gets a temporary one; a cluster is refused."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/skein/{uuid.uuid4().hex}"


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query go as soon as it has ended, so that disks hold those of one query at a time."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, by: str | None = None, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, in a folder for each value of `by`: cuts the lineage, and survives a lost executor."""
    path = new_path(df.sparkSession)
    with no_shuffles_left(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def _place(df: DataFrame):
    """The file system and the path of a table that written() made."""
    jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(df._skein_path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that written() made, once nothing reads it."""
    if getattr(df, "_skein_path", None):
        files, where = _place(df)
        files.delete(where, True)
