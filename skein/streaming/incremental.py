"""Processing that can stop and go on: batches, file streams, failures as data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import batches, unprocessed


class ResultTable:
    """A table to which batches are appended exactly once, whatever dies on the way.

    A batch is written to a folder of its own and counts from the moment its mark stands
    in the commit folder, which is one file being made. What a run that died has left of
    a batch is not read, and is replaced when the batch is tried again. One run appends
    at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def committed(self) -> list[str]:
        """The batches that count, by name."""
        files, folder = self._place("_commits")
        return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []

    def commit(self, batch: str) -> None:
        files, mark = self._place("_commits", batch)
        files.create(mark, False).close()

    def append(self, batch: str, rows: Callable[[], DataFrame]) -> bool:
        """Write rows() as a batch and commit it, unless that was done before; whether it was written."""
        if batch in self.committed():
            return False
        rows().write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        self.commit(batch)
        return True

    def read(self) -> DataFrame | None:
        """The rows of all batches that count; None before the first."""
        found = [f"{self.path}/batches/{b}" for b in self.committed()]
        return self.spark.read.parquet(*found) if found else None


def append_new(df: DataFrame, path: str, key: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run step on rows whose key isn't in the table at path yet, append the results as one batch, and return the table."""
    results = ResultTable(df.sparkSession, path)
    done = results.read()
    results.append(f"run-{len(results.committed()):06d}", lambda: step(df if done is None else unprocessed(df, done, key)))
    return results.read()


def run_in_batches(df: DataFrame, path: str, order: list[str], size: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run step on each `size` rows of an order, a batch after the other, and return the table of results.

    Batches are numbered by the order alone, so a run that goes on after another takes up
    the first batch that isn't committed; the input must be the same.
    """
    results, numbered = ResultTable(df.sparkSession, path), batches(df, order, size)
    last = numbered.agg(F.max("batch_id")).first()[0]
    done = set(results.committed())
    for number in range(0 if last is None else last + 1):
        name = f"batch-{number:09d}"
        if name not in done:
            results.append(name, lambda number=number: step(numbered.filter(F.col("batch_id") == number).drop("batch_id")))
    found = results.read()
    return step(df.limit(0)) if found is None else found


def failures(predictions: DataFrame) -> DataFrame:
    """Rows that a later run should try again: a view, so it is empty as soon as none is left."""
    return predictions.filter(F.col("error").isNotNull())


def stream_step(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame]):
    """A stream over new Parquet files of a folder into a ResultTable at sink: each file is processed once and its rows count once, whatever restarts there are, for a micro-batch that is tried again has the number it had."""
    rows, results = spark.readStream.schema(schema).parquet(source), ResultTable(spark, sink)
    return rows.writeStream.foreachBatch(lambda df, number: results.append(f"stream-{number:09d}", lambda: step(df)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type in event-time windows; late rows are waited for. An extension beyond the reference."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
