"""Resuming, positions, batches, lookups and sections: relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Rows numbered from 0 in an order, over range partitions: counts of partitions are added to places inside.

    No task gets all rows: a range exchange sorts, and only a count for each partition is
    summed up. The sorted rows are written once, so that the counts are of the partitions
    that the rows were numbered in, whatever other columns there are.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    inside = written(ranged.select("*", (F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)).alias("_i")).drop("_m"))
    counts = inside.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row for each partition of the exchange: as few as the session's shuffle partitions
    return inside.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def slice_rows(df: DataFrame, order: list[str], start: int, end: int) -> DataFrame:
    """Rows start to end - 1 of an order: the first `end` by a top-n, numbered among themselves."""
    first = df.orderBy(*order).limit(end)
    return first.withColumn("_all", F.lit(0)).withColumn("pos", F.row_number().over(Window.partitionBy("_all").orderBy(*order)) - 1).drop("_all").filter(F.col("pos") >= start)


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with batch_id: each `size` rows of an order."""
    return position(df, order).withColumn("batch_id", F.expr(f"pos div {int(size)}")).drop("pos")


def last_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key: the last in an order, as later entries of a dictionary replace earlier ones."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def first_occurrence(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """One row of each key: the first in an order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def line_sections(lines: DataFrame, doc: str, pos: str, is_header: Column) -> DataFrame:
    """Lines with section_id: headers up to and with the line, in its document."""
    upto = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section_id", F.sum(is_header.cast("int")).over(upto))


def evidence_sections(lines: DataFrame, evidence: DataFrame, doc: str, line: str = "line") -> DataFrame:
    """Lines (doc, section_id, line) of section 0 and of sections that hold a line of the document's evidence (doc, line), as it is written."""
    held = lines.join(evidence.select(doc, line).distinct(), [doc, line], "left_semi").select(doc, "section_id").distinct()
    return lines.join(held.withColumn("_held", F.lit(True)), [doc, "section_id"], "left").filter((F.col("section_id") == 0) | F.col("_held")).drop("_held")


def unpivot_map(df: DataFrame, entries: Column, key: str, value: str) -> DataFrame:
    """A row for each entry of a map column."""
    return df.select("*", F.explode(entries).alias(key, value))


def zip_by_position(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    return a.join(b, pos)


def answerable(df: DataFrame, flag: str, answers: str) -> DataFrame:
    """Rows that aren't flagged as unanswerable and whose list of answers isn't empty; a null flag is none, a null list is empty."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)) & (F.coalesce(F.size(answers), F.lit(0)) > 0))


def with_document(examples: DataFrame, documents: DataFrame, key: str, order: list[str]) -> DataFrame:
    """examples with the other columns of the first document, in an order, that has their key; examples without one go."""
    others = [c for c in documents.columns if c not in examples.columns]
    first = documents.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_document"))
    return examples.join(first, key).select(*examples.columns, "_document.*")


def merged_maps(left: Column, right: Column) -> Column:
    """Entries of both maps; of a key that both have the right one's, null values too. A null map has no entries."""
    empty = F.map_filter(F.coalesce(left, right), lambda k, v: F.lit(False))
    return F.map_zip_with(F.coalesce(left, empty), F.coalesce(right, empty), lambda k, x, y: F.when(F.map_contains_key(F.coalesce(right, empty), k), y).otherwise(x))


def in_pandas(df: DataFrame, most: int = 100_000):
    """df as a pandas table, for data sets of a known size: more than `most` rows are refused before any reaches the driver."""
    if len(df.limit(most + 1).select(F.lit(1)).take(most + 1)) > most:
        raise ValueError(f"over {most} rows: write them instead")
    return df.toPandas()
