"""What the operators of this subpackage share: tables, written cuts of the lineage, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_written, shared_dir, written
from ..sources.tables import table

__all__ = ["drop_written", "in_tiles", "number_within", "shared_dir", "small_batches", "table", "tiled", "written"]

#: Rows of an Arrow batch sent to Python; whole texts may be long, so a batch stays small.
BATCH_ROWS = 512
#: Bytes of such a batch, where Spark knows the setting.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; a lower bound that is already set stays."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows if rows > 0 else BATCH_ROWS, BATCH_ROWS)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, rows: int, per_salt: int = 50_000) -> DataFrame:
    """Number the rows of each key from 0 without gaps.

    No task gets a whole key: rows are dealt by (key, salt), counted per pair, and the
    pairs' running counts are added to the row numbers inside a pair. rows: about how
    many there are, from which the number of salts follows. keys must not be null.
    """
    salts = max(64, -(-rows // per_salt))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    pair = [*keys, "_salt"]
    counts = salted.groupBy(*pair).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pair, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*pair).orderBy(*order)) - 1
    return salted.withColumn("_inside", inside).join(offsets, pair).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_salt", "_inside", "_before")


def tiled(rows: DataFrame, keys: Sequence[str], unit: str, most: int) -> DataFrame:
    """rows with `block` and `tile` (one, two): a key with more than `most` rows is dealt in tiles of two blocks.

    In a tile whose numbers are equal all its rows are compared, in others those of block
    one with those of block two; so any two rows of a key meet in one tile. keys must not
    be null; unit decides the block.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_blocks"))
    return in_tiles(rows.join(hot, list(keys), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))), unit, "_blocks")


def in_tiles(rows: DataFrame, unit: str, blocks: str) -> DataFrame:
    """rows with `block` and `tile` as in tiled(), of as many blocks as column `blocks` says, which goes."""
    block = F.pmod(F.xxhash64(unit, F.lit(7)), F.col(blocks)).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("one"), F.greatest(o, F.col("block")).alias("two")))
    alone = F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("two")))
    return rows.withColumn("block", block).withColumn("tile", F.explode(F.when(F.col(blocks) > 1, others).otherwise(alone))).drop(blocks)
