"""Samples that any partitioning repeats: hashes of a seed and a key stand in for chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: int, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def random_sample(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows by hash order: a top-n that needs no global sort."""
    return df.withColumn("_draw", draw_key(seed, key)).orderBy("_draw", key).limit(n).drop("_draw")


def per_group(df: DataFrame, by: str, n: int, key: str, seed: int = 1) -> DataFrame:
    order = Window.partitionBy(by).orderBy(draw_key(seed, key), key)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def balanced(df: DataFrame, label: str, n: int, key: str, seed: int = 1, classes: tuple = ("yes", "no")) -> DataFrame:
    """n // classes rows of each class, with their place in a second hash order as `place`."""
    some = per_group(df.filter(F.col(label).isin(*classes)), label, n // len(classes), key, seed)
    return some.withColumn("_all", F.lit(0)).withColumn("place", F.row_number().over(Window.partitionBy("_all").orderBy(draw_key(seed + 1, key), key))).drop("_all")


#: Parts of a draw by its first hexadecimal digits: a stratum's threshold is found among 16 to that power counts.
PART_DIGITS = 3


def first_drawn(df: DataFrame, by: str, shares: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """The first _share rows of each stratum, or all it has, in the order of their draws, shares (by, _share); strata without a share have none.

    No task gets a stratum: rows are counted by stratum and part of the draw, running
    counts name the part in which a stratum's share ends, parts before it are kept whole,
    and only the rows of that part are numbered. Keys are meant to differ; rows that
    share one have one draw and stay together.
    """
    drawn = df.withColumn("_draw", draw_key(seed, key)).withColumn("_part", F.substring("_draw", 1, PART_DIGITS))
    counts = drawn.groupBy(by, "_part").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_size", F.sum("_c").over(Window.partitionBy(by))).join(shares, by)
    ends = ends.withColumn("_share", F.least("_share", "_size")).filter((F.col("_upto") >= F.col("_share")) & (F.col("_share") > 0))
    first = F.min(F.struct("_part", (F.col("_share") - (F.col("_upto") - F.col("_c"))).alias("_need"))).alias("_end")
    ends = ends.groupBy(by).agg(first).select(by, F.col("_end._part").alias("_last"), F.col("_end._need").alias("_need"))
    met = drawn.join(ends, by)
    whole = met.filter(F.col("_part") < F.col("_last"))
    order = Window.partitionBy(by, "_part").orderBy("_draw", key)
    cut = met.filter(F.col("_part") == F.col("_last")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= F.col("_need"))
    return whole.select(*df.columns).union(cut.select(*df.columns))


def stratified(df: DataFrame, by: str, n: int, key: str, seed: int = 1) -> DataFrame:
    """floor(n * size / all) rows of each stratum: exact shares, not chances."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    shares = sizes.join(F.broadcast(total)).select(by, F.floor(F.lit(float(n)) * (F.col("_size") / F.col("_total"))).alias("_share"))  # total: one row
    return first_drawn(df, by, shares, key, seed)


def cut_large(df: DataFrame, by: list[str], draw: list[Column | str], many: int = 20, n: int = 5) -> DataFrame:
    """Groups of `many` rows or more are cut to the first n of a draw; smaller ones stay.

    Only the first `many` rows of a group are ever brought together: a limit on the rank
    is applied before the shuffle, and as many rows as that tell a large group.
    """
    group = Window.partitionBy(*by)
    some = df.withColumn("_n", F.row_number().over(group.orderBy(*draw))).filter(F.col("_n") <= max(many, n))
    return some.withColumn("_size", F.count("*").over(group)).filter((F.col("_size") < many) | (F.col("_n") <= n)).drop("_size", "_n")


def retain(df: DataFrame, by: str, key: str, many: int = 20, n: int = 5, seed: int = 1) -> DataFrame:
    """Groups of `many` rows or more are cut to n by hash; smaller ones stay."""
    return cut_large(df, [by], [draw_key(seed, key), key], many, n)
