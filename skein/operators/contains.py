"""Words inside names: an equi-join over pieces of three characters instead of trying each word on each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece.
PIECE = 3


def pieces(text: Column, size: int = PIECE) -> Column:
    """The distinct pieces of `size` characters of a text; none of a shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _keyed(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, piece): each word of three characters or more with that of its pieces which fewest names hold; a word with a piece that no name holds is left out, for no name can hold it."""
    each = words.select("word", F.explode(pieces(F.col("word"))).alias("piece"))
    held = names.select(F.explode(pieces(F.col("name"))).alias("piece")).join(each.select("piece").distinct(), "piece", "left_semi")
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    found = each.join(counts, "piece", "left").groupBy("word").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "piece"))["piece"].alias("piece"))
    return found.filter("absent = 0").select("word", "piece")


def names_with(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name): each name that holds a word, as they are written.

    words (word) and names (name), each once. A word is looked up by its rarest piece
    among the names, one of one or two characters by itself among pieces of that size,
    and only names that share the piece are searched. The empty word is in every name
    that isn't null.
    """
    keyed = _keyed(words.filter(F.length("word") >= PIECE), names)
    met = keyed.join(names.select("name", F.explode(pieces(F.col("name"))).alias("piece")), "piece").filter(F.contains("name", F.col("word"))).select("word", "name")
    sizes = [r["n"] for r in words.filter(F.length("word") < PIECE).select(F.length("word").alias("n")).distinct().collect()]  # 0, 1 and 2 at most
    for size in sorted(sizes):
        each = F.explode(pieces(F.col("name"), size)) if size else F.lit("")
        met = met.union(names.filter("name IS NOT NULL").select("name", each.alias("word")).join(words.filter(F.length("word") == size), "word").select("word", "name"))
    return met
