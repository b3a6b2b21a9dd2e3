"""Mixing by hierarchical budgets: weights go down a domain, language, source tree; leaves are cut from seeded epochs.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = ("domain", "lang", "source")
#: Weights among siblings by level and name; others have OTHER. Whole numbers, so that budgets are exact.
WEIGHTS: Mapping[str, Mapping[str, int]] = {"lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}
OTHER = 1
#: Tokens wanted per thousand that there are, times that a document may be taken, and the seed of the epochs' orders.
PER_MILLE, EPOCHS, SEED = 800, 2, 20
#: Parts of the order of a leaf's epoch, by the first hexadecimal digits of its key.
PART_DIGITS = 2


def tokens(text: Column) -> Column:
    """Words of the text: what mixing counts."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def domain(source: Column) -> Column:
    """A source's domain where no table names it: one of four by the first digit of its MD5."""
    return F.concat(F.lit("d"), F.translate(F.substring(F.md5(source.cast("binary")), 1, 1), "0123456789abcdef", "0123012301230123"))


def _weight(level: str, name: Column, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(OTHER).cast("long")
    for value, weight in weights.get(level, {}).items():
        out = F.when(name == value, F.lit(weight).cast("long")).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Share each parent's `above` among children (weight, room) by weight, as column `budget`.

    Children whose room lies below the common level are full and leave the rest to their
    siblings. In the order of room by weight a child is full if those up to it, with the
    others at its level, need no more than there is. Whole numbers: shares are rounded
    down, and what rounding leaves goes by one to the first children that have room.
    """
    among = Window.partitionBy(*parents)
    order = among.orderBy((F.col("room") / F.col("weight")).asc(), F.col(name).asc())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    all_weight = F.sum("weight").over(among)
    out = nodes.withColumn("_c", F.sum("room").over(upto)).withColumn("_w", all_weight - F.sum("weight").over(upto))
    out = out.withColumn("_full", (F.col("_c") * F.col("weight") + F.col("room") * F.col("_w")) <= F.col("above") * F.col("weight"))
    out = out.withColumn("_left", F.col("above") - F.sum(F.when(F.col("_full"), F.col("room")).otherwise(0)).over(among))
    out = out.withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(among))
    share = F.expr("(_left * weight) div _open")
    out = out.withColumn("_base", F.when(F.col("_full"), F.col("room")).otherwise(F.least("room", share)))
    out = out.withColumn("_spare", F.col("above") - F.sum("_base").over(among))
    open_first = F.sum(F.when(F.col("_base") < F.col("room"), 1).otherwise(0)).over(among.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    one = (F.col("_base") < F.col("room")) & (open_first <= F.col("_spare"))
    return out.withColumn("budget", F.col("_base") + one.cast("long")).drop("_c", "_w", "_full", "_left", "_open", "_base", "_spare")


def budgets(leaves: DataFrame, wanted: Column, weights: Mapping[str, Mapping[str, int]], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, leaf_tokens) with leaf_budget: `wanted` tokens of all, at most epochs times a leaf.

    A shortage goes to siblings first: a parent gives up budget only when all below it is
    full, for its room is the sum of its leaves' rooms.
    """
    rooms = leaves.withColumn("room", F.col("leaf_tokens") * F.lit(epochs))
    all_room = rooms.agg(F.coalesce(F.sum("room"), F.lit(0)).alias("_room"), F.coalesce(F.sum("leaf_tokens"), F.lit(0)).alias("_tokens"))
    nodes, parents = None, []
    for level in LEVELS:
        here = rooms.groupBy(*parents, level).agg(F.sum("room").alias("room")).withColumn("weight", _weight(level, F.col(level), weights))
        if nodes is None:
            here = here.crossJoin(F.broadcast(all_room.select(F.least(wanted, F.col("_room")).alias("above")))).withColumn("_root", F.lit(0))  # one row
            nodes = fill(here, ["_root"], level).drop("_root")
        else:
            nodes = fill(here.join(nodes.select(*parents, F.col("budget").alias("above")), parents), parents, level)
        parents.append(level)
    return leaves.join(nodes.select(*LEVELS, F.col("budget").alias("leaf_budget")), list(LEVELS))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, per_mille: int = PER_MILLE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies, leaf_tokens, leaf_budget) of the rows that the mixture takes.

    Budget: per_mille of all tokens. An epoch of a leaf is its rows in the order of
    md5(seed, epoch, doc_id); a budget of b tokens takes b div leaf_tokens whole epochs
    and, of the next, the rows whose tokens end within the rest: copies counts both.
    Running sums are added from parts of the order, each by the key's first digits, so a
    hot source meets in no task. Rows that repeat a doc_id stand together in the order.

    Rows without words (null and empty texts too) have no tokens and are never taken.
    Null lang or source is the empty name. A null doc_id has the key of an empty one. No
    rows give no rows. A `domain` column is used if there is one; other columns are
    ignored.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    given = F.coalesce(F.col("domain").cast("string"), F.lit("")) if "domain" in docs.columns else domain(source)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), given.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"), tokens(F.col("text").cast("string")).alias("n_tokens"))
    rows = written(rows.filter("n_tokens > 0"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"))
    wanted = F.expr(f"(_tokens * {int(per_mille)}) div 1000")
    shares = budgets(leaves, wanted, weights, epochs)
    whole = F.expr("leaf_budget div leaf_tokens")
    placed = rows.join(shares, list(LEVELS)).withColumn("whole", whole)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # dealt anew: the join's partitions, by leaf, would do for the windows below and bring a hot leaf into one task
    placed = placed.withColumn("key", key).withColumn("part", F.substring("key", 1, PART_DIGITS)).repartition(*LEVELS, "part")
    parts = placed.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("part_tokens"))
    ahead = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*LEVELS, "part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*LEVELS, "part").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_inside", F.sum("n_tokens").over(inside)).join(parts, [*LEVELS, "part"])
    rest = F.col("leaf_budget") - F.col("whole") * F.col("leaf_tokens")
    copies = F.col("whole") + (F.col("ahead") + F.col("_inside") <= rest).cast("long")
    return summed.select("doc_id", *LEVELS, "n_tokens", copies.alias("copies"), "leaf_tokens", "leaf_budget").filter("copies > 0")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mixture takes, all columns kept, each as often as it is taken. See mix()."""
    taken = mix(docs, **how).groupBy(F.col("doc_id").alias("_taken"), F.col("n_tokens").alias("_tokens")).agg(F.max("copies").alias("_copies"))
    counted = docs.withColumn("_n", tokens(F.col("text").cast("string")))
    joined = counted.join(taken, counted["doc_id"].cast("long").eqNullSafe(F.col("_taken")) & (F.col("_n") == F.col("_tokens")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
