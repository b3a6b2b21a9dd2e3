"""Buckets in which all 64-bit codes within a Hamming radius meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bucket with more codes than this is split by further bits.
BUCKET_CODES = 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside mask in parts runs of even length, each as a mask that also has the bits of mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def buckets(codes: DataFrame, radius: int, most: int = BUCKET_CODES) -> DataFrame:
    """(members array<bigint>): any two codes that differ in 1 to radius bits share a bucket.

    codes: distinct values in a column `code`. Pigeonhole: of radius + 1 runs of bits, two
    such codes agree in one. A bucket above `most` codes is split in the same way by the
    bits its key leaves free, so hot runs of bits stay exact and bounded: distinct codes
    part at the latest when no bits are free.
    """
    parts = radius + 1
    masks = {(): 0}
    paths: list[tuple[int, ...]] = [()]
    rows = codes.select("code", F.lit(0).alias("path"), F.lit(0).cast("long").alias("value"))
    done: list[DataFrame] = []
    while True:
        finer, cases = [], F.lit(None).cast("array<struct<path:int,value:bigint>>")
        for number, path in enumerate(paths):
            keys = []
            for k, mask in enumerate(_blocks(masks[path], parts)):
                masks[(*path, k)] = mask
                keys.append(F.struct(F.lit(len(finer)).alias("path"), F.col("code").bitwiseAND(F.lit(_signed(mask))).alias("value")))
                finer.append((*path, k))
            if keys:
                cases = F.when(F.col("path") == number, F.array(*keys)).otherwise(cases)
        keyed = rows.select("code", F.explode(cases).alias("key")).select("code", "key.path", "key.value")
        counted = keyed.groupBy("path", "value").agg(F.count("*").alias("n"))
        hot = counted.filter(F.col("n") > most).select("path", "value")
        splits = not hot.isEmpty()
        cool = keyed.join(hot, ["path", "value"], "left_anti") if splits else keyed
        done.append(cool.groupBy("path", "value").agg(F.collect_list("code").alias("members")).filter(F.size("members") > 1).select("members"))
        if not splits:
            break
        rows, paths = keyed.join(hot, ["path", "value"], "left_semi"), finer
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out
