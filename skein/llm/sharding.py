"""Shards by longest processing time: groups that stay together go, largest first, to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_within, written

SHARDS = 16


def place(classes: Iterable[tuple[int, int]], shards: int = SHARDS) -> list[tuple[int, int, int, int]]:
    """(size, first rank, shard, groups): longest processing time over classes (size, number of groups).

    Exactly what a heap of loads gives when the groups come one at a time, largest first
    and ties to the lowest shard. Shards whose loads lie closer to the least than one
    size take turns until they reach the next load above: those rounds are placed at
    once, so the steps depend on classes and shards, not on groups.
    """
    loads = [(0, s) for s in range(shards)]
    heapq.heapify(loads)
    plan: list[tuple[int, int, int, int]] = []
    for size, count in sorted(classes, reverse=True):
        rank = 0
        while rank < count:
            least = loads[0][0]
            turn = sorted(x for x in loads if x[0] - least < size)
            above = min((x[0] for x in loads if x[0] - least >= size), default=None)
            rounds = (count - rank) // len(turn)
            if above is not None:
                rounds = min(rounds, (above - turn[-1][0] - 1) // size + 1)
            if not rounds:
                load, shard = loads[0]
                heapq.heapreplace(loads, (load + size, shard))
                plan.append((size, rank, shard, 1))
                rank += 1
                continue
            for _, shard in turn:
                plan.append((size, rank, shard, rounds))
                rank += rounds
            loads = [(load + rounds * size if load - least < size else load, shard) for load, shard in loads]
            heapq.heapify(loads)
    return plan


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents: law `bytes`, equal texts in one shard.

    size: UTF-8 bytes of the text plus 1. Groups are summed by the text's SHA-256. The
    driver gets the number of groups by exact size: different sizes above 64 KiB are at
    most total / 64 KiB. Ranks within a size and slots within
    a shard are numbered over salted parts, so neither a hot size nor a shard meets in
    one task. slot orders a shard by hash. A group above a fair share makes its shard
    as large as itself.

    Null texts have size 1 and the checksum of no bytes, and form one group with empty
    ones. Rows that repeat are documents of their own. A null doc_id stays null. No rows
    give no rows; other columns are ignored.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("same"))
    rows = written(rows)
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes"))
    n = rows.count()
    classed = groups.withColumn("step", F.col("bytes"))
    plan = place(classed.groupBy("step").agg(F.count("*").alias("n")).toPandas().itertuples(index=False, name=None), shards)
    ranked = number_within(classed.select("same", "step"), ["step"], ["same"], "rank", n)
    by_size: dict[int, tuple[list[int], list[int]]] = {}
    for size, rank, shard, _ in plan:
        firsts, to = by_size.setdefault(int(size), ([], []))
        firsts.append(int(rank))
        to.append(shard)

    def assign(batches):
        from bisect import bisect_right

        for b in batches:
            found = [by_size[s][1][bisect_right(by_size[s][0], r) - 1] for s, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32())], names=["same", "shard"])

    homes = ranked.select("same", "step", "rank").mapInArrow(assign, "same binary, shard int")
    housed = written(rows.join(homes, "same").select("doc_id", "size", "text_crc32", "same", "shard").withColumn("row", F.monotonically_increasing_id()))
    slotted = number_within(housed, ["shard"], ["same", "row"], "slot", n)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
