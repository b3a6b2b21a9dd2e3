"""SimHash fingerprints of whole texts, and groups of texts whose fingerprints are near, found with BK-trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import small_batches, written
from .components import connected_components
from .hamming import buckets

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
_CHUNK = 1 << 16
_FULL = (1 << 64) - 1


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> Iterator[bytes]:
    """Runs of `words` words, A-Z in lower case, space-joined; a shorter text is one run, an empty one has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    whole = b" ".join(parts)
    if len(parts) <= words:
        yield whole
        return
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts])[: len(parts) - words + 1].tolist()
    for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True):
        yield whole[a:b]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if over half of the shingles' XXH64 values (seed 42) have it; no words: 0."""
    hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles(text, words)], dtype="<u8")
    if not len(hashes):
        return 0
    if len(hashes) == 1:
        return int(hashes[0])
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent; a search follows only edges within the radius."""

    def __init__(self, codes: Iterable[int]):
        self.root: tuple[int, dict] | None = None
        for code in codes:
            self.add(code)

    def add(self, code: int) -> None:
        if self.root is None:
            self.root = (code, {})
            return
        node = self.root
        while d := (code ^ node[0]).bit_count():
            if (child := node[1].get(d)) is None:
                node[1][d] = (code, {})
                return
            node = child

    def within(self, code: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            d = (code ^ at).bit_count()
            if d <= radius:
                found.append(at)
            for edge in range(max(1, d - radius), d + radius + 1):
                if edge in children:
                    stack.append(children[edge])
        return found


def forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is within the radius of each other: one fewer than nodes for each connected part."""
    tree, parent = BKTree(members), {m: m for m in members}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for m in members:
        for other in tree.within(m, radius):
            a, b = top(m), top(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(m, r) for m in members if (r := top(m)) != m]


def _fingerprints(batches):
    for b in batches:
        values = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], names=["doc_id", "code"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code bigint) of documents: the fingerprint's 64 bits as a signed number."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, code long")


def near_edges(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that connect all codes within the radius, of a spanning forest of each bucket.

    Each bucket of the pigeonhole index is a shard with a BK-tree of its own, searched
    for each member; no task gets all fingerprints and the driver gets none.
    """

    def link(batches):
        for b in batches:
            edges = [e for members in b.column(0).to_pylist() for e in _signed_forest(members, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    return buckets(codes, radius).mapInArrow(link, "a long, b long")


def _signed_forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    # Python's bit_count is of the absolute value: compare the codes as unsigned numbers
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    return [(sign(a), sign(b)) for a, b in forest([m & _FULL for m in sorted(members)], radius)]


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by fingerprints at `radius` or fewer differing bits.

    component_id is the smallest doc_id reachable over links, the document's own
    included. Equal fingerprints are linked, so each value is searched once however many
    documents have it. Null and empty texts, and texts without words, have fingerprint
    zero and are linked like any other. Texts of any length count whole. Repeated rows
    give a row each. A null doc_id is never a component_id, unless no document of its
    group has an id: then that is null. No rows give no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs))
    least = written(prints.groupBy("code").agg(F.min("doc_id").alias("least")))
    groups = connected_components(near_edges(least.select("code"), radius))
    classes = least.join(groups, least["code"] == groups["node"], "left").select(least["code"], "least", F.coalesce("component", least["code"]).alias("component"))
    heads = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    members = classes.join(heads, "component").select("code", "component_id")
    return prints.join(members, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicate group, all columns kept.

    Rows that repeat such a doc_id are reduced to one. Rows without a doc_id stay only
    where no row of their group has one.
    """
    return only_heads(docs, written(near_duplicate_groups(docs, radius)))


def only_heads(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs that groups (doc_id, component_id) have as their own component, one for each doc_id."""
    heads = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counts = heads.groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = docs.join(counts.select(F.col("doc_id").alias("_head"), "_rows"), docs["doc_id"].cast("long").eqNullSafe(F.col("_head")))
    once = kept.filter(F.col("_rows") == 1).drop("_head", "_rows")
    if counts.filter(F.col("_rows") > 1).isEmpty():
        return once
    return once.union(kept.filter(F.col("_rows") > 1).drop("_head", "_rows").dropDuplicates(["doc_id"]))
