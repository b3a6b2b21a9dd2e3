"""Near copies: BK-trees find fingerprints within a wide radius, MinHash bands what lies beyond, shared shingles decide."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import drop_written, small_batches, tiled, written
from .components import connected_components
from .simhash import SEED, fingerprint, only_heads, shingles

#: Words of a fingerprint's shingles, and bits in which fingerprints of candidates differ at most.
PRINT_WORDS, RADIUS = 2, 7
#: Words of the shingles that decide, and the least Jaccard similarity of their sets.
WORDS, SIMILARITY = 5, 0.8
#: Smallest hashes of a text's shingles by which texts far from the least similarity are told: all decide the others.
SKETCH, FAR = 1024, 0.1
#: Bands of MinHash values of the shingles that decide, and values of a band: of pairs at 0.8 all but 3 in a million share one.
BANDS, ROWS = 24, 4
#: Fingerprints for which a bucket aims, and above which it is compared in tiles.
BUCKET_CODES, TILE_CODES = 1024, 2000
#: Classes of a band from which it is compared in tiles: these carry whole shingle sets, 80 KB for a text of 20,000 words.
TILE_SETS = 400
#: Fingerprints searched at once in a tree.
_QUERIES = 256
#: Hashes of a text whose MinHash values are taken at once.
_CHUNK = 4096


def masks(rows: int, radius: int, aim: int = BUCKET_CODES) -> list[int]:
    """Bits that each table reads: of radius + m runs, codes within the radius agree in m; m grows with the rows."""
    for m in range(1, 5):
        runs = radius + m
        if m == 4 or rows >> (64 * m // runs) <= aim:
            break
    cuts = [64 * k // runs for k in range(runs + 1)]
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, m)]


class Tree:
    """A BK-tree of different codes, built level by level: child[n, d] is n's child at distance d."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.child = codes, np.full((len(codes), 65), -1, dtype=np.int32)
        slots, rest = self.child.reshape(-1), np.arange(1, len(codes))
        at = np.zeros(len(rest), dtype=np.int64)
        while len(rest):
            slot = at * 65 + np.bitwise_count(codes[rest] ^ codes[at])
            taken, first = np.unique(slot, return_index=True)
            slots[taken] = rest[first]
            at = slots[slot].astype(np.int64)
            rest, at = rest[at != rest], at[at != rest]

    def within(self, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index in wanted, index in codes) of all that are near; only edges within the radius are followed."""
        found = []
        for start in range(0, len(wanted) if len(self.codes) else 0, _QUERIES):
            q = np.arange(start, min(start + _QUERIES, len(wanted)))
            node = np.zeros(len(q), dtype=np.int64)
            while len(q):
                d = np.bitwise_count(wanted[q] ^ self.codes[node]).astype(np.int64)
                near = d <= radius
                found.append((q[near], node[near]))
                steps = []
                for off in range(-radius, radius + 1):
                    edge = d + off
                    child = self.child[node, np.clip(edge, 0, 64)]
                    go = (child >= 0) & (edge >= 1) & (edge <= 64)
                    steps.append((q[go], child[go].astype(np.int64)))
                q, node = (np.concatenate(x) for x in zip(*steps, strict=True))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _met(tables: list[int], table: int, codes: np.ndarray, blocks: np.ndarray, one: int, two: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different places of a tile that are near and meet in no earlier table; codes are distinct within a block."""
    left = np.nonzero(blocks == one)[0]
    right = left if one == two else np.nonzero(blocks == two)[0]
    kinds, place = np.unique(codes[right], return_inverse=True)
    q, k = Tree(kinds).within(codes[left], radius)
    order = np.argsort(place, kind="stable")
    starts, sizes = np.searchsorted(place[order], k), np.bincount(place, minlength=len(kinds))[k] if len(kinds) else k
    i = left[np.repeat(q, sizes)]
    j = right[order[np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]]
    if one == two:
        i, j = i[i < j], j[i < j]
    apart = codes[i] ^ codes[j]
    for mask in tables[:table]:
        new = (apart & np.uint64(mask)) != 0
        i, j, apart = i[new], j[new], apart[new]
    return i, j


def sketch(text: str | None, words: int = WORDS) -> tuple[np.ndarray, int]:
    """All of a text's different shingle hashes (32 bits, sorted), and how many there are."""
    hashes = np.unique(np.array([xxh64_intdigest(s, SEED + 1) >> 32 for s in shingles(text, words)], dtype=np.uint32))
    return hashes, len(hashes)


def jaccard(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Of two sets of sorted hashes; of large ones it is estimated from the SKETCH smallest of both where that is FAR below similarity."""
    if min(len(a), len(b)) > SKETCH:
        least = np.union1d(a[:SKETCH], b[:SKETCH])[:SKETCH]
        both = np.intersect1d(a[:SKETCH], b[:SKETCH], assume_unique=True)
        estimate = np.searchsorted(both, least[-1], side="right") / len(least)
        if estimate < similarity - FAR:
            return estimate
    both = np.intersect1d(a, b, assume_unique=True)
    return len(both) / max(1, len(a) + len(b) - len(both))


_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """Signed 64-bit bands of a set of hashes, none of an empty one: sets share one as often as their Jaccard similarity tells."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 1 << 32, dtype=np.uint64)
    for start in range(0, len(hashes), _CHUNK):
        x = hashes[start : start + _CHUNK].astype(np.uint64)[None, :] * _ODD[:, None]
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, (x >> np.uint64(32)).min(axis=1), out=least)
    values, key = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key + values[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def _bands(batches):
    for b in batches:
        keys = [bands(np.frombuffer(x, dtype=np.uint32)) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "bands"])


def _meetings(sketches: DataFrame) -> DataFrame:
    """(ids array<bigint>): classes of sketches (id, sketch) that share a band, in tiles, once for each set."""
    rows = written(sketches.select("id", "sketch").mapInArrow(_bands, "id long, bands array<long>").select("id", F.explode("bands").alias("band")))
    shared = rows.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("band")
    met = written(rows.join(shared, "band"))
    drop_written(rows)
    return tiled(met, ["band"], "id", TILE_SETS).groupBy("band", "tile").agg(F.array_sort(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1).select("ids").distinct()


def _prints(batches):
    for b in batches:
        codes, sketches, counts = [], [], []
        for text in b.column(1).to_pylist():
            codes.append(fingerprint(text, PRINT_WORDS))
            least, n = sketch(text)
            sketches.append(least.tobytes())
            counts.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(codes, dtype=np.uint64).view(np.int64)), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "code", "n", "sketch"])


def near_copy_groups(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of documents linked by near copies; component_id is the smallest doc_id reachable.

    Texts are linked if the sets of their shingles of five words have a Jaccard similarity
    of at least `similarity` and they were brought together: by fingerprints that differ
    in at most `radius` bits or by a common band of MinHash values. All shingles' hashes
    decide. Texts with equal shingles are one class, and so are null and empty ones.
    Tables of bits bring candidates together, a BK-tree of each tile finds them; sketches
    are fetched only for classes with a candidate, and a tile gives a spanning forest, no
    pairs. A null doc_id is never a component_id unless its group has no other.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(text.mapInArrow(_prints, "doc_id long, code long, n long, sketch binary").withColumn("mark", F.xxhash64("sketch", "n")))
    classes = written(prints.groupBy("code", "mark").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    tables = masks(classes.count(), radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("code").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(tables)])
    keyed = classes.select("id", "code", F.explode(keys).alias("k")).select("id", "code", "k.table", "k.key")
    dealt = tiled(keyed, ["table", "key"], "id", TILE_CODES)
    tiles = dealt.groupBy("table", "key", "tile").agg(F.collect_list(F.struct("id", "code", "block")).alias("members")).filter(F.size("members") > 1)

    def arrays(members):
        members.sort(key=lambda m: m["id"])
        return np.array([m["code"] for m in members], dtype=np.int64).view(np.uint64), np.array([m["block"] for m in members])

    def involved(batches):
        for b in batches:
            out = {"table": [], "key": [], "one": [], "two": [], "id": [], "code": [], "block": []}
            for row in b.to_pylist():
                members = row["members"]
                codes, blocks = arrays(members)
                i, j = _met(tables, row["table"], codes, blocks, row["one"], row["two"], radius)
                for m in np.unique(np.concatenate([i, j])).tolist():
                    for name, value in zip(out, (row["table"], row["key"], row["one"], row["two"], members[m]["id"], members[m]["code"], members[m]["block"]), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("table", pa.int32()), ("key", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("id", pa.int64()), ("code", pa.int64()), ("block", pa.int32())]))

    hits = written(tiles.select("table", "key", "tile.one", "tile.two", "members").mapInArrow(involved, "table int, key long, one int, two int, id long, code long, block int"))
    wanted = hits.select("id").distinct().join(classes.select("id", "code", "mark"), "id")
    sketches = prints.join(wanted, ["code", "mark"]).groupBy("id").agg(F.min("sketch").alias("sketch"))
    groups = hits.join(sketches, "id").groupBy("table", "key", "one", "two").agg(F.collect_list(F.struct("id", "code", "block", "sketch")).alias("members"))

    def verify(batches):
        for b in batches:
            out: list[tuple[int, int]] = []
            for row in b.to_pylist():
                members = row["members"]
                codes, blocks = arrays(members)
                sets, parent = [np.frombuffer(m["sketch"], dtype=np.uint32) for m in members], list(range(len(members)))

                def top(x: int, parent=parent) -> int:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for i, j in zip(*(x.tolist() for x in _met(tables, row["table"], codes, blocks, row["one"], row["two"], radius)), strict=True):
                    p, q = top(i), top(j)
                    if p != q and jaccard(sets[i], sets[j], similarity) >= similarity:
                        parent[max(p, q)] = min(p, q)
                out += [(m["id"], members[r]["id"]) for k, m in enumerate(members) if (r := top(k)) != k]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    def compare(batches):
        for b in batches:
            out: list[tuple[int, int]] = []
            for members in b.column(0).to_pylist():
                members.sort(key=lambda m: m["id"])
                sets = [np.frombuffer(m["sketch"], dtype=np.uint32) for m in members]
                sizes, part = np.array([len(x) for x in sets]), np.arange(len(members))
                for i in range(len(members)):
                    for j in np.flatnonzero((part != part[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))).tolist():
                        if j > i and part[i] != part[j] and jaccard(sets[i], sets[j], similarity) >= similarity:
                            part[part == part[j]] = part[i]
                out += [(members[k]["id"], members[r]["id"]) for k, r in enumerate(part.tolist()) if r != k]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    whole = prints.join(classes.select("id", "code", "mark"), ["code", "mark"]).groupBy("id").agg(F.min("sketch").alias("sketch"))
    places = written(_meetings(whole).select(F.monotonically_increasing_id().alias("meeting"), "ids")).select("meeting", F.explode("ids").alias("id"))
    met = places.join(whole, "id").groupBy("meeting").agg(F.collect_list(F.struct("id", "sketch")).alias("members")).select("members").mapInArrow(compare, "a long, b long")
    parts = connected_components(groups.select("table", "key", "one", "two", "members").mapInArrow(verify, "a long, b long").union(met))
    grouped = classes.join(parts, F.col("id") == F.col("node"), "left").select("code", "mark", "least", F.coalesce("component", "id").alias("part"))
    heads = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "code", "mark").join(grouped.join(heads, "part").select("code", "mark", "component_id"), ["code", "mark"]).select("doc_id", "component_id")


def one_of_each_near_copy(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near copies, all columns kept.

    Rows that repeat such a doc_id are reduced to one; no rows give no rows.
    """
    return only_heads(docs, written(near_copy_groups(docs, radius, similarity)))
