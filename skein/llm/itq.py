"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the original vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tiled, written
from .components import connected_components

COSINE = 0.9
#: Rows, at most about, from which the rotations are learned.
SAMPLE_ROWS = 20_000
#: Share of the links at exactly the cosine wanted that the tables are laid out to find; closer links are found more surely.
RECALL = 0.98
#: Tables at least, however short their keys are.
LEAST_TABLES = 8
#: Vectors for which a table aims in one bucket, and above which a bucket is compared in tiles.
BUCKET_ROWS, TILE_ROWS = 200, 1500
ITERATIONS = 30


@dataclass
class Index:
    """Learned rotations and the layout of the tables: table t reads `bits` bits of code t // per_code."""

    dim: int
    rotations: list[np.ndarray]
    code_bits: int
    bits: int
    tables: int
    radius: int

    @property
    def per_code(self) -> int:
        return self.code_bits // self.bits

    def codes(self, unit: np.ndarray) -> list[np.ndarray]:
        """64-bit codes of unit vectors, one for each rotation, as signed numbers."""
        out = []
        for rotation in self.rotations:
            on = unit @ rotation >= 0
            wide = np.zeros((len(unit), 64), dtype=np.uint8)
            wide[:, : self.code_bits] = on
            out.append(np.packbits(wide, axis=1, bitorder="little").view("<u8").reshape(-1).view(np.int64))
        return out


def learn_rotation(sample: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Project on the principal axes, then turn them so that signs lose least: alternate sign codes and a Procrustes step.

    Vectors aren't centred: a hot group would be the centre, and its members' signs noise.
    """
    _, _, axes = np.linalg.svd(sample.T @ sample if len(sample) > 1 else np.eye(sample.shape[1]))
    axes = axes[:bits].T
    low = sample @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(ITERATIONS if len(sample) > bits else 0):
        u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    return axes @ turn


def lay_out(rows: int, dim: int, sample: np.ndarray, cosine: float, recall: float) -> Index:
    """Bits of a table follow from the rows, tables from the chance that a link agrees in all of them."""
    code_bits = min(64, dim)
    differ = math.acos(cosine) / math.pi
    bits = min(max(1, round(math.log2(max(rows, 1) / BUCKET_ROWS))), code_bits, 40)
    tables = max(LEAST_TABLES, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits)))
    codes = -(-tables // (code_bits // bits))
    total = codes * code_bits
    radius = math.ceil(differ * total + 2.5 * math.sqrt(total * differ * (1 - differ)) + 1)
    return Index(dim, [learn_rotation(sample, code_bits, seed) for seed in range(codes)], code_bits, bits, tables, radius)


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors as doubles, filled up with zeros to dim."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), dim))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    # the largest element first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _candidates(index: Index, table: int, codes: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairs (i in left, j in right, i before j where both are in both) near in all bits, whose first common table this is."""
    mask, same = (1 << index.bits) - 1, left is right
    keys = [codes[t // index.per_code] >> np.int64(t % index.per_code * index.bits) & np.int64(mask) for t in range(table)]
    step = max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        apart = sum(np.bitwise_count((c[i][:, None] ^ c[right][None, :]).view(np.uint64)).astype(np.int16) for c in codes)
        a, b = np.nonzero(apart <= index.radius)
        a, b = i[a], right[b]
        if same:
            a, b = a[a < b], b[a < b]
        for k in keys:
            new = k[a] != k[b]
            a, b = a[new], b[new]
        if len(a):
            yield a, b


def _sides(members: np.ndarray, blocks: np.ndarray, tile: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    one = np.nonzero(blocks == tile[0])[0]
    return (one, one) if tile[0] == tile[1] else (one, np.nonzero(blocks == tile[1])[0])


def _arrays(index: Index, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In the order of ids: what follows doesn't depend on how rows arrived."""
    ids = np.array([m["id"] for m in row["members"]], dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    blocks = np.array([m["block"] for m in row["members"]], dtype=np.int64)[order]
    codes = np.array([m["codes"] for m in row["members"]], dtype=np.int64)[order].T
    return ids[order], blocks, codes, order


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding array of numbers).

    Two vectors are linked if their cosine, in double precision, is at least `cosine`.
    Rotations are learned from a sample of about `sample_rows` rows at most; every row is
    indexed. Tables find a pair that agrees in all bits of one of them and is near in all
    bits; a pair is counted only in the first table where it meets, and the original
    vectors decide. No pair is emitted: a tile gives, for each vector, its number of links
    and one edge of a spanning forest. A bucket above TILE_ROWS is dealt in tiles of two
    blocks, so that a hot bucket spreads over tasks and stays whole.

    Equal vectors are compared once; their rows are linked to each other. A vector that is
    null, empty, zero or holds null or non-finite elements links with nothing, and so do
    vectors of different lengths. Rows that share a vec_id are vectors of their own. A
    null vec_id links with nothing: no links, null component, not kept. No rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = given.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    # the id is written with the table, so it stays the same wherever it is read again
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("dim")).first()
    rows, dim = size["n"], size["dim"]
    share = int(1_000_000 * min(1.0, sample_rows / max(rows, 1)))
    drawn = classes.filter(F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < share).select("embedding").toArrow()
    sample = _unit(_matrix(drawn.column(0), dim)) if drawn.num_rows else np.zeros((0, dim))
    index = lay_out(rows, dim, sample, cosine, recall)

    def encode(batches):
        for b in batches:
            x = _matrix(b.column(1), index.dim)
            codes = np.stack(index.codes(_unit(x)), axis=1) if len(x) else np.zeros((0, len(index.rotations)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(codes), pa.list_(pa.int64()))], names=["id", "codes"])

    coded = written(classes.select("id", "embedding").mapInArrow(encode, "id long, codes array<bigint>"))
    mask = (1 << index.bits) - 1
    key = lambda t: F.shiftrightunsigned(F.col("codes")[t // index.per_code], t % index.per_code * index.bits).bitwiseAND(F.lit(mask))
    keyed = coded.select("id", "codes", F.explode(F.array(*[F.struct(F.lit(t).alias("table"), key(t).alias("key")) for t in range(index.tables)])).alias("k")).select("id", "codes", "k.table", "k.key")
    dealt = tiled(keyed, ["table", "key"], "id", TILE_ROWS)
    member = F.struct("id", "block", "codes")
    tiles = dealt.groupBy("table", "key", "tile").agg(F.collect_list(member).alias("members")).filter(F.size("members") > 1)

    def involved(batches):
        """Of each tile, the members that have a candidate there."""
        for b in batches:
            out = {"table": [], "key": [], "one": [], "two": [], "id": [], "block": [], "codes": []}
            for row in b.to_pylist():
                ids, blocks, codes, _ = _arrays(index, row)
                hit = np.zeros(len(ids), dtype=bool)
                for i, j in _candidates(index, row["table"], codes, *_sides(ids, blocks, (row["one"], row["two"]))):
                    hit[i] = hit[j] = True
                for m in np.nonzero(hit)[0]:
                    for name, value in zip(out, (row["table"], row["key"], row["one"], row["two"], int(ids[m]), int(blocks[m]), codes[:, m].tolist()), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("table", pa.int32()), ("key", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("id", pa.int64()), ("block", pa.int32()), ("codes", pa.list_(pa.int64()))]))

    hits = tiles.select("table", "key", "tile.one", "tile.two", "members").mapInArrow(involved, "table int, key long, one int, two int, id long, block int, codes array<bigint>")
    full = hits.join(classes.select("id", "embedding", "copies"), "id")
    groups = full.groupBy("table", "key", "one", "two").agg(F.collect_list(F.struct("id", "block", "codes", "embedding", "copies")).alias("members")).filter(F.size("members") > 1)

    def rerank(batches):
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for row in b.to_pylist():
                ids, blocks, codes, order = _arrays(index, row)
                lengths = np.array([len(m["embedding"]) for m in row["members"]])[order]
                x = np.zeros((len(ids), index.dim))
                for at, m in enumerate(order):
                    x[at, : lengths[at]] = row["members"][m]["embedding"]
                x, copies = _unit(x), np.array([m["copies"] for m in row["members"]])[order]
                links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
                for i, j in _candidates(index, row["table"], codes, *_sides(ids, blocks, (row["one"], row["two"]))):
                    for at in range(0, len(i), 50_000):
                        a, c = i[at : at + 50_000], j[at : at + 50_000]
                        near = ((x[a] * x[c]).sum(axis=1) >= cosine) & (lengths[a] == lengths[c])
                        a, c = a[near], c[near]
                        np.add.at(links, a, copies[c])
                        np.add.at(links, c, copies[a])
                        while (root[a] != root[c]).any():  # the least of both ends, then of its own root, until nothing moves
                            low = np.minimum(root[a], root[c])
                            np.minimum.at(root, root[a], low)
                            np.minimum.at(root, root[c], low)
                            root = root[root]
                root = _settled(root)
                out += [(int(ids[m]), int(links[m]), int(ids[root[m]])) for m in np.nonzero(links)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["id", "links", "root"])

    linked = written(groups.mapInArrow(rerank, "id long, links long, root long"))
    degrees = linked.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    nodes = classes.select("id", "least", "copies").join(degrees, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    nodes = nodes.select("id", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("part"))
    heads = nodes.groupBy("part").agg(F.min("least").alias("component_id"))
    found = nodes.join(heads, "part").select("id", "n_links", "component_id")
    placed = good.join(classes.select("embedding", "id"), "embedding").select("vec_id", "id").join(found, "id").select("vec_id", "n_links", "component_id")
    alone = given.filter(~(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _settled(root: np.ndarray) -> np.ndarray:
    while (root != root[root]).any():
        root = root[root]
    return root
