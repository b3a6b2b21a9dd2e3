"""Compression of vectors to codes: a codebook for each part of a vector, found by Lloyd's rounds with Elkan's bounds.

All arithmetic that decides is on whole numbers, so results don't depend on how rows are
dealt. A vector carries, from round to round, an upper bound of the distance to its entry
for each part and a lower bound for each entry of each part, in a written table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, small_batches, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are floors of so many times the values.
SCALE = 256
#: Lower bounds are stored in a byte, in steps that take the entries' distances up to here.
STEPS = 255
#: Rows compared at once, so that a block of distances stays small.
BLOCK = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is there, has components, and none that is null or not finite."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & fine, F.lit(False))


def _most(dim: int) -> int:
    """Greatest component for which a vector's error fits a long."""
    return math.isqrt(((1 << 63) - 1) // dim) // 2


def _whole(values: np.ndarray, dim: int) -> np.ndarray:
    most = _most(dim)
    return np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)


def _floor_root(squares: np.ndarray) -> np.ndarray:
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def _ceil_root(squares: np.ndarray) -> np.ndarray:
    root = _floor_root(squares)
    return root + (root * root < squares)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, w) from entries (k, w), a component at a time."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - entries[None, :, j]
        out += d * d
    return out


class Codebooks:
    """Entries (part, entry, position), with what the bounds need: half distances between entries, and how far each has moved."""

    def __init__(self, entries: np.ndarray, before: Codebooks | None = None):
        self.entries = entries
        self.between = np.stack([_squares(e, e) for e in entries])
        self.step = before.step if before else np.maximum(1, -(-_ceil_root(self.between.max(axis=(1, 2), initial=0)) // STEPS))
        moved = ((entries - before.entries) ** 2).sum(axis=2) if before else np.zeros(entries.shape[:2], np.int64)
        self.moved = _ceil_root(moved)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, upper, lower) of rows (n, part, position) without earlier bounds: all distances."""
        n, (parts, entries, _) = len(x), self.entries.shape
        code, upper, lower = np.empty((n, parts), np.uint8), np.empty((n, parts), np.int64), np.empty((n, parts, entries), np.uint8)
        for p in range(parts):
            d = _squares(x[:, p], self.entries[p])
            code[:, p] = d.argmin(axis=1)  # the first of equal ones
            upper[:, p] = _ceil_root(d.min(axis=1))
            lower[:, p] = np.minimum(_floor_root(d) // self.step[p], STEPS)
        return code, upper, lower

    def reassign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(code, upper, lower, pairs computed) after the entries have moved: bounds are shifted, and only pairs that they can't rule out are computed.

        An entry is ruled out where its lower bound is above the upper bound, or where half
        its distance from the row's entry is: strictly, so it is farther. Whatever may tie
        is decided by the squared distances themselves, the lower index first.
        """
        code, upper, lower, computed = code.copy(), upper.copy(), lower.copy(), 0
        for p in range(self.entries.shape[0]):
            own, entries, step = code[:, p].astype(np.int64), self.entries[p], self.step[p]
            low = np.maximum(lower[:, p].astype(np.int64) - -(-self.moved[p] // step), 0)
            up = upper[:, p] + self.moved[p][own]
            open_ = (low * step <= up[:, None]) & (self.between[p][own] <= 4 * (up * up)[:, None])
            open_[np.arange(len(own)), own] = False
            rows = np.nonzero(open_.any(axis=1))[0]
            if len(rows):
                # the upper bound made tight, and the bounds held against it once more
                d = ((x[rows, p] - entries[own[rows]]) ** 2).sum(axis=1)
                up[rows] = _ceil_root(d)
                low[rows, own[rows]] = np.minimum(_floor_root(d) // step, STEPS)
                still = open_[rows] & (low[rows] * step <= up[rows][:, None]) & (self.between[p][own[rows]] <= 4 * d[:, None])
                at, c = np.nonzero(still)
                near = ((x[rows[at], p] - entries[c]) ** 2).sum(axis=1)
                computed += len(rows) + len(at)
                low[rows[at], c] = np.minimum(_floor_root(near) // step, STEPS)
                # (distance, index) of the best pair of each row, its own entry among them
                all_rows, all_c, all_d = np.concatenate([np.arange(len(rows)), at]), np.concatenate([own[rows], c]), np.concatenate([d, near])
                order = np.lexsort((all_c, all_d, all_rows))
                first = np.unique(all_rows[order], return_index=True)[1]
                best = order[first]
                code[rows, p] = all_c[best]
                up[rows] = _ceil_root(all_d[best])
            upper[:, p], lower[:, p] = up, low
        return code, upper, lower, computed

    def errors(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Squared distance of each part from its entry."""
        return np.stack([((x[:, p] - self.entries[p][code[:, p]]) ** 2).sum(axis=1) for p in range(self.entries.shape[0])], axis=1)


def _packed(values: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    data = flat.tobytes()
    width = len(data) // max(len(values), 1)
    offsets = pa.py_buffer((np.arange(len(values) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(values), [None, offsets, pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            yield b.slice(at, BLOCK)


def _start(vectors: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """Rows (id, label, x, code, upper, lower) of vectors (id, label, v)."""

    def run(batches):
        for b in _blocks(batches):
            x = _whole(b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim), dim)
            code, upper, lower = books.assign(x.reshape(len(x), PARTS, -1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), _packed(x.astype(np.int32)), _packed(code), _packed(upper), _packed(lower)], names=["id", "label", "x", "code", "upper", "lower"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    return vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, x binary, code binary, upper binary, lower binary")


def _again(state: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """The state by codebooks that have moved, by way of the bounds."""
    entries = books.entries.shape[1]

    def run(batches):
        for b in _blocks(batches):
            x = _unpacked(b.column("x"), np.int32, PARTS, dim // PARTS).astype(np.int64)
            code, upper, lower, _ = books.reassign(x, _unpacked(b.column("code"), np.uint8, PARTS), _unpacked(b.column("upper"), np.int64, PARTS), _unpacked(b.column("lower"), np.uint8, PARTS, entries))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("x"), _packed(code), _packed(upper), _packed(lower)], names=b.schema.names)

    return state.mapInArrow(run, state.schema)


def _moved(state: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """Codebooks whose entries are the floors of the means of what is assigned to them; unused ones stay.

    Tasks add up what they hold to a row for each part and entry, PARTS times ENTRIES of
    them at most; Spark adds these, and as many rows reach the driver.
    """
    entries = books.entries.shape[1]

    def run(batches):
        sums, counts = np.zeros((PARTS, entries, dim // PARTS), np.int64), np.zeros((PARTS, entries), np.int64)
        for b in _blocks(batches):
            x, code = _unpacked(b.column("x"), np.int32, PARTS, dim // PARTS).astype(np.int64), _unpacked(b.column("code"), np.uint8, PARTS)
            for p in range(PARTS):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(counts[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    parts = state.select("x", "code").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    total = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(dim // PARTS)])
    new = books.entries.copy()
    for r in total.collect():
        new[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(dim // PARTS)]
    return Codebooks(new, books)


def _finished(state: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """(id, label, code, error) with the code as hexadecimal text."""

    def run(batches):
        for b in _blocks(batches):
            x, code = _unpacked(b.column("x"), np.int32, PARTS, dim // PARTS).astype(np.int64), _unpacked(b.column("code"), np.uint8, PARTS)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([bytes(c).hex() for c in code], pa.string()), pa.array(books.errors(x, code).sum(axis=1))], names=["id", "label", "code", "error"])

    kinds = {c: state.schema[c].dataType.simpleString() for c in ("id", "label")}
    return state.select("id", "label", "x", "code").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(key, label, code, error) of each usable vector, and the last codebooks, None without vectors.

    Components become floor(256 x), vectors are cut into 16 equal parts. A part's codebook
    starts as that part of the 64 vectors with the least keys (null keys last, rows that
    repeat a key by their components). Each round assigns every part to its nearest
    entry, the lower index of equal ones, and moves each entry to the floor of its
    parts' mean; at the end parts are assigned once more. code has two hexadecimal digits
    for each part, error is the sum of the parts' squared distances.

    Vectors that are null, empty, or hold null, NaN or infinite components are left out.
    So are those whose length isn't the one that most vectors have among lengths that
    are multiples of 16 (the larger one of two as frequent): they can't share codebooks.
    Components beyond a bound (about 2^27 at 64 components) count as the bound, so that
    errors fit a long. Fewer than 64 vectors make smaller codebooks.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.filter(usable(F.col(vector)) & (F.size(vector) % PARTS == 0))
    rows = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return rows.select(F.col("id").alias(key), F.col("label").alias(label), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), None
    dim = sizes["dim"]
    rows = rows.filter(F.size("v") == dim)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    entries = _whole(np.array([r["v"] for r in first], np.float64), dim).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    books = Codebooks(entries)
    state = written(_start(rows, books, dim))
    for _ in range(rounds):
        books = _moved(state, books, dim)
        new = written(_again(state, books, dim))
        drop_written(state)
        state = new
    out = written(_finished(state, books, dim))
    drop_written(state)
    return out.select(F.col("id").alias(key), F.col("label").alias(label), "code", "error"), books


def codebooks_sha256(books: Codebooks | None) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers between commas."""
    return hashlib.sha256(b"" if books is None else ",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def compressed_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): see compress(). label_error is the error summed over rows with an equal label, null ones together.

    Labels are summed before they are joined back; whether their table is broadcast is
    left to its size. A sum beyond a long is null.
    """
    codes, books = compress(vectors, key, vector, label)
    sums = codes.groupBy(F.col(label).alias("_label")).agg(F.try_sum("error").alias("label_error"))
    joined = codes.join(sums, F.col(label).eqNullSafe(F.col("_label")))
    return joined.select(key, "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
