"""Best-fit packing by linear grouping: round large lengths up within groups of equal cardinality, optimise configurations of the few sizes, substitute the documents, best-fit the small ones."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_within, small_batches, written

CAPACITY = 2048
#: Groups of the linear grouping, and shares of a sequence from which a length is large: the one that takes the fewest sequences for a histogram is used.
GROUPS, LARGE = 24, (1 / 8, 1 / 4, 1 / 3, 0.501)
END = 0
SPECIAL = {"<|endoftext|>": 50256}
VOCABULARY = "byte_bpe_50k.tiktoken"
_ROUNDS = 400


@dataclass
class Run:
    """`count` sequences alike: from number `first` on, each filled to `used`."""

    first: int
    count: int
    used: int


@dataclass
class Place:
    """Of the pieces of a length, those from `rank` on go to the sequences from `first` on, `each` to a sequence, from `offset` on."""

    rank: int
    first: int
    each: int
    offset: int


def _knapsack(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes that fits."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    widths = np.array(sizes)
    for c in range(min(sizes), capacity + 1):
        fits = np.nonzero(widths <= c)[0]
        worth = best[c - widths[fits]] + values[fits]
        k = int(worth.argmax())
        if worth[k] > best[c - 1] + 1e-12:
            best[c], took[c] = worth[k], fits[k]
        else:
            best[c] = best[c - 1]
    found, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0 and best[c] > 0:
        if took[c] < 0 or best[c] == best[c - 1]:
            c -= 1
            continue
        found[took[c]] += 1
        c -= sizes[took[c]]
    return float(best[capacity]), found


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size in a sequence, sequences): the linear program of cutting stock by column generation, rounded down."""
    k = len(sizes)
    columns = [np.eye(k, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(k)]
    need = np.array(counts, dtype=float)
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    amounts = inverse @ need
    for _ in range(_ROUNDS):
        prices = inverse.sum(axis=0)
        worth, column = _knapsack(np.maximum(prices, 0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, amounts / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amounts = amounts - step * way
        amounts[out] = step
        turn = np.eye(k)
        turn[:, out] = -way / way[out]
        turn[out, out] = 1 / way[out]
        inverse = turn @ inverse
        columns[out] = column
    used = [(c, int(a + 1e-9)) for c, a in zip(columns, amounts, strict=True)]
    return [(c, n) for c, n in used if n > 0]


class Packer:
    """Packs a histogram of lengths: what it holds depends on lengths and groups, not on how many pieces there are."""

    def __init__(self, counts: Mapping[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE[0]):
        self.capacity, self.groups = capacity, groups
        self.left = {length: n for length, n in counts.items() if n > 0}
        self.total, self.sequences = dict(self.left), 0
        self.places: dict[int, list[Place]] = {length: [] for length in self.left}
        self.open: dict[int, list[Run]] = {}
        self.rooms: list[int] = []
        if full := self.left.get(capacity):
            self._put(capacity, self._new(full), 1)
        self._large(max(1, int(capacity * large)))
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            self._best_fit(length)

    def _new(self, count: int) -> Run:
        run = Run(self.sequences, count, 0)
        self.sequences += count
        return run

    def _put(self, length: int, run: Run, each: int) -> None:
        """`each` pieces of a length into each sequence of a run that is not listed as open."""
        self.places[length].append(Place(self.total[length] - self.left[length], run.first, each, run.used))
        self.left[length] -= run.count * each
        run.used += length * each

    def _list(self, run: Run) -> None:
        room = self.capacity - run.used
        if run.count and room > 0:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append(run)

    def _large(self, least: int) -> None:
        lengths = sorted((x for x, n in self.left.items() if least <= x < self.capacity and n), reverse=True)
        total = sum(self.left[x] for x in lengths)
        if not total:
            return
        groups: list[list[list[int]]] = []  # of [length, pieces], the first length is the group's size
        size = max(1, -(-total // self.groups))
        room = 0
        for x in lengths:
            n = self.left[x]
            while n:
                if not room:
                    groups.append([])
                    room = size
                take = min(n, room)
                groups[-1].append([x, take])
                n, room = n - take, room - take
        merged: dict[int, list[list[int]]] = {}
        for g in groups:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = sorted(merged, reverse=True)
        for column, count in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], self.capacity):
            slots = [merged[sizes[k]] for k in np.nonzero(column)[0] for _ in range(column[k])]
            short = {id(s): sum(n for _, n in s) for s in slots}
            count = min(count, *(short[id(s)] // sum(t is s for t in slots) for s in slots))
            done = 0
            # each slot takes `count` pieces of its group, longest first: cut where any slot's length changes
            taken = []
            for s in slots:
                mine, want = [], count
                while want:
                    n = min(want, s[0][1])
                    mine.append([s[0][0], n])
                    s[0][1] -= n
                    want -= n
                    if not s[0][1]:
                        s.pop(0)
                taken.append(mine)
            while done < count:
                alike = min(t[0][1] for t in taken)
                run = self._new(alike)
                for t in taken:
                    self._put(t[0][0], run, 1)
                    t[0][1] -= alike
                    if not t[0][1]:
                        t.pop(0)
                self._list(run)
                done += alike

    def _best_fit(self, length: int) -> None:
        """Each piece to the fullest sequence that has room; new sequences are opened when none has."""
        while n := self.left[length]:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                whole, rest = divmod(n, each)
                for run, fill in ((self._new(whole), each), (self._new(1 if rest else 0), rest)):
                    if run.count:
                        self._put(length, run, fill)
                        self._list(run)
                return
            room = self.rooms[at]
            runs = self.open[room]
            run = runs.pop()
            if not runs:
                del self.open[room]
                self.rooms.pop(at)
            each = room // length
            whole, rest = divmod(n, each)
            if whole < run.count:
                tail = Run(run.first + whole, run.count - whole, run.used)
                run.count = whole
                if rest:
                    one = Run(tail.first, 1, tail.used)
                    tail = Run(tail.first + 1, tail.count - 1, tail.used)
                    if run.count:
                        self._put(length, run, each)
                        self._list(run)
                    self._put(length, one, rest)
                    self._list(one)
                    self._list(tail)
                    return
                self._list(tail)
            self._put(length, run, each)
            self._list(run)


def fewest(counts: Mapping[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: Iterable[float] = LARGE) -> Packer:
    """The grouping of a histogram that takes the fewest sequences. From over half a sequence on a configuration is one length, so the last share makes it no worse than best-fit decreasing."""
    return min((Packer(counts, capacity, groups, share) for share in large), key=lambda p: p.sequences)


def locate(places: list[Place], ranks: Iterable[int], length: int) -> list[tuple[int, int]]:
    """(sequence, offset) of the pieces of a length by rank."""
    firsts = [p.rank for p in places]
    out = []
    for r in ranks:
        p = places[bisect_right(firsts, r) - 1]
        step, slot = divmod(r - p.rank, p.each)
        out.append((p.first + step, p.offset + slot * length))
    return out


@lru_cache(maxsize=1)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text and END. The vocabulary's rank file gives the ids that its JSON file gives, several times as fast (a test holds them against each other)."""
    encoding = _encoding(path)
    return [np.array([*encoding.encode(t, allowed_special="all"), END], dtype="<u4") for t in texts]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents of more than capacity ids are cut, the first piece takes what is over."""
    small_batches(docs.sparkSession)

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), token_ids([t or "" for t in b.column(1).to_pylist()], path), strict=True):
                first = len(ids) % capacity or capacity
                for k, (start, end) in enumerate(zip([0, *range(first, len(ids), capacity)], [*range(first, len(ids), capacity), len(ids)], strict=True)):
                    out.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_PIECES)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, large: Iterable[float] = LARGE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document in a sequence of at most capacity ids.

    The driver packs the histogram of lengths, of at most `capacity` entries, and gets
    runs of sequences that are alike; pieces of a length are numbered over salted parts
    and find their sequence by rank. Nothing that the driver or a task holds grows with
    the documents but the numbers in it.

    Null and empty texts are one piece of the end id alone. Rows that repeat are packed
    each. A null doc_id stays null. No rows give no rows; other columns are ignored.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    cut = written(pieces(docs, path, capacity).withColumn("_row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = fewest(counts, capacity, groups, large).places
    ranked = number_within(cut, ["length"], ["doc_id", "piece", "_row"], "rank", sum(counts.values()))

    def put(batches):
        for b in batches:
            lengths, ranks = np.array(b.column("length")), np.array(b.column("rank"))
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for length in np.unique(lengths):
                at = np.nonzero(lengths == length)[0]
                found = np.array(locate(plan[int(length)], ranks[at].tolist(), int(length)))
                sequence[at], offset[at] = found[:, 0], found[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*_PIECES.names, "sequence_id", "offset"])

    return ranked.select(*_PIECES.names, "rank").mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
