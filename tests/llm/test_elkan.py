"""Codes against plain Lloyd rounds over all distances, in whole numbers of any size."""

import hashlib
import math

import numpy as np
import pytest

from skein.llm import elkan

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def _plain(rows, rounds=2):
    """{place: (code, error)} and the codebooks of usable rows (vec_id, vector), all distances computed."""
    dim = len(rows[0][1])
    whole = [[max(-elkan._most(dim), min(elkan._most(dim), math.floor(256 * x))) for x in v] for _, v in rows]
    parts = [[w[p * dim // 16 : (p + 1) * dim // 16] for p in range(16)] for w in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:64]
    books = [[parts[i][p] for i in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for w in parts:
            for p in range(16):
                held[p][nearest(p, w[p])[1]].append(w[p])
        books = [[[sum(c) // len(c) for c in zip(*h, strict=True)] if h else e for h, e in zip(held[p], books[p], strict=True)] for p in range(16)]
    out = [[nearest(p, w[p]) for p in range(16)] for w in parts]
    return [("".join(f"{k:02x}" for _, k in o), sum(d for d, _ in o)) for o in out], hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def _check(spark, good, bad=()):
    rows = [(i, v, lab, "clash") for i, v, lab in [*good, *bad]]
    found = elkan.compressed_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    made, sha = _plain([(i, v) for i, v, _ in good])
    sums = {}
    for (_, _, lab), (_, error) in zip(good, made, strict=True):
        sums[lab] = sums.get(lab, 0) + error
    wanted = [(i, code, error, sums[lab], sha) for (i, _, lab), (code, error) in zip(good, made, strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_codes_with_ties_repeats_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((260, 32)) * 3) / 256  # few whole values: many ties
    x[200:230] = x[5]
    good = [(int(i), v.tolist(), [None, 1, 2][int(i) % 3]) for i, v in zip(rng.permutation(260) - 20, x, strict=True)]
    good += [(7, x[9].tolist(), 1), (7, x[10].tolist(), 2), (None, x[11].tolist(), 1), (None, x[12].tolist(), None)]
    bad = [(-900, None, 1), (-901, [], 1), (-902, [None] * 32, 1), (-903, [float("nan")] * 32, 2), (-904, [float("-inf")] + [0.0] * 31, 2), (-905, [1.0] * 16, 2), (-906, [1.0] * 5, None)]
    _check(spark, good, bad)


def test_few_and_huge_vectors(spark):
    rng = np.random.default_rng(4)
    _check(spark, [(i, (v * 10.0 ** (i % 9)).tolist(), 1) for i, v in enumerate(rng.standard_normal((20, 16)))])
    _check(spark, [(1, [1e300, -1e300] * 8, 1)])
    _check(spark, [(k, [0.1] * 16, None) for k in range(70)])


def test_no_vectors(spark):
    assert elkan.compressed_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert elkan.compressed_vectors(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).count() == 0


@pytest.mark.parametrize("scale", [1, 5000])
def test_bounds_hold_and_rule_pairs_out(scale):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16, 4)) * 60 * scale
    x = (centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16, 4)) * 5 * scale).astype(np.int64)
    books = elkan.Codebooks(x[:64].transpose(1, 0, 2).copy())
    code, upper, lower = books.assign(x)
    for _ in range(4):
        new = books.entries.copy()
        for p in range(16):
            for k in range(64):
                if (code[:, p] == k).any():
                    new[p, k] = x[code[:, p] == k, p].sum(axis=0) // (code[:, p] == k).sum()
        books = elkan.Codebooks(new, books)
        code, upper, lower, computed = books.reassign(x, code, upper, lower)
        for p in range(16):
            d = elkan._squares(x[:, p], books.entries[p])
            assert (code[:, p] == d.argmin(axis=1)).all()
            assert (upper[:, p] ** 2 >= d[np.arange(len(x)), code[:, p]]).all()
            assert ((lower[:, p].astype(np.int64) * books.step[p]) ** 2 <= d).all()
    assert computed < 0.2 * x.shape[0] * 16 * 64
