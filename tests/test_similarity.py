import random

import numpy as np
import pytest

from skein.operators import similarity as S

VECTORS = {w: np.random.default_rng(k).standard_normal(6) for k, w in enumerate("abcdefgh")} | {"zero": np.zeros(6)}
SCHEMA = "id long, predictions array<struct<answer:string,conditions:array<string>>>, answers array<struct<answer:string,conditions:array<string>>>"


def _encoder(seen=None):
    """Made here, so that workers get it by value."""
    vectors = VECTORS

    def encode(texts):
        if seen is not None:
            seen.add(len(texts))
        return [np.array([vectors[w] for w in t.split()]).reshape(-1, 6) for t in texts]

    return encode


def _plain(c, r):
    """The same a pair of tokens at a time."""
    if not c or not r:
        return (float(len(c) == len(r)),) * 3
    cosine = lambda x, y: 0.0 if not x.any() or not y.any() else float(x @ y / np.sqrt((x @ x) * (y @ y)))
    grid = [[cosine(VECTORS[x], VECTORS[y]) for y in r] for x in c]
    p = sum(max(row) for row in grid) / len(c)
    q = sum(max(col) for col in zip(*grid, strict=True)) / len(r)
    return p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0


def test_greedy_matching(spark):
    draw = random.Random(1)
    text = lambda: " ".join(draw.choices("bcdefgh", k=draw.randint(0, 5)))
    rows = [(n, text(), text(), "x") for n in range(60)] + [(60, None, None, None), (61, "b", None, ""), (62, "zero", "b", ""), (63, "B!", "the b", "")]
    found = S.token_similarity(spark.createDataFrame(rows, "id long, pred string, ref string, other string").repartition(3), "pred", "ref", _encoder()).collect()
    assert len(found) == len(rows)
    for r in found:
        words = lambda t: [w for w in (t or "").lower().replace("!", "").split() if w != "the"]
        assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(_plain(words(r["pred"]), words(r["ref"])))


def test_three_maxima_are_taken_by_themselves(spark):
    draw = random.Random(2)
    text = lambda: " ".join(draw.choices("bcdefgh", k=draw.randint(1, 3)))
    some = lambda most: [(text(), [text() for _ in range(draw.randint(0, 2))]) for _ in range(draw.randint(0, most))]
    rows = [(n, some(4), some(3)) for n in range(80)] + [(80, [], []), (81, None, [("b", [])]), (82, [("b", ["c"])], None), (83, [(None, None)], [("", ["b"])]), (84, [("b", [])] * 3, [("b", ["c"])] * 3)]
    found = {r["id"]: r for r in S.similarity_maxima(spark.createDataFrame(rows, SCHEMA).repartition(3), _encoder()).collect()}
    apart = 0
    for n, p, a in rows:
        p, a = p or [], a or []
        cells = []
        for pa, pc in p:
            for aa, ac in a:
                f = _plain((pa or "").split(), (aa or "").split())[2]
                c = _plain(" ".join(pc or []).split(), " ".join(ac).split())[2] if pc else 0.0
                cells.append((f, (f + c) / 2, c) if ac else (f, 0.0, 0.0))
        wanted = [max([0.0, *(x[k] for x in cells)]) for k in range(3)] if a else [float(not p)] * 3
        assert [found[n][m] for m in S.MAXIMA] == pytest.approx(wanted)
        apart += len({max(range(len(cells)), key=lambda i: cells[i][k]) for k in range(3)}) > 1 if cells else 0
    assert apart > 10


def test_each_text_is_encoded_once_a_task(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = [(n, [("b c", [])] * 4, [("d", []), ("e", [])]) for n in range(200)]
    S.similarity_maxima(spark.createDataFrame(rows, SCHEMA).coalesce(1), _encoder(calls)).count()
    assert calls.value <= 4
