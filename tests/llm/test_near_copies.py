import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import near_copies as N
from skein.llm import simhash

ROWS = "doc_id long, text string, id int, code string"


def _texts():
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = [[draw.choice(words) for _ in range(n)] for n in (3, 40, 120, 300, 300, 2500)]
    out = [(n, " ".join(b)) for n, b in enumerate(base)]
    for k in range(60):
        b = list(draw.choice(base))
        for _ in range(draw.choice((0, 1, 2, len(b) // 20))):
            b[draw.randrange(len(b))] = draw.choice(words)
        out.append((100 + k, " ".join(b)))
    return [*out, (300, None), (301, ""), (302, " \n"), (100, out[3][1]), (None, out[3][1]), (303, "ONE"), (304, "one")]


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def _brute(rows):
    sets, prints = [_sets(t) for _, t in rows], [simhash.fingerprint(t, N.PRINT_WORDS) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = sets[i] == sets[j] or len(sets[i] & sets[j]) >= N.SIMILARITY * len(sets[i] | sets[j])
            if same and (prints[i] ^ prints[j]).bit_count() <= N.RADIUS:
                part = [part[j] if p == part[i] else p for p in part]
    return [min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None) for p in part]


@pytest.mark.parametrize("tile", [2000, 7])
def test_groups_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE_CODES", tile)
    monkeypatch.setattr(N, "SKETCH", 4096)
    rows = _texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], ROWS)
    found = [(r["doc_id"], r["component_id"]) for r in N.near_copy_groups(docs).collect()]
    wanted = list(zip((i for i, _ in rows), _brute(rows), strict=True))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(wanted, key=key)
    kept = N.one_of_each_near_copy(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in wanted})


def test_no_rows(spark):
    assert N.one_of_each_near_copy(spark.createDataFrame([], ROWS)).count() == 0
    assert N.near_copy_groups(spark.range(2).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).select("component_id").distinct().count() == 1


def test_tree_and_masks():
    draw = np.random.default_rng(1)
    codes = np.unique(draw.integers(0, 1 << 63, 300, dtype=np.uint64) & np.uint64(0xFFFF00000000FFFF))
    q, k = N.Tree(codes).within(codes, 7)
    i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 7)
    assert sorted(zip(q.tolist(), k.tolist())) == list(zip(i.tolist(), j.tolist()))
    for rows in (0, 10**5, 10**8, 10**12):
        for _ in range(200):
            apart = sum(1 << int(b) for b in draw.choice(64, 7, replace=False))
            assert any(not apart & m for m in N.masks(rows, 7))


def test_sketch_estimates():
    words = [f"w{k}" for k in range(20_000)]
    a, b = " ".join(words), " ".join(words[:18_000])
    assert N.jaccard(N.sketch(a)[0], N.sketch(b)[0]) == pytest.approx(0.9, abs=0.03)
    assert N.jaccard(N.sketch(a)[0], N.sketch(a)[0]) == 1.0


def test_large_texts_are_decided_exactly():
    draw = random.Random(3)
    for left in (0.79, 0.81):
        for _ in range(20):
            words = [str(draw.random()) for _ in range(5004)]
            kept = " ".join(words[: round(5000 * left) + 4])
            assert (N.jaccard(N.sketch(" ".join(words))[0], N.sketch(kept)[0]) >= N.SIMILARITY) == (left > 0.8)


def test_recall_against_all_pairs_jaccard(spark):
    draw, texts = random.Random(8), []
    for n in (100, 300, 1000):
        for _ in range(40):
            words = [str(draw.random()) for _ in range(n)]
            texts += [" ".join(words), " ".join(words[: n - draw.randint(n // 10, 19 * n // 100)])]
    sets = [_sets(t) for t in texts]
    wanted = {j for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= N.SIMILARITY * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r["doc_id"] for r in N.near_copy_groups(docs).collect() if r["doc_id"] != r["component_id"]}
    assert len(wanted) > 100 and gone == wanted
