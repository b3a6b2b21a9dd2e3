import random

import pytest

from skein.operators import contains as C
from skein.operators import graph as G


@pytest.mark.parametrize("seed", range(3))
def test_every_word_on_every_name(spark, seed):
    draw = random.Random(seed)
    text = lambda most: "".join(draw.choices("abé 😀", k=draw.randint(0, most)))
    names = list({text(12) for _ in range(200)})
    words = list({text(5) for _ in range(60)} | {"", "zzz", "ab", "ba b"})
    found = C.names_with(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n,) for n in [*names, None]], "name string"))
    assert sorted(map(tuple, found.collect())) == sorted((w, n) for w in words for n in names if w in n)


def test_nothing_to_look_for(spark):
    words, names = spark.createDataFrame([], "word string"), spark.createDataFrame([("ab",)], "name string")
    assert C.names_with(words, names).count() == 0
    assert C.names_with(spark.createDataFrame([("abc",)], "word string"), names.limit(0)).count() == 0


def test_no_nested_loops_in_word_search(spark):
    triples = spark.createDataFrame([(f"Big_Head {k}", "IN_PART", f"tail{k % 3}") for k in range(20)], "head string, rel string, tail string")
    words = spark.createDataFrame([("q", "head 1"), ("q", "ail2"), ("p", "part"), ("p", "")], "qid string, word string").filter("word <> ''")
    hits = G.word_hits(words, triples)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    low = lambda x: x.strip().replace("_", " ").lower()
    wanted = [(q, w, *t, s) for q, w in (("q", "head 1"), ("q", "ail2"), ("p", "part")) for t in triples.collect() for s in G.SIDES if w in low(t[s])]
    assert sorted((r["qid"], r["word"], r["head"], r["rel"], r["tail"], r["side"]) for r in hits.collect()) == sorted(wanted)
