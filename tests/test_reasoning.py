import os

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import models as M
from skein.plans import reasoning, registry
from skein.plans import searching as S
from test_engine import SF, _rows

NAMES = [n for n, f in registry.QUERIES.items() if f.__module__.endswith("reasoning") and n in registry.SQL]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in os.listdir(SF):
        c.execute(f"create view {x.removesuffix('.parquet')} as select * from '{SF}/{x}'")
    return c


@pytest.mark.parametrize("name", [*NAMES, "beam_search", "beam_chains", "khop", "kg_entity_search", "triples_build"])
def test_against_duckdb(spark, duck, name):
    assert _rows(registry.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(registry.SQL[name]).df())


GRAPH = [("red fox", "eats", "mouse"), ("mouse", "eats", "grain"), ("grain", "grows in", "field"), ("old owl", "eats", "mouse"), ("barn", "holds", "hay bale"), ("hay bale", "feeds", "cow")]


def _reply():
    """Enough once grain is known; other facts send on to barns; nothing found sends on to hay. A closure, for workers can't import tests."""
    return lambda prompts: prompts.map(lambda p: "{yes} {grain}" if "grain" in p.split("Facts: ")[-1] and "Facts: " in p else "{hay}" if "No facts" in p else "{No} {barn}")


def _plain(topic, max_depth=3):
    """(depth of the answer, triples in order) of one question, every triple passing."""
    memory, visited, wholes, parts = [], set(), [topic], []
    for depth in range(1, max_depth + 1):
        words = {(w, True) for x in (wholes if depth == 1 else []) + parts for w in x.split()} | {(x, False) for x in (wholes if depth > 1 else [])}
        words = {(w, part) for w, part in words if w not in visited}
        found = sorted({t for t in GRAPH for w, part in words if (any(w in x for x in t) if part else w in (t[0], t[2]))})
        memory += [t for t in found if t not in memory]
        visited |= {w for w, _ in words} | set(wholes) | set(parts)
        onward = set()
        for t in found:
            for w, _ in words:
                onward |= {t[2]} if w in t[0] else {t[0]} if w in t[2] else {t[0], t[2]} if w in t[1] else set()
        if any("grain" in x for t in found for x in t):
            return depth, memory
        wholes = sorted(onward - visited)
        parts = [x for x in (["barn"] if found else ["hay"]) if x not in visited]
    return None, memory


def test_clues_and_answers_against_plain_traversal(spark):
    graph = spark.createDataFrame(GRAPH, "head string, rel string, tail string")
    topics = [("q1", "red fox"), ("q2", "cow"), ("q3", "nothing known"), ("q4", "grain")]
    asked = spark.createDataFrame([(q, f"What of {q}?") for q, _ in topics], "qid string, question string")
    out = G.traverse_with_clues(graph, spark.createDataFrame(topics, "qid string, entity string"), lambda q, x: F.lit(9.0), M.reasoner(asked, _reply()))
    found = {r["qid"]: r for r in out.collect()}
    assert set(found) == {q for q, _ in topics}
    for q, topic in topics:
        depth, memory = _plain(topic)
        assert found[q]["depth"] == depth and found[q]["answer"] == (None if depth is None else "grain")
        first, rest = found[q]["context"].split("KG context:\n")
        assert first == ("" if depth is None else "Answer: grain\n\n")
        assert sorted(rest.splitlines()) == sorted(", ".join(t) for t in memory)
    assert (found["q1"]["depth"], found["q2"]["depth"], found["q4"]["depth"]) == (2, None, 1)
    assert "barn, holds, hay bale" in found["q3"]["context"]


def test_no_question_no_context(spark):
    graph = spark.createDataFrame(GRAPH, "head string, rel string, tail string")
    asked = spark.createDataFrame([], "qid string, question string")
    assert G.traverse_with_clues(graph, spark.createDataFrame([], "qid string, entity string"), lambda q, x: F.lit(9.0), M.reasoner(asked, _reply())).collect() == []


def test_query_with_clues(spark):
    found = {r["qid"]: r for r in reasoning.traverse_clues(spark, SF).collect()}
    assert set(found) == {q for q, _ in S._TOPICS} | {"q4"}
    assert all((r["answer"] == "it is there") == r["context"].startswith("Answer: it is there\n\nKG context:\n") for r in found.values())


def test_demonstrations_can_be_parsed(spark):
    code = M.demonstration(F.lit("q"), F.lit("d"), F.lit("Which?"), F.lit("yes"), rationale=F.lit("one\ntwo"), conditions=F.array(F.lit("a"), F.lit("b")))
    reply = spark.range(1).select(T.parse_code_answer(code["reply"], F.lit(True)).alias("x")).first()["x"]
    assert [(a["answer"], a["conditions"]) for a in reply] == [("yes", ["a", "b"])]
