import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import evaluation as E
from skein.operators import graph as G
from skein.operators import retrieval as V
from skein.plans import catalogue
from skein.sources import html as H
from skein.sources import tables

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("The U.S.A. - a 'test' (an)", "usa test"), ("", ""), ("The Cat!", "cat")])
def test_normalize(spark, given, wanted):
    assert one(spark, T.normalize_answer(F.lit(given))) == wanted


def test_token_f1(spark):
    f1 = lambda g, p: one(spark, T.answer_f1(T.tokens(F.lit(g)), T.tokens(F.lit(p))))
    assert f1("b b b d", "x b b c") == 0.5
    assert f1("", "") == 1.0 and f1("x", "") == 0.0
    assert tuple(one(spark, T.multihop_scores(F.lit("yes"), F.lit("yes indeed")))) == (0, 0, 0)
    assert tuple(one(spark, T.multihop_scores(F.lit(""), F.lit("")))) == (0, 0, 0)


def test_condition_f1(spark):
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, T.condition_f1(texts("c2", "c2", "c3"), texts("c1", "c2"))) == pytest.approx(0.4)
    assert one(spark, T.condition_f1(texts(), texts())) == 1.0
    assert one(spark, T.condition_f1(texts("c1"), texts())) == 0.0


def test_parsers(spark):
    assert one(spark, T.parse_prediction(F.lit("Answer: Yes it is"), F.lit("yes/no")))["answer"] == "yes"
    assert one(spark, T.parse_prediction(F.lit("Answer: yes."), F.lit("yes/no")))["answer"] == "yes."
    assert one(spark, T.parse_triplets(F.lit('1. (alice SMITH, "lives, in", x)'))) == []
    assert tuple(one(spark, T.parse_triplets(F.lit("(alice SMITH, Lives In!, PARIS)")))[0]) == ("Alice smith", "Lives in", "Paris")
    assert [tuple(x) for x in one(spark, T.parse_scored_triples(F.lit("(a, b, c) (Score: 8) (a, b, c) (Score: 7)")))] == [("a", "b", "c", 8)]
    assert one(spark, T.parse_scores(F.lit("0.4, 0.6"), F.lit(3))) == pytest.approx([1 / 3] * 3)
    assert one(spark, T.braces(F.lit("{No} need {age limit} or {x}"))) == ["age limit", "x"]


def test_assignment(spark):
    row = "id int, predictions array<struct<answer:string,conditions:array<string>>>, answers array<struct<answer:string,conditions:array<string>>>"
    given = [(1, [("cat", []), ("dog", [])], [("cat", [])]), (2, [("cat", [])], [("cat", []), ("dog", [])]), (3, [], []), (4, [("x", [])], [])]
    found = {r["id"]: r["em"] for r in E.assignment_metric(spark.createDataFrame(given, row)).collect()}
    assert found == {1: pytest.approx(math.exp(-1)), 2: 0.5, 3: 1.0, 4: 0.0}


def test_hungarian_against_permutations():
    from itertools import permutations
    from random import Random

    draw = Random(3)
    for n in range(1, 6):
        for m in range(n, 6):
            s = [[draw.random() for _ in range(m)] for _ in range(n)]
            assert E.best_assignment(s) == pytest.approx(max(sum(s[i][p[i]] for i in range(n)) for p in permutations(range(m), n)))


def test_beam_order(spark):
    rows = spark.createDataFrame([("q", 0.5, 1), ("q", 0.0, 2), ("q", 0.9, 3), ("q", 0.5, 4)], "q string, s double, seq int")
    assert sorted(r["seq"] for r in G.top_by_score(rows, ["q"], "s", ["seq"], 3).collect()) == [1, 3, 4]


def test_html():
    assert H.header_sections("<p>no end<p>two") == [("", "no end\ntwo")]
    assert H.sibling_sections("<h1>A</h1><p>x</p><h1>B</h1>", ["h1"]) == [("h1", "A\nx\n"), ("h1", "B\n")]


def test_hybrid(spark):
    make = lambda ids, s: spark.createDataFrame([(i, s) for i in ids], "node_id int, score double")
    both = {m: {(r["node_id"], r["score"]) for r in V.hybrid(make([1, 2], 0.5), make([2, 3], 9.0), m).collect()} for m in ("OR", "AND")}
    assert both == {"OR": {(1, 0.5), (2, 9.0), (3, 9.0)}, "AND": {(2, 9.0)}}
    with pytest.raises(ValueError):
        V.hybrid(make([1], 1.0), make([1], 1.0), "XOR")


def test_answers(spark):
    found = one(spark, tables.parse_answers(F.lit('[["yes", ["c"]], ["no", []]]')))
    assert [(a["answer"], a["conditions"]) for a in found] == [("yes", ["c"]), ("no", [])]


def _rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["eval_by_type_rollup", "eval_overlapping_slices", "assignment_metric", "parse_triplets", "kg_exact", "khop", "vector_topk", "stratified_sample", "batch_ids", "oracle_sections"])
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for x in os.listdir(SF):
        c.execute(f"create view {x.removesuffix('.parquet')} as select * from '{SF}/{x}'")
    assert _rows(catalogue.queries()[name](spark, SF).toPandas()) == _rows(c.execute(catalogue.oracle_sql()[name]).df())


def test_position_keeps_wide_rows_under_small_partitions(spark):
    import duckdb

    from skein.operators.relational import batches, position
    from skein.sources.tables import table

    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
        found = {(r["doc_id"], r["c"], r["pos"]) for r in position(docs, ["doc_id"]).selectExpr("doc_id", "md5(text) AS c", "pos").collect()}
        assert batches(docs, ["doc_id"], 20).count() == docs.count()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert found == set(duckdb.sql("SELECT doc_id, md5(text), row_number() OVER (ORDER BY doc_id) - 1 FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
