"""Readers, guards and helpers that no SQL can check."""

import re
import time

import pytest
from pyspark.sql import functions as F

from skein.operators import models as M
from skein.operators import relational as O
from skein.operators import retrieval as V
from skein.sources import html as H
from skein.sources import tables
from skein.sources.shared import new_path


def test_html_files_below_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    files = {"x.txt": "<p>one</p>", "a/y.txt": "<h1>é</h1>", "a/b/z.txt": "", "a/b/z.pdf": "no", "a/w.TXT": "no"}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = {r["path"].split(str(tmp_path) + "/")[1]: r["html"] for r in H.read_html(spark, str(tmp_path)).collect()}
    assert found == {k: v for k, v in files.items() if k.endswith(".txt") and v}


def test_tables_of_a_known_size_alone_reach_pandas(spark):
    assert O.in_pandas(spark.range(10).toDF("id"), 10)["id"].sum() == 45
    with pytest.raises(ValueError, match="over 9 rows"):
        O.in_pandas(spark.range(10), 9)


def test_run_numbers_and_times(spark):
    assert tables.next_run(spark.createDataFrame([], "run_id int")) == 0
    assert tables.next_run(spark.createDataFrame([(0,), (4,)], "run_id int")) == 5
    assert re.fullmatch(r"\d{4}_\d\d_\d\d-\d\d_\d\d_\d\d_(AM|PM)", spark.range(1).select(tables.now_text()).first()[0])


def test_json_arrays_and_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text('[\n {"id": "a"},\n {"id": null}\n]')
    (tmp_path / "lines.json").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert [r["id"] for r in tables.read_json(spark, str(tmp_path / "array.json"), "id string", lines=False).collect()] == ["a", None]
    assert [r["id"] for r in tables.read_json(spark, str(tmp_path / "lines.json"), "id string").collect()] == ["a", "b"]


def test_merged_maps_right_side_wins(spark):
    rows = [(1, {"a": 1, "b": 2}, {"b": None, "c": 3}), (2, None, {"a": 1}), (3, {"a": 1}, None), (4, None, None), (5, {}, {})]
    found = spark.createDataFrame(rows, "id int, x map<string,int>, y map<string,int>").select("id", O.merged_maps(F.col("x"), F.col("y")).alias("m")).collect()
    assert {r["id"]: r["m"] for r in found if r["id"] != 4} == {1: {"a": 1, "b": None, "c": 3}, 2: {"a": 1}, 3: {"a": 1}, 5: {}}


def test_a_model_that_needs_time_is_waited_for(spark):
    """The first tries of each row fail until a deadline; waits double."""
    begun = time.time()

    def model(prompts):
        if time.time() < begun + 1.0:
            raise RuntimeError("429")
        return prompts

    row = M.complete(spark.createDataFrame([("x",)], "p string").coalesce(1), F.col("p"), model, tries=6, wait=0.2).first()
    assert row["response"] == "x" and row["error"] is None
    down = M.complete(spark.createDataFrame([("x",)], "p string"), F.col("p"), lambda prompts: 1 / 0, tries=2).first()
    assert down["response"] is None and down["error"].startswith("ZeroDivisionError")


def test_judges_without_contexts_or_numbers(spark):
    rows = [(1, "q", "r", "a", ["c"]), (2, "q", "r", "a", []), (3, None, None, None, None), (4, "q", "r", "down", ["c"])]

    def model(prompts):
        if prompts.str.contains("down").any():
            raise ValueError("down")
        return prompts.map(lambda p: "4\nfine" if "Rate the answer" in p and "Answer: a" in p else "well" if "Rate" in p else "Yes")

    found = {r["id"]: r for r in M.model_judges(spark.createDataFrame(rows, "id int, question string, reference string, response string, contexts array<string>").repartition(4), model).collect()}
    scores = lambda n: [found[n][c] for c in ("correctness", "passing", "relevancy", "faithfulness")]
    assert scores(1) == [4.0, True, 1.0, 1.0] and scores(2) == [4.0, True, None, None]
    assert scores(3) == [None] * 4 and scores(4) == [None] * 4


@pytest.mark.parametrize("mode", ["or", "XOR", ""])
def test_modes_of_hybrids(spark, mode):
    df = spark.createDataFrame([(1, 1.0)], "node_id long, score double")
    with pytest.raises(ValueError, match="AND or OR"):
        V.hybrid(df, df, mode)


def test_resumed_results_keep_their_place(spark):
    path = new_path(spark)
    df = spark.range(7).toDF("id")
    tables.write_json(df, path)
    tables.write_json(df, path, append=True)
    assert tables.read_json(spark, path, "id long").count() == 14
