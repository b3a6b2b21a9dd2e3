import os

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import models as M
from skein.plans import registry
from skein.plans import modelling  # noqa: F401  lists its queries
from skein.sources import tables
from test_engine import SF, _rows

NAMES = [n for n, f in registry.QUERIES.items() if f.__module__.endswith("modelling")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in os.listdir(SF):
        c.execute(f"create view {x.removesuffix('.parquet')} as select * from '{SF}/{x}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, duck, name):
    assert _rows(registry.QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(registry.SQL[name]).df())


def test_a_failure_is_retried_and_stays_with_its_row(spark):
    def flaky(prompts, seen={}):  # noqa: B006  the calls so far, in one worker
        for p in prompts:
            seen[p] = seen.get(p, 0) + 1
            if p == "never" or (p == "third" and seen[p] < 3):
                raise RuntimeError(p)
        return prompts.str.upper()

    rows = spark.createDataFrame([("a",), ("never",), ("third",)], "q string").coalesce(1)
    found = {r["q"]: (r["response"], r["error"]) for r in M.complete(rows, F.col("q"), flaky).collect()}
    assert found == {"a": ("A", None), "never": (None, "RuntimeError: never"), "third": ("THIRD", None)}
    assert M.complete(rows.limit(0), F.col("q"), flaky).collect() == []


def test_configs():
    beam = M.config_from_args(M.BeamConfig, ["--width", "5", "--temperatures", "0.5", "0.1"])
    assert (beam.width, beam.depth, beam.temperatures) == (5, 3, (0.5, 0.1))
    assert M.config_from_args(M.RetrievalConfig, ["--retry", "--top-k", "9"]) == M.RetrievalConfig(retry=True, top_k=9)
    given = M.config_from_args(M.EvaluationConfig, ["--predictions", "p", "--references", "r", "--output", "o"])
    assert given.missing == "skip" and len(given.metrics) == 4
    with pytest.raises(SystemExit):
        M.config_from_args(M.EvaluationConfig, [])


def test_unknown_names(spark):
    with pytest.raises(ValueError, match="no data set"):
        tables.dataset(spark, "none", "/nowhere")
    with pytest.raises(ValueError, match="no template"):
        M.template("none")
    assert M.template("answer", "span", 6) == M.template("answer", "span", 0)
