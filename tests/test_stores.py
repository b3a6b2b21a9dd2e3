import re
import uuid

import pytest

from skein.operators import graph as G
from skein.sources import stores
from skein.sources.shared import new_path, shared_dir


def _name():
    """A store of this run alone, for the shared folder may keep those of others."""
    return "test_" + uuid.uuid4().hex[:8]


def _graph(spark, path):
    return lambda: spark.read.parquet(path)


def test_built_loaded_and_built_anew(spark):
    path, builds, store = new_path(spark), [], _name()
    triples = [(f"H{k % 7}", "r", f"t{k}") for k in range(40)]
    spark.createDataFrame(triples, "head string, rel string, tail string").write.parquet(path)

    def load():
        def build():
            builds.append(1)
            return spark.read.parquet(path)

        return stores.graph_store(spark, store, [spark.read.parquet(path)], build, 4)

    rows = lambda s: [sorted((r["key"], r["head"], r["tail"]) for r in t.collect()) for t in (s.by_head, s.by_tail)]
    wanted = lambda t: [sorted((x[side].lower(), x[0], x[2]) for x in t) for side in (0, 2)]
    assert rows(load()) == wanted(triples) and len(builds) == 2
    assert rows(load()) == wanted(triples) and len(builds) == 2
    for name in spark.catalog.listTables():  # what another session sees: files, no tables
        if name.name.startswith(f"skein_{store}"):
            spark.sql(f"DROP TABLE {name.name}")
    assert rows(load()) == wanted(triples) and len(builds) == 2
    spark.createDataFrame([("New", "r", "one")], "head string, rel string, tail string").write.mode("append").parquet(path)
    assert rows(load()) == wanted([*triples, ("New", "r", "one")]) and len(builds) == 4
    assert stores.drop_versions(spark, f"{store}_by_head") == 2
    assert rows(load()) == wanted([*triples, ("New", "r", "one")]) and len(builds) == 5


def test_a_build_that_died_is_done_anew(spark):
    path = new_path(spark)
    spark.range(30).write.parquet(path)
    inputs, store = [spark.read.parquet(path)], _name()

    def dies():
        spark.range(5).write.parquet(f"{shared_dir(spark)}/skein/stores/{store}/x/rows")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stores.stored(spark, store, inputs, dies)
    assert stores.stored(spark, store, inputs, lambda: inputs[0]).count() == 30
    assert stores.stored(spark, store, inputs, dies).count() == 30


def test_frontiers_meet_the_graph_in_its_buckets(spark):
    path = new_path(spark)
    spark.createDataFrame([(f"H{k % 50}", f"r{k % 3}", f"t{k}") for k in range(500)], "head string, rel string, tail string").write.parquet(path)
    store = stores.graph_store(spark, _name(), [spark.read.parquet(path)], _graph(spark, path), 4)
    frontier = spark.createDataFrame([(1, "h7"), (1, "T8"), (2, "nothing")], "qid long, entity string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = G.frontier_relations(store, frontier)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # from each scan of the graph up to its join there is no exchange
    lines = plan.split("\n")
    scans = [n for n, x in enumerate(lines) if "FileScan parquet" in x]
    assert len(scans) == 2
    for n in scans:
        depth, above = lines[n].index("FileScan"), []
        for x in reversed(lines[:n]):
            at = re.search(r"[A-Z]", x).start()
            if at < depth:
                above.append(x)
                depth = at
            if "SortMergeJoin" in above[-1:][0] if above else False:
                break
        assert "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above)
    plain = G.frontier_relations(spark.read.parquet(path), frontier)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) != []


def test_vectors_of_another_dimension_fail(spark):
    path = new_path(spark)
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>").write.parquet(path)
    store = _name()
    with pytest.raises(Exception, match="2 elements, not 1"):
        stores.vector_store(spark, store, spark.read.parquet(path), 2)
    assert stores.vector_store(spark, store, spark.read.parquet(path).filter("vec_id = 1"), 2).count() == 1
