"""What must not grow with the input: shuffle files, searches of a graph, what is encoded at once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import retrieval as V
from skein.operators import similarity as S
from skein.plans import catalogue, reasoning, registry  # noqa: F401
from skein.sources import stores
from skein.sources.shared import new_path, written


def _shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    assert written(spark.range(1000).repartition(3, "id").groupBy("id").count()).count() == 1000
    written(spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "k"))
    # the count itself leaves a row or so, the writes nothing
    assert len(_shuffle_files(spark) - before) <= 2 * 8


def test_repeated_triples_are_dealt_once_for_each_side(spark):
    path, builds = new_path(spark), []
    spark.createDataFrame([("H", "r", f"t{k % 5}") for k in range(20)], "head string, rel string, tail string").write.parquet(path)

    def build():
        builds.append(1)
        return spark.read.parquet(path)

    store = stores.graph_store(spark, "growth_repeats", [spark.read.parquet(path)], build, 4, repeats=True)
    assert sorted(r["tail"] for r in store.by_head.collect()) == sorted(r["tail"] for r in store.by_tail.collect()) == [f"t{k}" for k in range(5)]
    assert len(builds) == 1


def test_buckets_follow_the_bytes_of_the_input(spark, monkeypatch):
    path = new_path(spark)
    spark.range(100).write.parquet(path)
    monkeypatch.setattr(stores, "BUCKET_BYTES", 64)
    stores.stored(spark, "growth_buckets", [spark.read.parquet(path)], lambda: spark.read.parquet(path), "id")
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("skein_growth_buckets")]
    found = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {names[0]}").collect()}
    assert int(found["Num Buckets"]) > stores.BUCKETS


def test_beams_search_a_graph_twice_a_depth(spark, monkeypatch):
    path, searched = new_path(spark), []
    spark.createDataFrame([(f"a{k % 3}", f"r{k % 2}", f"a{(k + 1) % 3}") for k in range(30)], "head string, rel string, tail string").distinct().write.parquet(path)
    graph, write = spark.read.parquet(path), written
    monkeypatch.setattr(G, "written", lambda df: (searched.append(any(path.split("/")[-1] in f for f in df.inputFiles())), write(df))[1])
    rows, _ = G.beam_history(graph, spark.createDataFrame([("q", "a0")], "qid string, entity string"), lambda q, x: F.lit(1.0), lambda q, x: F.lit(1.0), depth=2)
    assert rows.count() and sum(searched) == 4


def test_few_words_meet_a_graph_where_it_lies(spark):
    triples = [(f"Big_Head {k}", "IN_PART", f"tail{k % 3}") for k in range(20)]
    graph = spark.createDataFrame(triples, "head string, rel string, tail string")
    wanted = lambda words: sorted((w, *t) for w in words for t in triples if any(w in x.replace("_", " ").lower() for x in t))
    for words in (["part", "1", "head 1"], [f"{k}" for k in range(G.FEW_WORDS + 3)]):
        given = spark.createDataFrame([(w,) for w in words], "word string")
        hits = G.word_hits(given, graph, sides=False)
        assert sorted(tuple(r) for r in hits.select("word", *G.SIDES).collect()) == wanted(words)
        if len(words) <= G.FEW_WORDS:
            assert "BroadcastHashJoin" in (plan := hits._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(word" not in plan


def test_long_texts_are_matched_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    c, r = rng.normal(size=(70, 16)), rng.normal(size=(50, 16))
    whole = S.greedy_match(c, r)
    monkeypatch.setattr(S, "CELLS", 120)
    assert np.allclose(S.greedy_match(c, r), whole, rtol=0, atol=1e-12)


def test_what_is_encoded_at_once_is_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 2000), pa.array(range(2000))], names=["t", "n"])
    slices = list(S._slices(iter([batch])))
    assert sum(s.num_rows for s in slices) == 2000 and [n for s in slices for n in s.column("n").to_pylist()] == list(range(2000))
    assert max(s.nbytes for s in slices) < S.SLICE_BYTES + 2000


def test_nearest_by_keys_of_several_columns(spark):
    rows = [(f"k{n % 4}", f"m{n // 4}", [float(n % 2), 0.0]) for n in range(40)]
    vectors = spark.createDataFrame(rows, "a string, b string, embedding array<double>").repartition(3)
    found = V.top_k(vectors, spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<double>"), 7, ["a", "b"])
    wanted = sorted((x[2][0] ** 2, x[0], x[1]) for x in rows)[:7]
    assert [(r["distance"], r["a"], r["b"]) for r in found.orderBy("rank").collect()] == wanted


def test_words_are_hashed_once_for_all_counts(spark):
    df = spark.createDataFrame([("red red widget",)], "t string").select(reasoning._counts(F.col("t")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
    assert sum(df.first()["v"]) == 3


def test_hybrids_know_all_nodes_of_a_label(spark):
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()
    pairs = {(a["vec_id"], b["vec_id"]) for a in e if a["vec_id"] % 20 == 0 for b in e if a["label"] == b["label"]}
    both, either = ({(r["query_id"], r["node_id"]): r["origin"] for r in registry.QUERIES[m](spark, sf).collect()} for m in ("hybrid_and", "hybrid_or"))
    assert pairs == {p for p, o in either.items() if o != "vector"}
    assert both.keys() == {p for p, o in either.items() if o == "both"}
