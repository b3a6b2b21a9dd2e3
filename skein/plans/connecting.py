"""Queries over written and reread data: JSON, CSV, dumps, streams, judged rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators.graph import triples
from ..sources import remote, stores, tables
from ..sources.shared import new_path
from ..sources.tables import table
from ..streaming.incremental import ResultTable, run_in_batches, stream_step, usage_windows
from .registry import query


@query("SELECT event_id, event_type, value FROM events")
def json_round_trip(spark, sf_dir):
    """Events written as JSON lines in two appends and read back with a schema."""
    path, rows = new_path(spark), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    tables.write_json(rows.filter("event_id % 2 = 0"), path, append=True)
    tables.write_json(rows.filter("event_id % 2 = 1"), path, append=True)
    return tables.read_json(spark, path, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("SELECT n_nationkey, n_name FROM nation")
def csv_round_trip(spark, sf_dir):
    """A small table written as one CSV file with a header and read back."""
    path, rows = new_path(spark), table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    tables.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT '<urn:c' || c_custkey || '>' AS s, '<urn:in>' AS p, '<urn:n' || c_nationkey || '>' AS o FROM customer")
def rdf_ntriples(spark, sf_dir):
    """Customers' nations written as N-Triples and read back."""
    path, c = new_path(spark), table(spark, sf_dir, "customer")
    c.select(F.format_string("<urn:c%d> <urn:in> <urn:n%d> .", F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long"))).write.text(path)
    return tables.read_ntriples(spark, path)


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type")
def file_stream(spark, sf_dir):
    """Events that arrive as files in two runs of a stream: each file is processed once."""
    source, sink, state = new_path(spark), new_path(spark), new_path(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (0, 1):
        rows.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        stream_step(spark, source, rows.schema, sink, state, lambda df: df).awaitTermination()
    return ResultTable(spark, sink).read().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Counts by event-time windows; an extension."""
    return usage_windows(table(spark, sf_dir, "events")).select(F.col("window.start").alias("hour"), "event_type", "n")


@query("""SELECT doc_id, CASE WHEN n_chars >= 100 THEN round(len(list_filter(string_split(lower(text), ' '), lambda w: w = 'the' OR w = lang))::DOUBLE / len(string_split(text, ' ')), 6) END::DOUBLE AS relevancy FROM documents""")
def judged_rows(spark, sf_dir):
    """A judge's score, the share of words that are the language's name or `the`; null where a row has no contexts."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.when(F.col("n_chars") >= 100, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("contexts"))
    words = F.split(F.lower("text"), " ")
    share = F.size(F.filter(words, lambda w: (w == "the") | (w == F.col("lang")))) / F.size(F.split("text", " "))
    return M.judge(rows, {"relevancy": F.round(share, 6)}).select("doc_id", "relevancy")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS run_id, o_orderpriority AS predicted_answer, count(*) AS n FROM orders GROUP BY ALL")
def numbered_runs(spark, sf_dir):
    """Results of two runs in one table by run number, their answers under the name that evaluation reads."""
    path, orders = new_path(spark), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("generated_answer"))
    orders.limit(0).withColumn("run_id", F.lit(0)).write.partitionBy("run_id").parquet(path)
    schema = "o_orderkey long, generated_answer string, run_id int"
    for part in (F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 3 != 0):
        number = tables.next_run(spark.read.schema(schema).parquet(path))
        orders.filter(part).withColumn("o_orderkey", F.col("o_orderkey").cast("long")).withColumn("run_id", F.lit(number)).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.schema(schema).parquet(path).groupBy("run_id", F.col("generated_answer").alias("predicted_answer")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS nation, count(*) AS n, 2 AS builds FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def store_rebuild(spark, sf_dir):
    """A graph of customers built into a store, loaded, and built anew when rows are added to its input."""
    path, name, builds = new_path(spark), "customers_" + uuid.uuid4().hex[:8], []
    c, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")

    def load():
        def build():
            builds.append(1)
            return triples(spark.read.parquet(path), F.col("c_name"), "IN_NATION", F.col("n_name"))

        return stores.stored(spark, name, [spark.read.parquet(path)], lambda: build().select(F.lower("tail").alias("key"), "head", "rel", "tail"), "key", 4)

    rows.filter("c_custkey % 3 = 0").write.parquet(path)
    load(), load()
    rows.filter("c_custkey % 3 <> 0").write.mode("append").parquet(path)
    found = load().groupBy(F.col("tail").alias("nation")).agg(F.count("*").alias("n"))
    return found.withColumn("builds", F.lit(len(builds)))


@query("SELECT vec_id, label FROM embeddings")
def vector_table(spark, sf_dir):
    """Vectors of one dimension, created as a store or loaded from it."""
    return stores.vector_store(spark, "embeddings_" + uuid.uuid4().hex[:8], table(spark, sf_dir, "embeddings"), 64).select("vec_id", "label")


@query("SELECT order_priority, n, n AS ids, 8 AS batches FROM (SELECT o_orderpriority AS order_priority, count(*) AS n FROM orders GROUP BY o_orderpriority)")
def resumed_batches(spark, sf_dir):
    """Orders evaluated in eight batches; the first run dies in its fourth, the second goes on and repeats nothing."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), new_path(spark)
    size, tried = -(-orders.count() // 8), []

    def step(df, dies=True):
        tried.append(1)
        if dies and len(tried) == 4:
            raise RuntimeError("lost")
        return df

    try:
        run_in_batches(orders, path, ["o_orderkey"], size, step)
    except RuntimeError:
        found = run_in_batches(orders, path, ["o_orderkey"], size, lambda df: step(df, dies=False))
    done = len(ResultTable(spark, path).committed())
    return found.groupBy(F.col("o_orderpriority").alias("order_priority")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids")).withColumn("batches", F.lit(done))


class _Nations:
    """A service over a few rows that throttles each page once."""

    def __init__(self, rows):
        self.rows, self.seen = sorted(rows), set()

    def bounds(self):
        return (self.rows[0][0], self.rows[-1][0]) if self.rows else None

    def page(self, after, upto, most):
        if (after, upto) not in self.seen:
            self.seen.add((after, upto))
            raise remote.Throttled(0.0)
        return [r for r in self.rows if after < r[0] <= upto][:most]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 5 AND n_regionkey <> 2")
def remote_scan(spark, sf_dir):
    """Nations behind a service that throttles, in ranges of their keys."""
    rows = [tuple(r) for r in table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long")).collect()]  # a fixed handful of nations
    found = remote.remote_table(spark, "skein_nations", _Nations(rows), "n_nationkey long, n_name string, n_regionkey long", "n_nationkey", partitions=4, page=3, wait=0.0)
    return found.filter("n_nationkey >= 5 AND n_regionkey <> 2")
