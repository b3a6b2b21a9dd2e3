"""Where queries and their SQL are listed, and SQL that several share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..sources.stores import GraphStore, graph_store, stored
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_MARKS = T.PUNCTUATION.replace("'", "''")


def tokens_sql(x: str) -> str:
    """Words of normalised text in DuckDB."""
    return f"list_filter(string_split(regexp_replace(translate(lower({x}), '{_MARKS}', ''), '\\s+', ' ', 'g'), ' '), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def norm_sql(x: str) -> str:
    return f"array_to_string({tokens_sql(x)}, ' ')"


def overlap_sql(p: str, g: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({p}), lambda w: least(len(list_filter({p}, lambda y: y = w)), len(list_filter({g}, lambda z: z = w))))), 0)"


def answer_f1_sql(p: str, g: str) -> str:
    return f"CASE WHEN len({p}) = 0 OR len({g}) = 0 THEN (len({p}) = len({g}))::INT::DOUBLE WHEN {overlap_sql(p, g)} = 0 THEN 0.0 ELSE 2.0 * {overlap_sql(p, g)} / (len({p}) + len({g})) END"


def condition_f1_sql(p: str, g: str) -> str:
    common = f"len(list_intersect(list_distinct({p}), list_distinct({g})))"
    return f"CASE WHEN len({g}) = 0 THEN (len({p}) = 0)::INT::DOUBLE WHEN len({p}) = 0 OR {common} = 0 THEN 0.0 ELSE 2.0 * ({common}::DOUBLE / len({p})) * ({common}::DOUBLE / len({g})) / ({common}::DOUBLE / len({p}) + {common}::DOUBLE / len({g})) END"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conv_id, turn, ref, pred): a user's text as reference, the reply after it as prediction."""
    c = table(spark, sf_dir, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return user.join(reply, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "ref", "pred")


TURNS_SQL = "turns AS (SELECT u.conv_id || '-' || u.turn AS id, u.conv_id, u.turn, u.text AS ref, a.text AS pred FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns with answers: the first line is an answer, the others its conditions; every third conversation asks for yes or no."""
    parts = lambda c: (F.element_at(F.split(c, "\n"), 1), F.slice(F.split(c, "\n"), F.lit(2), F.size(F.split(c, "\n"))))
    t = turns(spark, sf_dir)
    (pa, pc), (ra, rc) = parts(F.col("pred")), parts(F.col("ref"))
    yes = F.when(F.col("conv_id") % 3 == 0, F.when(F.col("turn") % 4 == 0, "yes").otherwise("no"))
    return t.select("id", "conv_id", "turn", F.coalesce(yes, pa).alias("p_answer"), pc.alias("p_conditions"), F.coalesce(F.when(F.col("conv_id") % 3 == 0, F.when(F.col("conv_id") % 2 == 0, "yes").otherwise("no")), ra).alias("answer"), rc.alias("conditions"))


ANSWERED_SQL = f"""{TURNS_SQL}, answered AS (
  SELECT id, conv_id, turn,
    CASE WHEN conv_id % 3 = 0 THEN CASE WHEN turn % 4 = 0 THEN 'yes' ELSE 'no' END ELSE string_split(pred, chr(10))[1] END AS p_answer,
    string_split(pred, chr(10))[2:] AS p_conditions,
    CASE WHEN conv_id % 3 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'yes' ELSE 'no' END ELSE string_split(ref, chr(10))[1] END AS answer,
    string_split(ref, chr(10))[2:] AS conditions FROM turns)"""
SCORED_SQL = f"""{ANSWERED_SQL}, worded AS (
  SELECT *, {tokens_sql('p_answer')} AS pt, {tokens_sql('answer')} AS gt FROM answered), base AS (
  SELECT *, (array_to_string(pt, ' ') = array_to_string(gt, ' '))::INT::DOUBLE AS em, {answer_f1_sql('pt', 'gt')} AS f1, {condition_f1_sql('p_conditions', 'conditions')} AS cond FROM worded), scored AS (
  SELECT *, em * cond AS conditional_em, f1 * cond AS conditional_f1, answer IN ('yes', 'no') AS yesno, len(conditions) > 0 AS conditional FROM base)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answered(spark, sf_dir)
    s = T.em_f1(F.col("p_answer"), F.col("p_conditions"), F.col("answer"), F.col("conditions"))
    out = a.withColumn("_s", s).select("*", "_s.*", T.condition_f1(F.col("p_conditions"), F.col("conditions")).alias("cond")).drop("_s")
    return out.withColumn("yesno", F.col("answer").isin("yes", "no")).withColumn("conditional", F.size("conditions") > 0)


_SOURCES = ("customer", "nation", "region", "supplier", "orders", "part", "lineitem")


def _star(sf_dir: str) -> str:
    return "star_" + hashlib.sha256(sf_dir.encode()).hexdigest()[:8]


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table of triples (head, rel, tail): built by the first query that reads it, and again when a table has changed."""
    return stored(spark, _star(sf_dir), [table(spark, sf_dir, n) for n in _SOURCES], lambda: _star_rows(spark, sf_dir).distinct())


def star_store(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The same triples dealt by head and by tail, for what searches from frontiers."""
    return graph_store(spark, _star(sf_dir), [table(spark, sf_dir, n) for n in _SOURCES], lambda: _star_rows(spark, sf_dir), repeats=True)


def _star_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as triples, some of them several times."""
    t = lambda n: table(spark, sf_dir, n)
    nation, orders = t("nation"), t("orders")
    order = F.concat(F.lit("order "), F.col("o_orderkey"))
    item = F.concat(F.lit("order "), F.col("l_orderkey"))
    parts = [
        G.triples(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_name"), "IN_NATION", F.col("n_name")),
        G.triples(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("n_name"), "IN_REGION", F.col("r_name")),
        G.triples(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), F.col("s_name"), "LOCATED_IN", F.col("n_name")),
        G.triples(orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), order, "PLACED_BY", F.col("c_name")),
        G.triples(orders, order, "HAS_PRIORITY", F.col("o_orderpriority")),
        G.triples(t("part"), F.col("p_name"), "HAS_BRAND", F.col("p_brand")),
        G.triples(t("part"), F.col("p_name"), "HAS_TYPE", F.col("p_type")),
        G.triples(t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")), item, "CONTAINS", F.col("p_name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


TRIPLES_SQL = """triples AS (
  SELECT c_name AS head, 'IN_NATION' AS rel, n_name AS tail FROM customer JOIN nation ON c_nationkey = n_nationkey UNION
  SELECT n_name, 'IN_REGION', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION
  SELECT s_name, 'LOCATED_IN', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION
  SELECT 'order ' || o_orderkey, 'PLACED_BY', c_name FROM orders JOIN customer ON o_custkey = c_custkey UNION
  SELECT 'order ' || o_orderkey, 'HAS_PRIORITY', o_orderpriority FROM orders UNION
  SELECT p_name, 'HAS_BRAND', p_brand FROM part UNION
  SELECT p_name, 'HAS_TYPE', p_type FROM part UNION
  SELECT 'order ' || l_orderkey, 'CONTAINS', p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"""
