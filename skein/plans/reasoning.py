"""Queries over traversals that ask a model, answers from chains, prompts with examples, judged predictions, vectors of triples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import models as M
from ..operators import retrieval as V
from ..sources import tables
from ..sources.shared import new_path
from ..sources.tables import table
from ..streaming.incremental import failures
from . import registry as R
from . import searching as S
from .modelling import _NATIONS, _failing, _nations, _quoted, filled_sql
from .registry import query


def _same(prompts: pd.Series) -> pd.Series:
    return prompts


_ASKED = [(q, f"What of {q}?", "span" if q == "q1" else "yes/no") for q in ("q1", "q2", "q3", "q4")]


def _enough(prompts: pd.Series) -> pd.Series:
    """Says yes to facts about Europe, and otherwise sends a search on to it."""
    return prompts.map(lambda p: "{Yes} {it is there}" if "EUROPE" in p else "{No} see {europe}")


@query()
def traverse_clues(spark, sf_dir):
    """Traversals that follow a model's clues and stop at its answer."""
    topics = spark.createDataFrame([*S._TOPICS, ("q4", "nowhere")], "qid string, entity string")
    score, asked = S._stub("t"), spark.createDataFrame(_ASKED, "qid string, question string, qtype string")
    return G.traverse_with_clues(R.star_triples(spark, sf_dir), topics, lambda q, x: score(q, x) * 10, M.reasoner(asked, _enough))


_VALUES = f"asked AS (SELECT * FROM (VALUES {', '.join(map(str, _ASKED))}) v(qid, question, qtype))"


@query(f"""{S.BEAM_SQL}, {_VALUES} SELECT qid, CASE WHEN chains IS NULL THEN 'model' ELSE 'model+graph' END AS ans_from,
CASE WHEN chains IS NULL THEN {filled_sql(M.template('answer_alone'), 'question')} WHEN qtype = 'span' THEN {filled_sql(M.template('answer', 'span'), 'chains', 'question')} ELSE {filled_sql(M.template('answer', 'yes/no'), 'chains', 'question')} END AS response
FROM asked LEFT JOIN chains USING (qid)""")
def beam_answers(spark, sf_dir):
    """Answers from the chains of a beam, or without a graph where there are none."""
    asked = spark.createDataFrame(_ASKED, "qid string, question string, qtype string")
    return M.answer_chains(asked, S.beam_chains(spark, sf_dir), _same).select("qid", "ans_from", "response")


@query(f"""WITH {_NATIONS} SELECT id, 'q = 1' || chr(10) || n_name || chr(10) || '# Question: ' || r_name || chr(10) || '# Reasons:' AS prompt,
'# it is' || chr(10) || '# ' || n_name || chr(10) || '# Answer: ' || r_name || CASE WHEN id % 2 = 0 THEN chr(10) || chr(9) || ' if: ' || n_name || chr(10) || chr(9) || ' if: member' ELSE '' END AS reasoned, r_name AS plain FROM n""")
def demonstrations(spark, sf_dir):
    """Worked examples with and without rationales and conditions."""
    conditions = F.when(F.col("id") % 2 == 0, F.array(F.col("n_name"), F.lit("member"))).otherwise(F.array().cast("array<string>"))
    parts = (F.lit("q = 1"), F.col("n_name"), F.col("r_name"), F.col("r_name"))
    full = M.demonstration(*parts, rationale=F.concat(F.lit("it is\n"), "n_name"), conditions=conditions)
    return _nations(spark, sf_dir).select("id", full["prompt"].alias("prompt"), full["reply"].alias("reasoned"), M.demonstration(*parts)["reply"].alias("plain"))


@query(f"WITH {R.TRIPLES_SQL} SELECT DISTINCT n_name AS entity, rel AS relation FROM nation JOIN triples ON lower(n_name) IN (lower(head), lower(tail)) WHERE rel <> 'IN_NATION'")
def relation_lines(spark, sf_dir):
    """Relations that a model repeats, one a line."""

    def keep(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: "\n".join(x for x in p.split("\n")[1:-1] if x != "IN_NATION"))

    found = G.frontier_relations(R.star_triples(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity")))
    named = found.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("relation")), "\n").alias("relations"))
    prompt = F.format_string(M.template("keep_relations"), F.col("entity"), F.col("relations"), F.lit("Where?"))
    return M.complete(named, prompt, keep).select("entity", F.explode(F.split("response", "\n")).alias("relation"))


@query(f"WITH {_NATIONS} SELECT id, upper(n_name[1]) || lower(n_name[2:]) AS head, 'Is in' AS rel, upper(r_name[1]) || lower(r_name[2:]) AS tail FROM n")
def path_filter(spark, sf_dir):
    """The facts of paths that a model holds to be enough."""

    def last(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: "(" + p.split("Paths: ")[1].split("\n")[0].split(" --> ")[-1] + ")")

    path = F.concat(F.lit("a, b, "), "n_name", F.lit(" --> "), "n_name", F.lit(", is in, "), "r_name")
    prompt = F.format_string(M.template("filter_paths"), F.lit("Where?"), path)
    return M.complete(_nations(spark, sf_dir), prompt, last).select("id", F.inline(T.parse_triplets("response")))


@query(f"""WITH {R.TURNS_SQL}, worded AS (SELECT id, turn, {R.tokens_sql('pred')} AS pt, {R.tokens_sql('ref')} AS gt FROM turns)
SELECT id, metric, CASE WHEN turn % 4 <> 0 THEN round(CASE WHEN metric = 'correctness' THEN {R.answer_f1_sql('pt', 'gt')} WHEN len(pt) = 0 THEN 0 ELSE {R.overlap_sql('pt', 'gt')} / len(pt) END, 6) END::DOUBLE AS score
FROM worded, (VALUES ('correctness'), ('faithfulness')) m(metric)""")
def evaluation_driver(spark, sf_dir):
    """Predictions made, judged by words, and the scores written and read back."""
    path = new_path(spark)
    examples = R.turns(spark, sf_dir).withColumn("contexts", F.when(F.col("turn") % 4 != 0, F.array("ref")).otherwise(F.array().cast("array<string>")))
    p, g = T.tokens("response"), T.tokens("ref")
    faithful = F.when(F.size(p) == 0, 0.0).otherwise(T.overlap(p, g) / F.size(p))
    judges = {"correctness": F.round(T.answer_f1(g, p), 6), "faithfulness": F.round(faithful, 6)}
    tables.write_json(M.evaluate(examples, judges, lambda df: M.complete(df, F.col("pred"), _same)), path)
    return tables.read_json(spark, path, "id string, metric string, score double")


@query(f"WITH {_NATIONS} SELECT id::VARCHAR AS id, r_name AS reference, n_name AS question, 'span' AS qtype FROM n")
def prediction_references(spark, sf_dir):
    """References, questions and types read back from a file of predictions."""
    path = new_path(spark)
    tables.write_json(_nations(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("n_name").alias("Question"), F.col("r_name").alias("Actual_Answer"), F.lit("span").alias("Question_Type")), path)
    return tables.references(spark, path)


@query(f"WITH {_NATIONS} SELECT id, 'ValueError: no answer' AS error FROM n WHERE id % 4 = 0")
def skipped_rows(spark, sf_dir):
    """Rows that a later run should try again."""
    return failures(M.complete(_nations(spark, sf_dir), F.concat(F.when(F.col("id") % 4 == 0, "C").otherwise(""), "n_name"), _failing)).select("id", "error")


_STOPS = ", ".join(_quoted(w) for w in T.STOP_WORDS)


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM conversations), b AS (SELECT word, trim(translate(lower(word), '{R._MARKS}', '')) AS bare FROM w)
SELECT word, CASE WHEN bare IN ({_STOPS}) THEN '' ELSE bare END AS bare FROM b""")
def bare_words(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", T.without_stop_word(F.col("word")).alias("bare"))


@query("""WITH l AS (SELECT (1000 + c_custkey)::BIGINT AS node_id, c_name AS label, CASE WHEN c_custkey % 3 = 0 THEN 'fr' ELSE 'en' END AS lang, c_nationkey FROM customer)
SELECT n_name AS label, 'IN' AS relation, false AS is_head, label AS neighbour FROM nation JOIN l ON c_nationkey = n_nationkey WHERE lang = 'en'
QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY l.label) <= 100""")
def neighbour_labels(spark, sf_dir):
    """English names of what lies next to each nation, a hundred at most."""
    c, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    node = (F.col("c_custkey") + 1000).cast("long")
    labels = c.select(node.alias("node_id"), F.col("c_name").alias("label"), F.when(F.col("c_custkey") % 3 == 0, "fr").otherwise("en").alias("lang"))
    labels = labels.union(nation.select(F.col("n_nationkey").cast("long"), "n_name", F.lit("en")))
    edges = c.select(node.alias("src_id"), F.lit("IN").alias("relation"), F.col("c_nationkey").cast("long").alias("dst_id"))
    return G.neighbour_labels(edges, labels, nation.select(F.col("n_name").alias("label")))


_DIM = 16
_SOUGHT = [(1, "nation asia region"), (2, "red widget has brand"), (3, "order placed by customer")]


def _counts(text):
    """Counts of words by a hash of them: what stands in for a model's vectors."""
    at = F.transform(F.split(T.kg_text(text), " "), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % _DIM)
    # `at` stands once, as the one element of an array: named in the inner function itself it would be hashed anew for each count
    count = lambda a, i: F.size(F.filter(a, lambda x: x == i)).cast("float")
    return F.element_at(F.transform(F.array(at), lambda a: F.array(*[count(a, i) for i in range(_DIM)])), 1)


def _counts_sql(text: str) -> str:
    words = f"list_transform(string_split(lower(replace(trim({text}), '_', ' ')), ' '), lambda w: ('0x' || substr(md5(w), 1, 4))::BIGINT % {_DIM})"
    return f"list_transform(range({_DIM}), lambda i: len(list_filter({words}, lambda a: a = i))::DOUBLE)"


@query(f"""WITH {R.TRIPLES_SQL}, t AS (SELECT *, {_counts_sql("concat_ws(' ', head, rel, tail)")} AS v, row_number() OVER (ORDER BY head, rel, tail) AS key FROM triples),
q AS (SELECT query_id::BIGINT AS query_id, {_counts_sql('text')} AS v FROM (VALUES {', '.join(map(str, _SOUGHT))}) s(query_id, text))
SELECT query_id, head, rel, tail, round(list_distance(q.v, t.v) ** 2, 6) AS distance FROM q, t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(q.v, t.v) ** 2, 6), key) <= 30""")
def triple_vectors(spark, sf_dir):
    """The thirty triples nearest to a question by vectors of their texts."""
    vectors = R.star_triples(spark, sf_dir).select(*G.SIDES, _counts(F.concat_ws(" ", *G.SIDES)).alias("embedding"))
    found = V.top_k(vectors, spark.createDataFrame(_SOUGHT, "query_id long, text string").withColumn("embedding", _counts(F.col("text"))), 30, list(G.SIDES))
    return found.select("query_id", *G.SIDES, F.round("distance", 6).alias("distance"))


def _passage(prompts: pd.Series) -> pd.Series:
    """Answers with the question's words twice and a place."""
    return prompts.map(lambda p: " ".join([p.rsplit("\n", 1)[1]] * 2) + " europe")


@query(f"""WITH p AS (SELECT p_partkey::BIGINT AS vec_id, {_counts_sql("p_name || ' ' || p_brand || ' ' || p_type")} AS v FROM part),
q AS (SELECT query_id::BIGINT AS query_id, {_counts_sql("text || ' ' || text || ' europe'")} AS v FROM (VALUES {', '.join(map(str, _SOUGHT))}) s(query_id, text))
SELECT query_id, vec_id, round(list_distance(q.v, p.v) ** 2, 6) AS distance FROM q, p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(q.v, p.v) ** 2, 6), vec_id) <= 5""")
def passage_search(spark, sf_dir):
    """Parts nearest to the passage a model would answer with instead of the question."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("vec_id"), _counts(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("embedding"))
    written_out = lambda q: M.complete(q, F.format_string(M.template("passage"), F.col("text")), _passage).select("query_id", F.col("response").alias("text"))
    found = V.search(parts, spark.createDataFrame(_SOUGHT, "query_id long, text string"), _counts, 5, written_out)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))
