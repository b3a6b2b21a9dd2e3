"""Queries over references that count, documents of examples, answers of text prompts, paths and names of a graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answerers as A
from ..operators import graph as G
from ..operators import models as M
from ..operators import relational as O
from ..sources.tables import table
from . import registry as R
from .modelling import _NATIONS, _nations, _quoted, filled_sql
from .registry import query


@query(f"""WITH {R.TURNS_SQL} SELECT id, conv_id % 5 = 0 AS not_answerable, len(list_filter(string_split(ref, chr(10)), lambda x: trim(x) <> ''))::INT AS n_answers FROM turns
WHERE conv_id % 5 <> 0 AND len(list_filter(string_split(ref, chr(10)), lambda x: trim(x) <> '')) > 0""")
def answerable(spark, sf_dir):
    answers = F.filter(F.split("ref", "\n"), lambda x: F.trim(x) != "")
    rows = R.turns(spark, sf_dir).select("id", (F.col("conv_id") % 5 == 0).alias("not_answerable"), answers.alias("answers"))
    return O.answerable(rows, "not_answerable", "answers").select("id", "not_answerable", F.size("answers").alias("n_answers"))


@query("SELECT e.page_id, e.url, md5(d.html) AS html_md5 FROM pages e JOIN (SELECT url, min(page_id) AS first FROM pages GROUP BY url) f USING (url) JOIN pages d ON d.page_id = f.first")
def example_documents(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return O.with_document(pages.select("page_id", "url"), pages, "url", ["page_id"]).select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'yes') THEN 'yes' WHEN contains(lower(text), 'no') THEN 'no' ELSE 'yes|no' END AS answers FROM conversations")
def text_prompt_answers(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_yes_no("text").alias("a"))
    return found.select("conv_id", "turn", F.array_join(F.transform("a", lambda x: x["answer"]), "|").alias("answers"))


@query(f"WITH {R.TRIPLES_SQL} SELECT rel, tail, head, round_even(1.0 / count(*) OVER (PARTITION BY rel, tail), 2) AS score FROM triples WHERE rel IN ('LOCATED_IN', 'IN_REGION')")
def uniform_scores(spark, sf_dir):
    rows = R.star_triples(spark, sf_dir).filter(F.col("rel").isin("LOCATED_IN", "IN_REGION"))
    return rows.select("rel", "tail", "head", G.uniform_scores(rows, ["rel", "tail"]).cast("double").alias("score"))


@query(f"""WITH {R.TRIPLES_SQL} SELECT n.tail AS last, coalesce(s.head || ', LOCATED_IN, ' || s.tail || ' --> ', '') || n.head || ', IN_REGION, ' || n.tail AS path
FROM triples n LEFT JOIN triples s ON s.rel = 'LOCATED_IN' AND lower(s.tail) = lower(n.head) WHERE n.rel = 'IN_REGION'""")
def extended_paths(spark, sf_dir):
    graph = R.star_triples(spark, sf_dir).withColumn("qid", F.lit("q"))
    paths = graph.filter("rel = 'LOCATED_IN'").select("qid", F.col("tail").alias("last"), F.array(F.struct("head", "rel", "tail")).alias("path"))
    return G.extend_paths(paths, graph.filter("rel = 'IN_REGION'")).select("last", T.path_text(F.col("path")).alias("path"))


@query("SELECT DISTINCT page_id, regexp_replace(url, '^https?://(www\\.)?', '') AS name FROM pages")
def entity_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.entity_name(F.col("url")).alias("name")).distinct()


def _thirds(prompts: pd.Series) -> pd.Series:
    """Decides, decides under conditions, or doesn't, by the length of the prompt."""
    return prompts.map(lambda p: ("so\nAnswer: yes", "as\nAnswer: No . Conditions: c1\nc2", "it depends")[len(p) % 3])


_TRAIN = """train AS (SELECT id, answer, conditions, 'q ' || conv_id AS question, 'd ' || answer AS document FROM answered WHERE conv_id % 4 = 0)"""
_ASK = lambda kind, q, d: f"'Question: ' || {q} || chr(10) || 'Document: ' || {d} || chr(10) || {_quoted(A._reminder(kind, True) + ' ' + M.template('step_by_step'))}"


def _block_sql(kind: str) -> str:
    drawn = "md5('1:' || id), id"
    some = f"(SELECT * FROM train WHERE answer = 'yes' ORDER BY {drawn} LIMIT 2) UNION ALL (SELECT * FROM train WHERE answer = 'no' ORDER BY {drawn} LIMIT 2)" if kind == A.YES_NO else f"SELECT * FROM train WHERE answer NOT IN ('yes', 'no') ORDER BY {drawn} LIMIT 4"
    reply = "'first' || chr(10) || id || chr(10) || 'Answer: ' || answer || CASE WHEN len(conditions) > 0 THEN ' . Conditions: ' || array_to_string(conditions, chr(10)) ELSE '' END"
    return f"(SELECT coalesce(string_agg('human: ' || {_ASK(kind, 'question', 'document')} || chr(10) || 'assistant: ' || {reply} || chr(10), '' ORDER BY md5('2:' || id), id), '') FROM ({some}))"


def _prompt_sql(kind: str) -> str:
    task = _quoted("system: " + M.template("answer_task") % A._reminder(kind, True))
    return f"{task} || chr(10) || {_block_sql(kind)} || 'human: ' || {_ASK(kind, 'question', 'document')}"


@query(f"""WITH {R.ANSWERED_SQL}, {_TRAIN},
asked AS (SELECT id, 'p ' || turn AS question, p_answer AS document, CASE WHEN conv_id % 3 = 0 THEN 'yes/no' ELSE 'span' END AS qtype FROM answered WHERE conv_id % 4 <> 0),
p AS (SELECT id, qtype, CASE qtype WHEN 'yes/no' THEN {_prompt_sql(A.YES_NO)} ELSE {_prompt_sql(A.SPAN)} END AS prompt FROM asked)
SELECT id, md5(prompt) AS prompt_md5, CASE length(prompt) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' ELSE CASE qtype WHEN 'yes/no' THEN 'yes|no' ELSE 'it depends' END END AS answers, CASE length(prompt) % 3 WHEN 1 THEN 'c1|c2' ELSE '' END AS conditions FROM p""")
def text_answerer(spark, sf_dir):
    """Questions answered after drawn examples of their kind, with rationales and conditions."""
    a = R.answered(spark, sf_dir)
    train = a.filter("conv_id % 4 = 0").select("id", F.concat(F.lit("q "), "conv_id").alias("question"), F.concat(F.lit("d "), "answer").alias("document"), "answer", "conditions", F.array(F.lit("first"), "id").alias("evidence"))
    asked = a.filter("conv_id % 4 <> 0").select("id", F.concat(F.lit("p "), "turn").alias("question"), F.col("p_answer").alias("document"), F.when(F.col("conv_id") % 3 == 0, "yes/no").otherwise("span").alias("qtype"))
    found = A.text_answers(asked, train, _thirds)
    return found.select("id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.array_join(F.transform("answers", lambda x: x["answer"]), "|").alias("answers"), F.array_join(F.col("answers")[0]["conditions"], "|").alias("conditions"))


def _second(prompts: pd.Series) -> pd.Series:
    """Undecided at first about names with an odd end; at the second try it decides on 1 and 3 where its first reply stands ahead."""

    def reply(p: str) -> str:
        name = p.split("# Question: ")[1].split("\n")[0]
        if "assistant: # Answer: it depends" in p and name[-1] in "13":
            return "# Answer: yes\n\t if: " + name
        return "# Answer: no" if name[-1] in "02468" else "# Answer: it depends\n\t if: asked"

    return prompts.map(reply)


@query(f"""WITH {_NATIONS}, e AS (SELECT id, n_name, right(n_name, 1) AS e, id % 5 = 0 AS span FROM n)
SELECT id, CASE WHEN e IN ('0', '2', '4', '6', '8') THEN 'no' WHEN span THEN 'it depends' WHEN e IN ('1', '3') THEN 'yes' ELSE 'yes|no' END AS answers,
CASE WHEN e IN ('0', '2', '4', '6', '8') THEN '' WHEN NOT span AND e IN ('1', '3') THEN n_name ELSE 'asked' END AS conditions, NOT span AND e NOT IN ('0', '2', '4', '6', '8') AS tried_twice FROM e""")
def code_second_try(spark, sf_dir):
    """Undecided yes/no answers asked for once more, with the first try ahead."""
    rows = _nations(spark, sf_dir).select("id", F.lit("q = 1").alias("question_code"), F.col("r_name").alias("document_code"), F.col("n_name").alias("question"), F.when(F.col("id") % 5 == 0, "span").otherwise("yes/no").alias("qtype"))
    found = A.code_answers(rows, _second, remember=True)
    return found.select("id", F.array_join(F.transform("answers", lambda x: x["answer"]), "|").alias("answers"), F.array_join(F.col("answers")[0]["conditions"], "|").alias("conditions"), F.col("response2").isNotNull().alias("tried_twice"))
