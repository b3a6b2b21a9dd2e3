"""Queries over model steps, with models that answer by rule, and over what stands around them: prompts, failures, dumps, data sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import graph as G
from ..operators import models as M
from ..operators import relational as O
from ..operators import retrieval as V
from ..sources import tables
from ..sources.shared import new_path
from ..sources.tables import table
from . import registry as R
from .registry import query


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def filled_sql(template: str, *values: str) -> str:
    """A template with its blanks filled by SQL expressions."""
    parts = template.replace("%d", "%s").split("%s")
    return " || ".join([_quoted(parts[0]), *[f"{v} || {_quoted(p)}" for v, p in zip(values, parts[1:], strict=True)]])


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("int").alias("id"), "n_name", "r_name")


_NATIONS = "n AS (SELECT n_nationkey::INT AS id, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
_CANDIDATES = "c AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '{0}' ELSE lang END AS candidate FROM documents)"


def _candidates(spark, sf_dir, marker):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, marker).otherwise(F.col("lang")).alias("candidate"))


@query(f"WITH {_CANDIDATES.format(G.UNNAMED)} SELECT doc_id, source, candidate FROM c QUALIFY candidate <> '{G.UNNAMED}' OR sum((candidate <> '{G.UNNAMED}')::INT) OVER (PARTITION BY source) = 0")
def placeholder_entities(spark, sf_dir):
    return G.drop_placeholders(_candidates(spark, sf_dir, G.UNNAMED), ["source"])


@query(f"WITH {_CANDIDATES.format(G.FINISH)} SELECT source, count_if(candidate <> '{G.FINISH}')::BIGINT AS n_open, bool_and(candidate = '{G.FINISH}') AS finished FROM c GROUP BY source")
def finish_markers(spark, sf_dir):
    return G.finish_status(_candidates(spark, sf_dir, G.FINISH), ["source"])


@query(f"SELECT w.label, coalesce(n_nationkey::INT::VARCHAR, '{G.UNNAMED}') AS node_id FROM (SELECT n_name AS label FROM nation UNION ALL SELECT s_name FROM supplier) w LEFT JOIN nation ON n_name = w.label")
def entity_labels(spark, sf_dir):
    """Names with their nodes, or the placeholder where no node has the name."""
    nation = table(spark, sf_dir, "nation")
    labels = nation.select(F.col("n_nationkey").cast("int").alias("node_id"), F.col("n_name").alias("label"))
    return G.label_lookup(labels, labels.select("label").union(table(spark, sf_dir, "supplier").select("s_name")), G.UNNAMED).select("label", "node_id")


@query("""SELECT c_custkey::BIGINT AS id, relation, CASE WHEN c_custkey % 2 = 0 THEN 1.0 / 3 ELSE score END::DOUBLE AS score
FROM customer, (VALUES ('a', 0.5), ('b', 0.25), ('c', 0.0)) r(relation, score)""")
def ranked_relations(spark, sf_dir):
    """Scores given from outside; equal ones where all are zero."""
    scores = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.0)))
    ranked = G.ranked_relations(F.array(F.lit("a"), F.lit("b"), F.lit("c")), scores)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.inline(ranked))


_RELATIONS = f"""WITH {R.TRIPLES_SQL}, e AS (SELECT DISTINCT n_name AS entity, rel FROM nation JOIN triples ON lower(n_name) IN (lower(head), lower(tail))),
p AS (SELECT entity, string_agg(rel, '; ' ORDER BY rel) AS relations FROM e GROUP BY entity)"""


def _relation_prompts(spark, sf_dir):
    frontier = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"))
    found = G.frontier_relations(R.star_triples(spark, sf_dir), frontier)
    named = found.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("relation")), "; ").alias("relations"))
    return named.withColumn("prompt", F.format_string(M.template("prune_relations"), F.col("entity"), F.lit(3), F.concat(F.lit("Where is "), F.col("entity")), F.col("relations")))


@query(f"{_RELATIONS} SELECT entity, {filled_sql(M.template('prune_relations'), 'entity', _quoted('3'), _quoted('Where is ') + ' || entity', 'relations')} AS prompt FROM p")
def relation_prompts(spark, sf_dir):
    return _relation_prompts(spark, sf_dir).select("entity", "prompt")


def _score_relations(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: "\n".join(f"{r} (Score: 0.{9 - i})" for i, r in enumerate(p.rsplit("\n", 1)[1].split("; "))))


@query(f"{_RELATIONS} SELECT entity, rel AS relation, ('0.' || (10 - row_number() OVER (PARTITION BY entity ORDER BY rel)))::DOUBLE AS score, rel = 'IN_REGION' AS is_head FROM e")
def relation_prune(spark, sf_dir):
    """A model's scores of relations, parsed."""
    answered = M.complete(_relation_prompts(spark, sf_dir), F.col("prompt"), _score_relations)
    return answered.select("entity", F.inline(T.parse_scored_relations("response", F.array(F.lit("IN_REGION")))))


def _score_entities(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: ", ".join(f"0.{i + 1}" for i in range(len(p.split("; ")))) if "A" in p.split("Relation: ")[1].split("\n")[0] else "all of them")


@query("""WITH e AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS k, count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, n_name, CASE WHEN contains(r_name, 'A') THEN ('0.' || k)::DOUBLE ELSE 1.0 / n END::DOUBLE AS score FROM e""")
def entity_scores(spark, sf_dir):
    """A model's scores of entities; equal ones where it gives another number of them."""
    grouped = _nations(spark, sf_dir).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    prompt = F.format_string(M.template("score_entities"), F.lit("Which?"), F.col("r_name"), F.array_join("names", "; "))
    scores = T.parse_scores("response", F.size("names"))
    return M.complete(grouped, prompt, _score_entities).select("r_name", F.inline(F.arrays_zip("names", scores.alias("score")))).toDF("r_name", "n_name", "score")


def _reason(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: "{ Yes } {done}" if len(p) % 2 == 0 else "{No} look for {age} and {place}")


@query(f"""WITH {R.TURNS_SQL}, p AS (SELECT id, length({filled_sql(M.template('reason'), 'ref', 'pred')}) % 2 = 0 AS stop FROM turns)
SELECT id, stop, CASE WHEN stop THEN NULL ELSE 'age,place' END AS clues FROM p""")
def sufficiency(spark, sf_dir):
    """Whether facts are enough by a model's word, or else what to look for."""
    t = R.turns(spark, sf_dir)
    answered = M.complete(t, F.format_string(M.template("reason"), F.col("ref"), F.col("pred")), _reason)
    stop = T.is_yes(T.first_brace("response"))
    return answered.select("id", stop.alias("stop"), F.when(~stop, F.array_join(T.braces("response"), ",")).alias("clues"))


def _keywords(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: "KEYWORDS: " + ", ".join(p.rsplit("\n", 1)[1].split(" ")))


@query("SELECT p_partkey::BIGINT AS id, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: w <> ''))), ',') AS keywords FROM part")
def keyword_extraction(spark, sf_dir):
    """Keywords of a model's answer."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_name")
    answered = M.complete(rows, F.format_string(M.template("keywords"), F.col("p_name")), _keywords)
    return answered.select("id", F.array_join(F.array_sort(T.keywords("response")), ",").alias("keywords"))


def _extract(prompts: pd.Series) -> pd.Series:
    def answer(p: str) -> str:
        if "Facts so far: " in p:
            return p.split("Facts so far: ")[1].split("\nAdd facts")[0] + "\n(step, comes after, step)"
        name, region = p.rsplit("\n", 1)[1].split(" in ")
        return f"({name}, is in, {region})"

    return prompts.map(answer)


@query(f"""WITH {_NATIONS} SELECT id, 0 AS pos, upper(n_name[1]) || lower(n_name[2:]) AS head, 'Is in' AS rel, upper(r_name[1]) || lower(r_name[2:]) AS tail FROM n
UNION ALL SELECT id, k AS pos, 'Step', 'Comes after', 'Step' FROM n, (VALUES (1), (2)) s(k)""")
def refined_extraction(spark, sf_dir):
    """Triples by three prompts, each of which gets what the one before gave."""
    rows = _nations(spark, sf_dir).select("id", F.concat_ws(" in ", "n_name", "r_name").alias("text"))
    return M.refine(rows, "text", _extract).select("id", F.posexplode("triples").alias("pos", "t")).select("id", "pos", "t.*")


def _kind(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: "A Span." if len(p) % 3 == 0 else "Yes or no")


@query(f"WITH {R.TURNS_SQL} SELECT id, CASE WHEN length({filled_sql(M.template('classify'), 'ref')}) % 3 = 0 THEN 'span' ELSE 'yes/no' END AS qtype FROM turns")
def model_question_type(spark, sf_dir):
    return M.classify(R.turns(spark, sf_dir), "ref", _kind).select("id", "qtype")


def _echoed(prompts: pd.Series) -> pd.Series:
    """What stands to be translated, between marks."""
    return prompts.map(lambda p: "<" + p.rstrip("\n").split("\n")[-2] + ">")


_TASKS = ("doc_to_code", "question_to_code", "code_to_text")
_BLOCK = "(SELECT string_agg(c_name || chr(10) || c_mktsegment, chr(10) || chr(10) ORDER BY d, c_custkey) FROM (SELECT *, md5('1:' || c_custkey) AS d FROM customer ORDER BY d, c_custkey LIMIT 4))"


@query(f"WITH block AS (SELECT {_BLOCK} AS b) " + " UNION ALL ".join(f"SELECT '{t}' AS task, p_partkey, md5({filled_sql(M.template(t, shots=4), 'b', 'p_name')}) AS prompt_md5, '<' || p_name || '>' AS response FROM part, block" for t in _TASKS))
def translations(spark, sf_dir):
    """Texts to code, questions to code and code to text, each after four drawn examples."""
    demos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("given"), F.col("c_mktsegment").alias("made"))
    rows, out = table(spark, sf_dir, "part").select("p_partkey", "p_name"), None
    for task in _TASKS:
        made = M.translate(rows, "p_name", task, demos, _echoed).select(F.lit(task).alias("task"), "p_partkey", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "response")
        out = made if out is None else out.union(made)
    return out


@query(f"SELECT p_partkey, md5({filled_sql(M.template('doc_to_code', shots=4), _BLOCK, 'p_name')}) AS prompt_md5 FROM part")
def translation_prompts(spark, sf_dir):
    """Prompts with examples ahead, to turn a text into code."""
    return translations(spark, sf_dir).filter("task = 'doc_to_code'").select("p_partkey", "prompt_md5")


def _linear(prompts: pd.Series) -> pd.Series:
    """The linear form of a name's words: the first has the others as parts."""

    def form(p: str) -> str:
        first, *others = p.split(" ")
        return f"<s><triplet> {first} " + " ".join(f"<subj> {w} <obj> has part" for w in others) + "</s>"

    return prompts.map(form)


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS head, 'has part' AS rel, unnest(string_split(p_name, ' ')[2:]) AS tail FROM part")
def extracted_relations(spark, sf_dir):
    """Triples of a model's linear form."""
    found = M.extract_linear(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _linear)
    return found.select("p_partkey", F.inline("triples"))


@query("SELECT p_partkey, p_name, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS topic_entity FROM part")
def keywords_written(spark, sf_dir):
    """Rows read from JSON lines, given keywords by a model, written as JSON lines and read back."""
    given, made, rows = new_path(spark), new_path(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    schema = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    tables.write_json(rows, given)
    answered = M.complete(tables.read_json(spark, given, schema), F.format_string(M.template("keywords"), F.col("p_name")), _keywords)
    tables.write_json(answered.select("p_partkey", "p_name", T.keywords("response").alias("topic_entity")), made)
    back = tables.read_json(spark, made, f"{schema}, topic_entity array<string>")
    return back.withColumn("topic_entity", F.array_join(F.array_sort("topic_entity"), ","))


def _judge(prompts: pd.Series) -> pd.Series:
    """Rates by the length of the answer, finds a context that holds the letter e fitting, and bears out what is short."""

    def reply(p: str) -> str:
        if p.startswith("Question: ") and "\nReference: " in p:
            n = len(p.split("\nAnswer: ")[1].split("\nRate the answer")[0])
            return "none" if n % 7 == 0 else f"{n % 5 + 1}.5\nfor its length"
        context = p.split("\nContext:\n")[1]
        return "YES" if ("e" in context.split("\nDo question")[0] if p.startswith("Question: ") else len(p) % 2 == 0) else "NO"

    return prompts.map(reply)


@query(f"""WITH {R.TURNS_SQL}, c AS (SELECT *, CASE WHEN turn % 4 = 0 THEN '' ELSE ref || chr(10) || 'x' END AS context FROM turns)
SELECT id, CASE WHEN length(pred) % 7 <> 0 THEN length(pred) % 5 + 1.5 END::DOUBLE AS correctness, CASE WHEN length(pred) % 7 <> 0 THEN length(pred) % 5 + 1.5 >= 4 END AS passing,
CASE WHEN turn % 4 <> 0 THEN contains(context, 'e')::INT END::DOUBLE AS relevancy, CASE WHEN turn % 4 <> 0 THEN (length({filled_sql(M.template('judge_faithfulness'), 'pred', 'context')}) % 2 = 0)::INT END::DOUBLE AS faithfulness FROM c""")
def model_judged(spark, sf_dir):
    """Correctness, relevancy and faithfulness by a model's word; the last two need contexts."""
    rows = R.turns(spark, sf_dir).select("id", F.col("ref").alias("question"), F.col("conv_id").cast("string").alias("reference"), F.col("pred").alias("response"), F.when(F.col("turn") % 4 != 0, F.array("ref", F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("contexts"))
    return M.model_judges(rows, _judge).select("id", "correctness", "passing", "relevancy", "faithfulness")


def _code(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: f"# Answer: {'no' if p.startswith('A') else 'it depends'}\n\t if: member\n\t if: {p.split(chr(10))[0]}")


@query(f"WITH {_NATIONS} SELECT id, a.answer, 'member,' || n_name AS conditions FROM n, (VALUES ('yes'), ('no')) a(answer) WHERE a.answer = 'no' OR NOT starts_with(n_name, 'A')")
def code_answers(spark, sf_dir):
    """Answers with conditions of a model's code; both where it is neither yes nor no."""
    answered = M.complete(_nations(spark, sf_dir), F.format_string(M.template("code_answer"), F.col("n_name"), F.col("r_name")), _code)
    return answered.select("id", F.inline(T.parse_code_answer("response", F.lit(True)))).select("id", "answer", F.array_join("conditions", ",").alias("conditions"))


def _failing(prompts: pd.Series) -> pd.Series:
    if prompts.str.startswith("C").any():
        raise ValueError("no answer")
    return prompts.str.lower()


@query(f"WITH {_NATIONS} SELECT id, CASE WHEN NOT starts_with(n_name, 'C') THEN lower(n_name) END AS response, CASE WHEN starts_with(n_name, 'C') THEN 'ValueError: no answer' END AS error FROM n")
def failed_rows(spark, sf_dir):
    """A model that fails: rows it fails on are data, others of their batch are answered."""
    return M.complete(_nations(spark, sf_dir), F.col("n_name"), _failing).select("id", "response", "error")


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join([_quoted(n), _quoted(q), str(s), _quoted(b)]) + ')' for (n, q, s), b in M.TEMPLATES.items())}) t(name, qtype, shots, body)")
def prompt_templates(spark, sf_dir):
    return M.templates(spark)


@query("SELECT c_name AS label, 7::BIGINT AS edge_id, (1000000 + c_nationkey)::BIGINT AS dst_id FROM customer")
def rdf_turtle(spark, sf_dir):
    """Customers' nations written as Turtle blocks and read back with their labels."""
    path, c = new_path(spark), table(spark, sf_dir, "customer")
    block = F.format_string('ns1:%d ns1:7 ns1:%d ;\n    ns1:id "%s" .', F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long") + 1000000, F.col("c_name"))
    c.select(block).write.option("lineSep", "\n\n").text(path)
    edges, labels = tables.read_turtle(spark, path)
    return edges.join(labels, F.col("src_id") == F.col("node_id")).select("label", "edge_id", "dst_id")


@query(f"WITH {_NATIONS} SELECT id, n_name || chr(10) || '\"' || r_name AS plain, id % 2 = 0 AS yes FROM n")
def response_flags(spark, sf_dir):
    """Escapes in a model's text as what they stand for, and whether it says yes."""
    n = _nations(spark, sf_dir)
    return n.select("id", T.unescape(F.concat("n_name", F.lit('\\n\\"'), "r_name")).alias("plain"), T.says_yes_no(F.when(F.col("id") % 2 == 0, "Oh YES, not no").otherwise("No!")).alias("yes"))


@query(f"WITH {_NATIONS} SELECT id, n_name AS vector, r_name AS kg, n_name || chr(10) || 'Knowledge Triples:' || chr(10) || r_name AS hybrid FROM n")
def context_modes(spark, sf_dir):
    return _nations(spark, sf_dir).select("id", *[V.assemble_context(F.col("n_name"), F.col("r_name"), m).alias(m) for m in ("vector", "kg", "hybrid")])


_PRECISION = f"CASE WHEN {R.overlap_sql('pt', 'gt')} = 0 THEN 0.0 ELSE {R.overlap_sql('pt', 'gt')}::DOUBLE / len({{}}) END"
_GUARD = "(len(pt) = 1 AND pt[1] IN ('yes', 'no', 'noanswer') OR len(gt) = 1 AND gt[1] IN ('yes', 'no', 'noanswer')) AND pt <> gt"


@query(f"""WITH {R.TURNS_SQL}, worded AS (SELECT 'run_' || turn % 4 || '.json' AS file, CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE 'type ' || conv_id % 3 END AS qtype, {R.tokens_sql('pred')} AS pt, {R.tokens_sql('ref')} AS gt FROM turns WHERE conv_id % 7 <> 0),
s AS (SELECT file, qtype, (pt = gt)::INT::DOUBLE AS em, CASE WHEN {_GUARD} THEN 0.0 ELSE {_PRECISION.format('pt')} END AS precision, CASE WHEN {_GUARD} THEN 0.0 ELSE {_PRECISION.format('gt')} END AS recall FROM worded),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s)
SELECT coalesce(file, 'all') AS file, coalesce(qtype, 'joint') AS qtype, count(*) AS n, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('em', 'f1', 'precision', 'recall'))} FROM f GROUP BY GROUPING SETS ((file, qtype), (file), ())""")
def evaluated_files(spark, sf_dir):
    """Every prediction file of a folder by question type, by file and all together, in one job."""
    path, t = new_path(spark), R.turns(spark, sf_dir).filter("conv_id % 7 <> 0")
    for part in range(4):
        tables.write_json(t.filter(F.col("turn") % 4 == part).select("id", F.col("pred").alias("answers")), f"{path}/run_{part}.json")
    said = tables.with_file(tables.read_json(spark, f"{path}/*.json", "id string, answers string"), folder=True).withColumnRenamed("answers", "answer")
    gold = R.turns(spark, sf_dir).select("id", F.col("ref").alias("answer"), F.when(F.col("turn") % 3 != 0, F.concat(F.lit("type "), F.col("conv_id") % 3)).alias("qtype"))
    found = E.evaluate_files(said, gold)
    return found.select("file", "qtype", "n", *[F.round(m, 6).alias(m) for m in ("em", "f1", "precision", "recall")])


@query(f"WITH {_NATIONS} SELECT id::VARCHAR AS id, n_name AS question FROM n")
def dataset_rows(spark, sf_dir):
    """Rows of a data set by its name, with the field that holds its questions."""
    path = new_path(spark)
    tables.write_json(_nations(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.col("n_name").alias("Question")), path)
    rows, field = tables.dataset(spark, "predictions", path)
    return rows.select("id", F.col(field).alias("question"))


@query("SELECT c_custkey::BIGINT AS id, round(CASE WHEN c_custkey % 5 > 2 THEN exp(1 - (c_custkey % 5) / 2.0) ELSE 1 END, 6)::DOUBLE AS gamma FROM customer")
def length_discounts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.round(T.length_discount(F.col("c_custkey") % 5, F.lit(2)), 6).alias("gamma"))


@query("""SELECT d.doc_id, l.doc_id AS label_id, d.pos FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS pos FROM documents) d
JOIN (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS pos FROM labels) l USING (pos)""")
def zip_predictions(spark, sf_dir):
    """Two tables side by side, by place."""
    docs = O.position(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return O.zip_by_position(docs, O.position(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id")), ["label_id"]))
