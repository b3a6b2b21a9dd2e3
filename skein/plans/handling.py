"""Queries that ingest, sample, resume, batch and render."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models as M
from ..operators import relational as O
from ..operators import sampling as S
from ..sources import html as H
from ..sources import tables
from ..sources.shared import new_path
from ..sources.tables import table
from ..streaming.incremental import append_new
from . import registry as R
from . import searching
from .registry import query


@query()
def html_sections(spark, sf_dir):
    return H.sections(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def html_sections_sibling(spark, sf_dir):
    return H.sections(table(spark, sf_dir, "pages"), "page_id", "html", mode="sibling", tags=("h1",))


@query("SELECT page_id, regexp_replace(html, '</?a(\\s[^>]*)?>', '', 'gi') AS html FROM pages")
def unwrap_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.unwrap_links(F.col("html")).alias("html"))


_HEADER = "length(line) < 40"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_LINES = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
s AS (SELECT doc_id, pos, line, sum(CASE WHEN {_HEADER} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_id FROM l)"""


@query(f"WITH {_LINES} SELECT doc_id, pos::INT AS pos, section_id::BIGINT AS section_id, length(line)::INT AS width FROM s")
def doc_sections(spark, sf_dir):
    return O.line_sections(_lines(spark, sf_dir), "doc_id", "pos", F.expr(_HEADER)).select("doc_id", "pos", "section_id", F.length("line").alias("width"))


@query(f"""WITH {_LINES}, ev AS (SELECT DISTINCT doc_id, line FROM s WHERE pos % 5 = 4)
SELECT doc_id, pos::INT AS pos, section_id::BIGINT AS section_id FROM s WHERE section_id = 0 OR (doc_id, section_id) IN (SELECT s2.doc_id, s2.section_id FROM s s2 JOIN ev USING (doc_id, line))""")
def oracle_sections(spark, sf_dir):
    lines = O.line_sections(_lines(spark, sf_dir), "doc_id", "pos", F.expr(_HEADER))
    return O.evidence_sections(lines, lines.filter("pos % 5 = 4"), "doc_id").select("doc_id", "pos", "section_id")


_ORDER = "md5('1:' || doc_id), doc_id"


@query(f"""WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER}) AS n, count(*) OVER (PARTITION BY lang) AS size, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang FROM n WHERE n <= floor(501.0::DOUBLE * (size::DOUBLE / total))""")
def stratified_sample(spark, sf_dir):
    return S.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 501, "doc_id")


@query(f"SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY {_ORDER} LIMIT 4")
def fewshot_sample(spark, sf_dir):
    return S.random_sample(table(spark, sf_dir, "documents").select("doc_id", "lang").filter("lang = 'en'"), 4, "doc_id")


@query(f"""SELECT doc_id, label, row_number() OVER (ORDER BY md5('2:' || doc_id), doc_id)::INT AS place FROM (
  SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS label, row_number() OVER (PARTITION BY quality ORDER BY {_ORDER}) AS n FROM labels) WHERE n <= 10""")
def balanced_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"))
    return S.balanced(rows, "label", 20, "doc_id")


@query(f"SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source) AS size, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) AS n FROM documents) WHERE size < 20 OR n <= 5")
def conditional_sample(spark, sf_dir):
    return S.retain(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf_dir):
    return O.unprocessed(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def retry_semi(spark, sf_dir):
    return O.only(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def demo_semi(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    ids = labels.filter("quality = 0").select("doc_id").union(labels.filter("toxic = 1").select("doc_id"))
    return O.only(table(spark, sf_dir, "documents").select("doc_id", "lang"), ids, "doc_id")


@query("SELECT doc_id, md5(text) AS text_md5, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch_id FROM documents")
def batch_ids(spark, sf_dir):
    return O.batches(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], 20).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "batch_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INT AS pos FROM documents QUALIFY pos BETWEEN 10 AND 29")
def slice_rows(spark, sf_dir):
    return O.slice_rows(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 10, 30)


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_entry(spark, sf_dir):
    return O.last_by_key(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"])


@query(f"WITH {searching._NEAR} SELECT query_id, string_agg('Filename: ' || doc_id || chr(10) || 'Content: ' || text, chr(10) ORDER BY rank) AS context FROM near JOIN documents ON doc_id = vec_id GROUP BY query_id")
def render_context(spark, sf_dir):
    """The whole texts of the five documents nearest to each query, nearest first."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    line = F.concat(F.lit("Filename: "), F.col("vec_id").cast("string"), F.lit("\nContent: "), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("x"))))
    return searching._near(spark, sf_dir).join(docs, "vec_id").groupBy("query_id").agg(F.array_join(F.transform(listed, lambda s: s["x"]), "\n").alias("context"))


@query("SELECT doc_id, 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || chr(10) || text AS node FROM documents")
def render_metadata(spark, sf_dir):
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", H.render_metadata(meta, F.col("text"), ["n_chars"]).alias("node"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def chat_history(spark, sf_dir):
    return tables.history(table(spark, sf_dir, "conversations"), "conv_id")


@query("SELECT event_id, 'k' AS name, (props->>'k')::BIGINT AS value FROM events")
def unpivot_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return O.unpivot_map(rows, F.col("m"), "name", "value").drop("m")


@query("SELECT event_id, event_type AS answer, 2::INT AS n_conditions, user_id::VARCHAR AS first_condition FROM events")
def json_answers(spark, sf_dir):
    made = F.concat(F.lit('[["'), F.col("event_type"), F.lit('", ["'), F.col("user_id").cast("string"), F.lit('", "x y"]]]'))
    found = table(spark, sf_dir, "events").select("event_id", tables.parse_answers(made)[0].alias("a"))
    return found.select("event_id", "a.answer", F.size("a.conditions").alias("n_conditions"), F.col("a.conditions")[0].alias("first_condition"))


@query(f"WITH {R.TURNS_SQL} SELECT id, 'u ' || ref || '. ' || pred AS question FROM turns")
def combined_question(spark, sf_dir):
    return R.turns(spark, sf_dir).select("id", F.concat(F.lit("u "), F.concat_ws(". ", "ref", "pred")).alias("question"))


def _echo(prompts):
    """A model that fails on some prompts and otherwise answers with the last word."""
    if prompts.str.contains("FAIL").any():
        raise ValueError("no answer")
    return prompts.str.split().str[-1]


@query("SELECT n_nationkey AS id, n_name AS response, NULL::VARCHAR AS error FROM nation")
def model_completion(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    return M.complete(rows, F.concat(F.lit("Where is "), F.col("n_name")), _echo).select("id", "response", "error")


@query("SELECT doc_id, lang AS topic FROM documents UNION ALL SELECT doc_id, source FROM documents")
def search_words(spark, sf_dir):
    made = F.concat(F.lit("The "), F.col("lang"), F.lit(" of "), F.col("source"), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.search_words(made)).alias("topic"))


@query("SELECT doc_id, lang, length(text)::INT AS n, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run FROM documents")
def incremental_append(spark, sf_dir):
    """Documents in two runs over a table: the second one finds what the first left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    path = new_path(spark)
    append_new(docs.filter("lang = 'en'"), path, "doc_id", lambda df: df.withColumn("run", F.lit(1)))
    return append_new(docs, path, "doc_id", lambda df: df.withColumn("run", F.lit(2)))


@query("""SELECT event_id, (props->>'k')::BIGINT + 1 AS k, length(event_type)::BIGINT AS size FROM events""")
def merged_properties(spark, sf_dir):
    """Properties of events with others laid over them."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"), F.length("event_type").cast("long").alias("n"))
    merged = O.merged_maps(F.col("m"), F.create_map(F.lit("k"), F.col("m")["k"] + 1, F.lit("size"), F.col("n")))
    return rows.select("event_id", merged["k"].alias("k"), merged["size"].alias("size"))


@query("""WITH n AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda p: string_split(p, chr(10)))) AS l FROM documents)
SELECT doc_id, len(l)::INT AS n, md5(array_to_string(l, '|')) AS lines_md5 FROM n""")
def flattened_sections(spark, sf_dir):
    """Sections that are lists of lines, as one list."""
    nested = F.transform(F.split("text", "\n\n"), lambda p: F.split(p, "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.flatten(nested).alias("l")).select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", "|").cast("binary")).alias("lines_md5"))
