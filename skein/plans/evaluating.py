"""Queries that normalise, score, classify and parse."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import similarity as S
from ..sources.tables import table
from . import registry as R
from .registry import query


@query(f"""SELECT 'document' AS kind, doc_id::VARCHAR AS id, {R.norm_sql('text')} AS norm, len({R.tokens_sql('text')})::INT AS n_tokens FROM documents
UNION ALL SELECT 'part', p_partkey::VARCHAR, {R.norm_sql('p_name')}, len({R.tokens_sql('p_name')})::INT FROM part""")
def normalize_answer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    parts = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("text"))
    return docs.union(parts).select("kind", "id", T.normalize_answer("text").alias("norm"), F.size(T.tokens("text")).alias("n_tokens"))


_PAIRS = f"WITH {R.TURNS_SQL}, worded AS (SELECT id, {R.tokens_sql('pred')} AS pt, {R.tokens_sql('ref')} AS gt FROM turns)"


@query(f"{_PAIRS} SELECT id, {R.overlap_sql('pt', 'gt')}::INT AS common, round({R.answer_f1_sql('pt', 'gt')}, 6) AS f1, (array_to_string(pt, ' ') = array_to_string(gt, ' '))::INT::DOUBLE AS em FROM worded")
def token_f1_pairs(spark, sf_dir):
    p, g = T.tokens("pred"), T.tokens("ref")
    return R.turns(spark, sf_dir).select("id", T.overlap(p, g).alias("common"), F.round(T.answer_f1(g, p), 6).alias("f1"), T.exact_match("pred", "ref").alias("em"))


_MULTIHOP = """, guarded AS (
  SELECT *, CASE WHEN (np IN ('yes', 'no', 'noanswer') OR ng IN ('yes', 'no', 'noanswer')) AND np <> ng THEN 0 ELSE raw END AS common
  FROM (SELECT *, array_to_string(pt, ' ') AS np, array_to_string(gt, ' ') AS ng, {overlap} AS raw FROM worded)
), multihop AS (
  SELECT *, (np = ng)::INT::DOUBLE AS em, CASE WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (len(pt) + len(gt)) END AS f1,
    CASE WHEN common = 0 THEN 0.0 ELSE common::DOUBLE / len(pt) END AS precision, CASE WHEN common = 0 THEN 0.0 ELSE common::DOUBLE / len(gt) END AS recall FROM guarded
)""".format(overlap=R.overlap_sql("pt", "gt"))


@query(f"WITH {R.ANSWERED_SQL}, worded AS (SELECT id, {R.tokens_sql('p_answer')} AS pt, {R.tokens_sql('answer')} AS gt FROM answered){_MULTIHOP} SELECT id, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM multihop")
def multihop_f1_pairs(spark, sf_dir):
    s = R.answered(spark, sf_dir).select("id", T.multihop_scores("p_answer", "answer").alias("s"))
    return s.select("id", *[F.round(f"s.{m}", 6).alias(m) for m in ("f1", "precision", "recall")])


@query(f"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p, string_split(text, chr(10))[2:] AS g FROM documents) SELECT doc_id, round({R.condition_f1_sql('p', 'g')}, 6) AS f1, len(list_intersect(list_distinct(p), list_distinct(g)))::INT AS common FROM l")
def condition_f1(spark, sf_dir):
    lines = F.split("text", "\n")
    p, g = lines, F.slice(lines, F.lit(2), F.size(lines))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.condition_f1(p, g), 6).alias("f1"), F.size(F.array_intersect(p, g)).alias("common"))


_BUCKET = "CASE WHEN turn < 2 THEN 'first' WHEN turn < 4 THEN 'second' ELSE 'later' END"


@query(f"""{_PAIRS.replace('SELECT id,', f'SELECT id, {_BUCKET} AS qtype,')}{_MULTIHOP}
SELECT coalesce(qtype, 'joint') AS qtype, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM multihop GROUP BY ROLLUP (qtype)""")
def eval_by_type_rollup(spark, sf_dir):
    pairs = R.turns(spark, sf_dir).select(F.expr(_BUCKET).alias("qtype"), T.exact_match("pred", "ref").alias("em"), T.multihop_scores("pred", "ref").alias("s")).select("qtype", "em", "s.*")
    metrics = ["em", "f1", "precision", "recall"]
    return E.rollup_means(pairs, "qtype", metrics).select("qtype", "n", *[F.round(m, 6).alias(m) for m in metrics])


_SLICES = {"total": "true", "yesno": "yesno", "extractive": "NOT yesno", "conditional": "conditional"}


@query(f"WITH {R.SCORED_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS slice, count(*) FILTER ({on}) AS n, " + ", ".join(f"round(coalesce(avg({m}) FILTER ({on}), 0.0), 6) AS {m}" for m in E.METRICS) + " FROM scored" for n, on in _SLICES.items()))
def eval_overlapping_slices(spark, sf_dir):
    found = E.slice_means(R.scored(spark, sf_dir), {n: F.expr(on) for n, on in _SLICES.items()}, list(E.METRICS))
    return found.select("slice", "n", *[F.round(m, 6).alias(m) for m in E.METRICS])


@query("""SELECT 'skip' AS missing, count(*) AS n, round(avg(quality), 6) AS mean FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'zero', count(*), round(avg(coalesce(quality, 0)), 6) FROM documents LEFT JOIN labels USING (doc_id)""")
def eval_missing_zero(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    parts = [E.match(docs.select("doc_id"), labels.select("doc_id", "quality"), "doc_id", m).agg(F.lit(m).alias("missing"), F.count("*").alias("n"), F.round(F.avg(F.coalesce("quality", F.lit(0))), 6).alias("mean")) for m in ("skip", "zero")]
    return parts[0].union(parts[1])


_QTYPE = "CASE WHEN yesno THEN 'yes/no' ELSE 'span' END || CASE WHEN conditional THEN '_conditional' ELSE '' END"
_WEIGHTED = {"all": "true", **{f"{q}{c}": f"qtype = '{q}{c}'" for q in ("yes/no", "span") for c in ("", "_conditional")}, "yesno": "yesno", "extractive": "NOT yesno", "conditional": "conditional", "plain": "NOT conditional", "matched": "em = 1.0", "unmatched": "em = 0.0", "no_overlap": "f1 = 0.0"}
_WEIGHTED_METRICS = (*E.METRICS, "cond", "score")


@query(f"""WITH {R.SCORED_SQL}, typed AS (SELECT *, {_QTYPE} AS qtype FROM scored), w AS (
  SELECT *, CASE WHEN conditional THEN 0.8 * f1 + 0.2 * cond ELSE f1 END AS score FROM typed) """ + " UNION ALL ".join(f"SELECT '{n}' AS slice, count(*) FILTER ({on}) AS n, " + ", ".join(f"round(coalesce(avg({m}) FILTER ({on}), 0.0), 6) AS {m}" for m in _WEIGHTED_METRICS) + " FROM w" for n, on in _WEIGHTED.items()))
def weighted_report(spark, sf_dir):
    rows = R.scored(spark, sf_dir).withColumn("qtype", F.expr(_QTYPE))
    rows = rows.withColumn("score", E.weighted_score(F.col("qtype"), F.col("f1"), F.col("f1"), F.col("cond")))
    found = E.slice_means(rows, {n: F.expr(on) for n, on in _WEIGHTED.items()}, list(_WEIGHTED_METRICS))
    return found.select("slice", "n", *[F.round(m, 6).alias(m) for m in _WEIGHTED_METRICS])


def _lists(spark, sf_dir):
    """Predictions and answers: every line is one, what follows a comma in it are its conditions."""
    make = lambda c: F.transform(F.split(c, "\n"), lambda x: F.struct(F.element_at(F.split(x, ", "), 1).alias("answer"), F.slice(F.split(x, ", "), 2, 1 << 20).alias("conditions")))
    return R.turns(spark, sf_dir).select("id", make("pred").alias("predictions"), make("ref").alias("answers"))


_CELLS = f"""{R.TURNS_SQL}, l AS (SELECT id, string_split(pred, chr(10)) AS p, string_split(ref, chr(10)) AS r FROM turns),
sizes AS (SELECT id, len(p) AS preds, greatest(len(p), len(r)) AS np, len(r) AS nr FROM l),
pl AS (SELECT id, i, {R.tokens_sql("string_split(x, ', ')[1]")} AS t, string_split(x, ', ')[2:] AS c FROM (SELECT id, unnest(range(1, greatest(len(p), len(r)) + 1)) AS i, coalesce(p[i], '') AS x FROM l)),
rl AS (SELECT id, j, {R.tokens_sql("string_split(x, ', ')[1]")} AS t, string_split(x, ', ')[2:] AS c FROM (SELECT id, unnest(range(1, len(r) + 1)) AS j, r[j] AS x FROM l)),
base AS (SELECT pl.id, i, j, (pl.t = rl.t)::INT::DOUBLE AS em, {R.answer_f1_sql('pl.t', 'rl.t')} AS f1, {R.condition_f1_sql('pl.c', 'rl.c')} AS cond FROM pl JOIN rl USING (id))"""


@query(f"WITH {_CELLS} SELECT id, round(max(f1), 6) AS best FROM base JOIN sizes USING (id) WHERE i <= preds GROUP BY id")
def best_pair_max(spark, sf_dir):
    best = E.best_pair(F.col("predictions"), F.col("answers"), lambda p, r: T.answer_f1(T.tokens(r["answer"]), T.tokens(p["answer"])))
    return _lists(spark, sf_dir).select("id", F.round(best, 6).alias("best"))


@query(f"""WITH RECURSIVE {_CELLS}, cell AS (
  UNPIVOT (SELECT id, i, j, em, em * cond AS conditional_em, f1, f1 * cond AS conditional_f1 FROM base) ON em, conditional_em, f1, conditional_f1 INTO NAME metric VALUE s
), choice AS (SELECT id, i, j, metric, s FROM cell UNION ALL SELECT DISTINCT id, i, 0, metric, 0.0 FROM cell),
assigned AS (
  SELECT DISTINCT id, metric, 0 AS i, 0 AS mask, 0.0::DOUBLE AS s FROM cell
  UNION ALL SELECT id, metric, i, mask, max(s) FROM (
    SELECT a.id, a.metric, c.i::INT AS i, CASE WHEN j = 0 THEN a.mask ELSE a.mask | (1 << (j - 1)::INT) END AS mask, a.s + c.s AS s
    FROM assigned a JOIN choice c ON a.id = c.id AND a.metric = c.metric AND c.i = a.i + 1 WHERE j = 0 OR a.mask & (1 << (j - 1)::INT) = 0
  ) GROUP BY id, metric, i, mask
)
PIVOT (SELECT id, metric, round(s / nr * exp(1 - greatest(preds, nr) / nr), 6) AS s FROM assigned JOIN sizes USING (id) WHERE i = np AND mask = (1 << nr::INT) - 1) ON metric IN ('em', 'conditional_em', 'f1', 'conditional_f1') USING max(s)""")
def assignment_metric(spark, sf_dir):
    return E.assignment_metric(_lists(spark, sf_dir)).select("id", *[F.round(m, 6).alias(m) for m in E.METRICS])


@query(f"""WITH {_CELLS} SELECT id, {', '.join(f'round(max({x}) * CASE WHEN any_value(preds) > 1 THEN exp(1 - any_value(preds)) ELSE 1 END, 6) AS {m}' for m, x in (('em', 'em'), ('conditional_em', 'em * cond'), ('f1', 'f1'), ('conditional_f1', 'f1 * cond')))}
FROM base JOIN sizes USING (id) WHERE j = 1 AND i <= preds GROUP BY id""")
def one_reference(spark, sf_dir):
    """The best of all predictions against the first answer, discounted by their number."""
    found = _lists(spark, sf_dir).select("id", E.one_reference_metric(F.col("predictions"), F.col("answers")[0]).alias("m"))
    return found.select("id", *[F.round(f"m.{m}", 6).alias(m) for m in E.METRICS])


def _word_vectors(texts: list[str]) -> list[np.ndarray]:
    """The digits of each word's hash, less their mean: what stands in for a model's vectors."""
    return [np.array([[int(x, 16) - 7.5 for x in hashlib.md5(w.encode()).hexdigest()[:16]] for w in t.split(" ") if w]).reshape(-1, 16) for t in texts]


def _vectors_sql(words: str) -> str:
    return f"list_transform({words}, lambda w: list_transform(range(1, 17), lambda k: ('0x' || md5(w)[k])::INT - 7.5))"


def _greedy_sql(p: str, r: str) -> str:
    """(precision, recall) of greedy matching of two lists of vectors, as a struct."""
    best = lambda a, b: f"list_avg(list_transform({a}, lambda x: list_max(list_transform({b}, lambda y: list_cosine_similarity(x, y)))))"
    return f"CASE WHEN len({p}) = 0 OR len({r}) = 0 THEN {{'p': (len({p}) = len({r}))::INT::DOUBLE, 'r': (len({p}) = len({r}))::INT::DOUBLE}} ELSE {{'p': {best(p, r)}, 'r': {best(r, p)}}} END"


_F1 = "CASE WHEN {0}.p + {0}.r > 0 THEN 2 * {0}.p * {0}.r / ({0}.p + {0}.r) ELSE 0 END"


@query(f"""WITH {R.TURNS_SQL}, v AS (SELECT id, {_vectors_sql(R.tokens_sql('pred'))} AS p, {_vectors_sql(R.tokens_sql('ref'))} AS r FROM turns), g AS (SELECT id, {_greedy_sql('p', 'r')} AS s FROM v)
SELECT id, round(s.p, 6) AS precision, round(s.r, 6) AS recall, round({_F1.format('s')}, 6) AS f1 FROM g""")
def answer_similarity(spark, sf_dir):
    """Replies against what they reply to, by the vectors of their words."""
    found = S.token_similarity(R.turns(spark, sf_dir).select("id", "pred", "ref"), "pred", "ref", _word_vectors)
    return found.select("id", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")])


@query(f"""WITH {R.TURNS_SQL}, l AS (SELECT id, string_split(pred, chr(10)) AS p, string_split(ref, chr(10)) AS r FROM turns),
pl AS (SELECT id, {_vectors_sql(R.tokens_sql("string_split(x, ', ')[1]"))} AS t, len(string_split(x, ', ')) > 1 AS some, {_vectors_sql(R.tokens_sql("array_to_string(string_split(x, ', ')[2:], ' ')"))} AS c FROM (SELECT id, unnest(p) AS x FROM l)),
rl AS (SELECT id, {_vectors_sql(R.tokens_sql("string_split(x, ', ')[1]"))} AS t, len(string_split(x, ', ')) > 1 AS some, {_vectors_sql(R.tokens_sql("array_to_string(string_split(x, ', ')[2:], ' ')"))} AS c FROM (SELECT id, unnest(r) AS x FROM l)),
g AS (SELECT id, {_greedy_sql('pl.t', 'rl.t')} AS a, {_greedy_sql('pl.c', 'rl.c')} AS b, rl.some AS due, pl.some AS given FROM pl JOIN rl USING (id)),
f AS (SELECT id, due, {_F1.format('a')} AS a, CASE WHEN due AND given THEN {_F1.format('b')} ELSE 0 END AS b FROM g)
SELECT id, round(greatest(max(a), 0), 6) AS similarity, round(greatest(max(CASE WHEN due THEN (a + b) / 2 END), 0), 6) AS with_conditions, round(greatest(max(b), 0), 6) AS conditions_only FROM f GROUP BY id""")
def similarity_maxima(spark, sf_dir):
    """Three maxima over all pairs of lines, each by itself."""
    found = S.similarity_maxima(_lists(spark, sf_dir), _word_vectors)
    return found.select("id", *[F.round(m, 6).alias(m) for m in S.MAXIMA])


@query(f"""WITH {R.ANSWERED_SQL} SELECT id,
  CASE WHEN answer IN ('yes', 'no') AND len(conditions) > 0 THEN 'yes/no_conditional' WHEN answer IN ('yes', 'no') THEN 'yes/no' WHEN len(conditions) > 0 THEN 'span_conditional' ELSE 'span' END AS any_answer,
  CASE WHEN p_answer IN ('yes', 'no') AND len(p_conditions) > 0 THEN 'yes/no_conditional' WHEN p_answer IN ('yes', 'no') THEN 'yes/no' WHEN len(p_conditions) > 0 THEN 'span_conditional' ELSE 'span' END AS first_answer,
  CASE WHEN answer IN ('yes', 'no') THEN 'yes_no' ELSE 'span' END AS gold FROM answered""")
def classify_question_type(spark, sf_dir):
    one = lambda a, c: F.array(F.struct(F.col(a).alias("answer"), F.col(c).alias("conditions")))
    return R.answered(spark, sf_dir).select("id", T.question_type(one("answer", "conditions")).alias("any_answer"), T.first_answer_type(one("p_answer", "p_conditions")).alias("first_answer"), F.when(F.col("answer").isin("yes", "no"), "yes_no").otherwise("span").alias("gold"))


_MADE = "CASE WHEN doc_id % 4 = 0 THEN 'Answer: Yes it is' WHEN doc_id % 4 = 1 THEN 'Answer: ' || source || chr(10) || 'Conditions: if ' || lang || chr(10) || 'n ' || doc_id WHEN doc_id % 4 = 2 THEN lang || ' alone' ELSE 'Answer: no.' END"
_TYPES = "CASE WHEN doc_id % 3 = 0 THEN 'yes/no' WHEN doc_id % 3 = 1 THEN 'span_conditional' ELSE 'span' END"


@query(f"""WITH m AS (SELECT doc_id, {_MADE} AS s, {_TYPES} AS q FROM documents), a AS (SELECT *, CASE WHEN s LIKE 'Answer: %' THEN trim(s[9:]) ELSE s END AS whole, s LIKE '%Conditions: %' AS marked FROM m)
SELECT doc_id, CASE WHEN q = 'yes/no' AND list_contains(string_split(lower(whole), ' '), 'yes') THEN 'yes' WHEN q = 'yes/no' AND list_contains(string_split(lower(whole), ' '), 'no') THEN 'no' WHEN q IN ('yes/no', 'span') THEN whole WHEN marked THEN trim(string_split(string_split(s, 'Conditions:')[1], 'Answer:')[2], ' ' || chr(10)) ELSE s END AS answer,
  CASE WHEN q = 'span_conditional' AND marked THEN array_to_string(string_split(trim(string_split(s, 'Conditions: ')[2]), chr(10)), '|') ELSE '' END AS conditions FROM a""")
def parse_prediction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_MADE).alias("s"), F.expr(_TYPES).alias("q"))
    found = docs.select("doc_id", T.parse_prediction("s", "q").alias("p"))
    return found.select("doc_id", F.regexp_replace("p.answer", r"^\s+|\s+$", "").alias("answer"), F.array_join("p.conditions", "|").alias("conditions"))


@query("""WITH m AS (SELECT doc_id, doc_id % 2 = 0 AS yn, '# Answer: ' || CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE source END AS a, 'n ' || doc_id AS c FROM documents)
SELECT doc_id, CASE WHEN yn AND a[11:] <> 'yes' THEN 'yes|no' ELSE a[11:] END AS answers, c AS conditions FROM m""")
def parse_code_answer(spark, sf_dir):
    made = F.concat(F.lit("# Answer: "), F.when(F.col("doc_id") % 3 == 0, "yes").otherwise(F.col("source")), F.lit("\n\t if: n "), F.col("doc_id").cast("string"), F.lit("\ndone"))
    found = table(spark, sf_dir, "documents").select("doc_id", T.parse_code_answer(made, F.col("doc_id") % 2 == 0).alias("a"))
    return found.select("doc_id", F.array_join(F.transform("a", lambda x: x["answer"]), "|").alias("answers"), F.array_join(F.col("a")[0]["conditions"], "|").alias("conditions"))


_SCORED_TEXT = "'1. (order ' || o_orderkey || ', has, ' || o_orderpriority || ') (Score: ' || (o_orderkey % 10 + 1) || ') and **(a b, c, d' || o_custkey || ')** (Score: 9) (x, y) (Score: 10)'"


@query(f"""WITH s AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderkey % 10 + 1 AS score FROM orders)
SELECT o_orderkey AS id, 'order ' || o_orderkey AS head, 'has' AS rel, o_orderpriority AS tail, score::INT AS score FROM s WHERE score >= 8 UNION ALL SELECT o_orderkey, 'a b', 'c', 'd' || o_custkey, 9 FROM s""")
def parse_scored_triples(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_SCORED_TEXT).alias("s"))
    return made.select("id", F.inline(T.parse_scored_triples("s")))


@query("""SELECT p_partkey AS id, unnest([p_type, 'HAS_BRAND']) AS relation, unnest([0.25 + (p_size % 4) / 8.0, 0.5]) AS score, unnest([p_size % 2 = 0, true]) AS is_head FROM part""")
def parse_scored_relations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    made = F.concat(F.lit("1. {"), F.col("p_type"), F.lit(" (Score: "), (0.25 + (F.col("p_size") % 4) / 8.0).cast("string"), F.lit(")}; {HAS_BRAND (Score: 0.5)}"))
    heads = F.when(F.col("p_size") % 2 == 0, F.array("p_type", F.lit("HAS_BRAND"))).otherwise(F.array(F.lit("HAS_BRAND")))
    return part.select(F.col("p_partkey").alias("id"), F.inline(T.parse_scored_relations(made, heads)))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN [0.4, 0.6] ELSE [0.5, 0.5] END[1] AS first, 2 AS n FROM part")
def parse_scores(spark, sf_dir):
    made = F.when(F.col("p_size") % 2 == 0, F.lit("Score: 0.4, 0.6")).otherwise(F.lit("0.3, 0.3 and 0.4"))
    scores = T.parse_scores(made, F.lit(2))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scores[0].alias("first"), F.size(scores).alias("n"))


@query("SELECT p_partkey AS id, p_name || '|' || p_brand AS found, p_size % 2 = 0 AS enough FROM part")
def brace_entities(spark, sf_dir):
    made = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("{ Y es}")).otherwise(F.lit("{No}")), F.lit(" need { "), F.col("p_name"), F.lit(" } or {"), F.col("p_brand"), F.lit("} {}"))
    found = F.filter(T.braces(made), lambda x: x != "Y es")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(found, "|").alias("found"), T.is_yes(T.first_brace(made)).alias("enough"))


@query("""SELECT p_partkey AS id, upper(p_name[1]) || lower(p_name[2:]) AS head, 'Has brand' AS rel, upper(p_brand[1]) || lower(p_brand[2:]) AS tail FROM part""")
def parse_triplets(spark, sf_dir):
    made = F.concat(F.lit("1. ("), F.col("p_name"), F.lit(", Has Brand!, "), F.col("p_brand"), F.lit(")\n(a, b, c, d)\n(, x, y)\nno triple"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.inline(T.parse_triplets(made)))


@query("SELECT n_nationkey AS id, 'is in ' || n_name AS predicate FROM nation")
def clean_predicate(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), T.clean_predicate(F.concat(F.lit("'is  WHEREin* ["), F.col("n_name"), F.lit("]?'"))).alias("predicate"))


@query("SELECT doc_id AS id, lang AS keyword FROM documents UNION SELECT doc_id, source FROM documents")
def parse_keywords(spark, sf_dir):
    made = F.concat(F.lit("KEYWORDS: "), F.col("lang"), F.lit(", "), F.col("source"), F.lit(" ,"), F.col("lang"), F.lit("\nmore"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(T.keywords(made)).alias("keyword")).distinct()


@query("SELECT p_partkey AS id, p_name AS head, 'has type' AS rel, lower(p_type) AS tail FROM part UNION ALL SELECT p_partkey, p_name, 'sold as', lower(p_brand) FROM part")
def linear_triples(spark, sf_dir):
    made = F.concat(F.lit("<s><triplet> "), F.col("p_name"), F.lit(" <subj> "), F.lower("p_type"), F.lit(" <obj> has type <subj> "), F.lower("p_brand"), F.lit(" <obj> sold as</s>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.inline(T.linear_triples(made)))


@query("SELECT event_type, round(sum(value), 2) AS sum_value, max(value) AS max_value, min(value) AS min_value, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def usage_summary(spark, sf_dir):
    found = E.usage_summary(table(spark, sf_dir, "events"), "event_type", ["value"])
    return found.select("event_type", F.round("sum_value", 2).alias("sum_value"), "max_value", "min_value", F.round("mean_value", 6).alias("mean_value"))


@query(f"WITH {R.SCORED_SQL} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, round(avg({m}), 6) AS mean_score FROM scored" for m in E.METRICS))
def metric_means(spark, sf_dir):
    found = E.metric_means(R.scored(spark, sf_dir).select(*E.METRICS), list(E.METRICS))
    return found.select("metric", "n", F.round("mean_score", 6).alias("mean_score"))


@query("SELECT conv_id, string_agg('Question: ' || u || chr(10) || 'Answer: ' || a, chr(10) || chr(10) ORDER BY turn) AS block FROM (SELECT u.conv_id, u.turn, u.text AS u, a.text AS a FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') GROUP BY conv_id")
def render_fewshot(spark, sf_dir):
    t = R.turns(spark, sf_dir).select("conv_id", "turn", F.col("ref").alias("q"), F.col("pred").alias("a"))
    return M.few_shots(t, "conv_id", "turn", "q", "a")


@query(f"""WITH {R.ANSWERED_SQL} SELECT id, 'Context:' || chr(10) || 'c' || conv_id || chr(10) || chr(10) || 'Question: ' || answer || chr(10) || CASE WHEN answer IN ('yes', 'no') AND len(conditions) > 0 THEN 'Reply `Answer: yes` or `Answer: no`, then `Conditions:` and one condition a line.' WHEN answer IN ('yes', 'no') THEN 'Reply `Answer: yes` or `Answer: no`.' WHEN len(conditions) > 0 THEN 'Reply `Answer:` and a phrase, then `Conditions:` and one condition a line.' ELSE 'Reply `Answer:` and the shortest phrase that answers.' END AS prompt FROM answered""")
def answer_prompts(spark, sf_dir):
    one = F.array(F.struct(F.col("answer"), F.col("conditions")))
    return R.answered(spark, sf_dir).select("id", M.answer_prompt(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("answer"), T.question_type(one)).alias("prompt"))
