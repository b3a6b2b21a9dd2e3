"""Queries over triples and vectors."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import models as M
from ..operators import paths as P
from ..operators import retrieval as V
from ..operators.sampling import cut_large
from ..sources.shared import written
from ..sources.tables import table
from . import registry as R
from .registry import query

_T = f"WITH {R.TRIPLES_SQL}"


@query(f"{_T} SELECT head, rel, tail FROM triples")
def triples_build(spark, sf_dir):
    return R.star_triples(spark, sf_dir)


@query(f"{_T} SELECT DISTINCT rel AS relation, true AS is_head FROM triples WHERE regexp_matches(head, '(?i)\\bnation_1\\b') UNION SELECT DISTINCT rel, false FROM triples WHERE regexp_matches(tail, '(?i)\\bnation_1\\b')")
def node_relations(spark, sf_dir):
    return G.entity_relations(R.star_triples(spark, sf_dir), r"(?i)\bnation_1\b")


def _side(side: str):
    def run(spark, sf_dir):
        return G.match_side(R.star_triples(spark, sf_dir), T.search_pattern(["widget", "asia", "brand#2", "in_"]), side)

    run.__name__ = f"kg_partial_{side}"
    return query(f"{_T} SELECT * FROM triples WHERE regexp_matches({side}, '(?i)(widget|asia|brand#2|in_)')")(run)


for _name in G.SIDES:
    _side(_name)


@query(f"{_T} SELECT * FROM triples WHERE regexp_matches(head, '(?i)bolt') OR regexp_matches(tail, '(?i)bolt') OR regexp_matches(rel, '(?i)bolt')")
def kg_clue(spark, sf_dir):
    return G.match_any(R.star_triples(spark, sf_dir), T.search_pattern(["bolt"]))


@query(f"{_T} SELECT * FROM triples WHERE lower(head) IN ('asia', 'red widget') OR lower(tail) IN ('asia', 'red widget')")
def kg_exact(spark, sf_dir):
    pattern = T.search_pattern(["asia", "red widget"], whole=True)
    return R.star_triples(spark, sf_dir).filter(F.col("head").rlike(pattern) | F.col("tail").rlike(pattern))


_WORDS = ("ring", "asia", "small", "urgent", "in nation")


def _hits(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in _WORDS], "word string")
    return G.word_hits(words, R.star_triples(spark, sf_dir))


_HITS = f"""{_T}, words AS (SELECT unnest({list(_WORDS)}) AS word), hits AS (
  SELECT word, head, rel, tail, 'head' AS side FROM triples, words WHERE contains(lower(replace(head, '_', ' ')), word) UNION ALL
  SELECT word, head, rel, tail, 'tail' FROM triples, words WHERE contains(lower(replace(tail, '_', ' ')), word) UNION ALL
  SELECT word, head, rel, tail, 'rel' FROM triples, words WHERE contains(lower(replace(rel, '_', ' ')), word))"""


@query(f"{_HITS} SELECT word, side, count(*) AS n, min(head) AS first_head, max(tail) AS last_tail FROM hits GROUP BY word, side")
def kg_word_search(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("word", "side").agg(F.count("*").alias("n"), F.min("head").alias("first_head"), F.max("tail").alias("last_tail"))


_H, _TL = "contains(lower(replace(head, '_', ' ')), word)", "contains(lower(replace(tail, '_', ' ')), word)"


@query(f"""{_HITS}, c AS (SELECT DISTINCT word, head, rel, tail, unnest(CASE WHEN {_H} THEN [tail] WHEN {_TL} THEN [head] ELSE [head, tail] END) AS candidate FROM hits)
SELECT word, candidate, count(*) AS n FROM c GROUP BY word, candidate""")
def next_candidates(spark, sf_dir):
    found = G.next_candidates(_hits(spark, sf_dir)).select("word", "head", "rel", "tail", "candidate").distinct()
    return found.groupBy("word", "candidate").agg(F.count("*").alias("n"))


_WANTED = [("asia", "IN_REGION", False), ("nation_3", "IN_NATION", False), ("NATION_3", "IN_REGION", True)]


@query(f"""{_T}, w AS (SELECT * FROM (VALUES ('asia', 'IN_REGION', false), ('nation_3', 'IN_NATION', false), ('NATION_3', 'IN_REGION', true)) v(entity, relation, is_head))
SELECT DISTINCT entity, relation, is_head, CASE WHEN is_head THEN tail ELSE head END AS candidate FROM w JOIN triples ON rel = relation AND lower(entity) = lower(CASE WHEN is_head THEN head ELSE tail END)""")
def kg_entity_search(spark, sf_dir):
    wanted = spark.createDataFrame(_WANTED, "entity string, relation string, is_head boolean")
    return G.entity_search(R.star_store(spark, sf_dir), wanted).select("entity", "relation", "is_head", "candidate")


@query("SELECT p_brand || '' AS label, coalesce(min(p_partkey)::VARCHAR, 'UnName_Entity') AS node_id FROM part GROUP BY p_brand UNION ALL SELECT 'nothing', 'UnName_Entity'")
def kg_label_lookup(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("label"))
    wanted = labels.select("label").distinct().union(spark.createDataFrame([("nothing",)], "label string"))
    return G.label_lookup(labels, wanted, default=G.UNNAMED).select("label", "node_id")


@query(f"""{_T}, w AS (SELECT DISTINCT trim(lower(head)) AS h, rel, trim(lower(tail)) AS t FROM triples WHERE rel = 'HAS_TYPE')
SELECT count(*) AS n FROM triples JOIN w ON trim(lower(head)) = h AND triples.rel = w.rel AND trim(lower(tail)) = t""")
def match_pruned(spark, sf_dir):
    graph = R.star_triples(spark, sf_dir)
    keys = lambda df: df.withColumns({f"_{s}": F.trim(F.lower(s)) if s != "rel" else F.col(s) for s in G.SIDES})
    pruned = keys(graph.filter("rel = 'HAS_TYPE'")).select(*[f"_{s}" for s in G.SIDES]).distinct()
    return keys(graph).join(pruned, [f"_{s}" for s in G.SIDES]).agg(F.count("*").alias("n"))


@query(f"""{_T}, e AS (SELECT head AS a, tail AS b FROM triples WHERE rel LIKE 'IN_%' OR rel = 'LOCATED_IN' UNION SELECT tail, head FROM triples WHERE rel LIKE 'IN_%' OR rel = 'LOCATED_IN'),
d0 AS (SELECT 'ASIA' AS node), d1 AS (SELECT DISTINCT b AS node FROM e JOIN d0 ON a = node WHERE b <> 'ASIA'),
d2 AS (SELECT DISTINCT b AS node FROM e JOIN d1 ON a = node WHERE b NOT IN (SELECT node FROM d0 UNION SELECT node FROM d1))
SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2""")
def khop(spark, sf_dir):
    graph = R.star_triples(spark, sf_dir).filter("rel LIKE 'IN_%' OR rel = 'LOCATED_IN'")
    return G.khop(graph, spark.createDataFrame([("ASIA",)], "node string"), 2)


def _stub(salt: str):
    """Scores in hundredths from a hash of question and text, some of them 0: what stands in for a model."""
    return lambda q, x: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), q, x).cast("binary")), 1, 4), 16, 10).cast("long") % 101).cast("double") / 100


def _stub_sql(salt: str, x: str) -> str:
    return f"((('0x' || substr(md5('{salt}:' || qid || ':' || {x}), 1, 4))::BIGINT % 101)::DOUBLE / 100)"


def _beam_sql(depth: int) -> str:
    """One depth of the beam: relations, prune, entities, draw, scores, cut."""
    k = depth
    previous = f"AND NOT EXISTS (SELECT 1 FROM b{k - 1} p WHERE p.qid = f.qid AND p.relation = e.relation AND p.is_head = e.is_head)" if k > 1 else ""
    return f"""
r{k} AS (SELECT DISTINCT f.qid, f.entity, e.relation, e.is_head FROM f{k} f JOIN ends e ON lower(f.entity) = e.k WHERE true {previous}),
s{k} AS (SELECT *, {_stub_sql('r', 'relation')} AS rs FROM r{k}),
p{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, entity ORDER BY rs DESC, relation, is_head) AS n FROM s{k}) WHERE n <= 3 AND rs <> 0),
c{k} AS (SELECT p.qid, p.entity, p.relation, p.is_head, e.candidate, rs, count(*) OVER (PARTITION BY p.qid, p.entity, p.relation, p.is_head) AS m, row_number() OVER (PARTITION BY p.qid, p.entity, p.relation, p.is_head ORDER BY md5(e.candidate), e.candidate) AS d FROM p{k} p JOIN ends e ON lower(p.entity) = e.k AND p.relation = e.relation AND p.is_head = e.is_head),
x{k} AS (SELECT *, {_stub_sql('e', 'candidate')} * rs AS score FROM c{k} WHERE m < 20 OR d <= 5),
b{k} AS (SELECT qid, {k} AS depth, entity, relation, is_head, candidate, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, candidate, entity, relation, is_head) AS n FROM x{k}) WHERE n <= 3 AND score <> 0),
f{k + 1} AS (SELECT DISTINCT qid, candidate AS entity FROM b{k})"""


_TOPICS = [("q1", "ASIA"), ("q2", "red widget"), ("q3", "NATION_4"), ("q3", "Supplier#000000001")]


BEAM_SQL = f"""{_T}, ends AS (SELECT DISTINCT lower(head) AS k, rel AS relation, true AS is_head, tail AS candidate FROM triples UNION SELECT DISTINCT lower(tail), rel, false, head FROM triples),
f1 AS (SELECT * FROM (VALUES {', '.join(str(t) for t in _TOPICS)}) v(qid, entity)),{_beam_sql(1)},{_beam_sql(2)},{_beam_sql(3)},
beam AS (SELECT qid, depth, entity, relation, is_head, candidate, round(score, 6) AS score FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3)),
lines AS (SELECT qid, depth, score, CASE WHEN is_head THEN entity ELSE candidate END AS head, relation AS rel, CASE WHEN is_head THEN candidate ELSE entity END AS tail FROM beam),
chains AS (SELECT qid, string_agg(head || ', ' || rel || ', ' || tail, ' --> ' ORDER BY depth, score DESC, head, rel, tail) AS chains FROM lines GROUP BY qid)"""


@query(f"{BEAM_SQL} SELECT * FROM beam")
def beam_search(spark, sf_dir):
    topics = spark.createDataFrame(_TOPICS, "qid string, entity string")
    return G.beam_search(R.star_store(spark, sf_dir), topics, _stub("r"), _stub("e")).withColumn("score", F.round("score", 6))


@query(f"{BEAM_SQL} SELECT * FROM chains")
def beam_chains(spark, sf_dir):
    return G.chains(beam_search(spark, sf_dir))


def _stopped(beam):
    """Questions whose best candidate ends with a 3."""
    return beam.filter(F.endswith("candidate", F.lit("3")))


_LAST_TOPICS = [*_TOPICS, ("q5", "nowhere"), ("q6", "order 1")]


def _states_sql(k: int) -> str:
    """Statuses of those who were going at a depth."""
    return f"""
z{k} AS (SELECT qid, CASE WHEN qid NOT IN (SELECT qid FROM c{k}) THEN 'exhausted' WHEN qid NOT IN (SELECT qid FROM b{k}) THEN 'pruned' WHEN qid IN (SELECT qid FROM b{k} WHERE ends_with(candidate, '3')) THEN 'answered' END AS status, {k} AS depth FROM g{k}),
g{k + 1} AS (SELECT qid FROM z{k} WHERE status IS NULL)"""


_HISTORY_SQL = f"""{_T}, ends AS (SELECT DISTINCT lower(head) AS k, rel AS relation, true AS is_head, tail AS candidate FROM triples UNION SELECT DISTINCT lower(tail), rel, false, head FROM triples),
f1 AS (SELECT * FROM (VALUES {', '.join(str(t) for t in _LAST_TOPICS)}) v(qid, entity)), g1 AS (SELECT DISTINCT qid FROM f1),""" + ",".join(
    _beam_sql(k).replace(f"FROM b{k})", f"FROM b{k} WHERE qid NOT IN (SELECT qid FROM b{k} WHERE ends_with(candidate, '3')))") + "," + _states_sql(k) for k in (1, 2, 3)
)


def _history(spark, sf_dir):
    topics = spark.createDataFrame(_LAST_TOPICS, "qid string, entity string")
    return G.beam_history(R.star_store(spark, sf_dir), topics, _stub("r"), _stub("e"), stop=_stopped)


@query(_HISTORY_SQL + " " + " UNION ALL ".join(f"SELECT qid, depth, entity, relation, is_head, candidate, round(score, 6) AS score FROM b{k} UNION ALL SELECT qid, {k}, entity, NULL, NULL, '{G.FINISH}', 0 FROM f{k} WHERE (qid, entity) NOT IN (SELECT qid, entity FROM c{k})" for k in (1, 2, 3)))
def beam_finish(spark, sf_dir):
    """A beam's rows with those of entities that lead nowhere."""
    return _history(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@query(_HISTORY_SQL + " " + " UNION ALL ".join([f"SELECT qid, status, depth FROM z{k} WHERE status IS NOT NULL" for k in (1, 2, 3)]) + " UNION ALL SELECT qid, 'open', 3 FROM g4")
def beam_states(spark, sf_dir):
    """What became of each of a beam's questions."""
    return _history(spark, sf_dir)[1]


def _walk_sql(k: int) -> str:
    """One depth of neighbours, pruning, targets."""
    seen = " UNION ALL ".join(f"SELECT qid, entity FROM f{j}" for j in range(1, k + 1))
    return f"""
r{k} AS (SELECT DISTINCT f.qid, f.entity, e.relation, e.is_head FROM f{k} f JOIN ends e ON lower(f.entity) = e.k),
s{k} AS (SELECT r.qid, {k} AS depth, r.entity, r.relation, r.is_head, e.candidate FROM r{k} r JOIN ends e ON lower(r.entity) = e.k AND r.relation = e.relation AND r.is_head = e.is_head WHERE NOT contains(r.relation, 'HAS')),
z{k} AS (SELECT qid, CASE WHEN qid NOT IN (SELECT qid FROM r{k}) THEN 'exhausted' WHEN qid NOT IN (SELECT qid FROM s{k}) THEN 'pruned' END AS status, {k} AS depth FROM g{k}),
f{k + 1} AS (SELECT qid, entity FROM (SELECT qid, entity, row_number() OVER (PARTITION BY qid ORDER BY entity) AS n FROM (SELECT DISTINCT qid, candidate AS entity FROM s{k} WHERE (qid, candidate) NOT IN ({seen}))) WHERE n <= 5),
y{k} AS (SELECT qid, 'exhausted' AS status, {k} AS depth FROM z{k} WHERE status IS NULL AND {k} < 3 AND qid NOT IN (SELECT qid FROM f{k + 1})),
g{k + 1} AS (SELECT qid FROM z{k} WHERE status IS NULL AND qid NOT IN (SELECT qid FROM y{k}))"""


_NEIGHBOURS_SQL = f"""{_T}, ends AS (SELECT DISTINCT lower(head) AS k, rel AS relation, true AS is_head, tail AS candidate FROM triples UNION SELECT DISTINCT lower(tail), rel, false, head FROM triples),
f1 AS (SELECT * FROM (VALUES {', '.join(str(t) for t in _LAST_TOPICS)}) v(qid, entity)), g1 AS (SELECT DISTINCT qid FROM f1),{_walk_sql(1)},{_walk_sql(2)},{_walk_sql(3)}"""


def _neighbours(spark, sf_dir):
    topics = spark.createDataFrame(_LAST_TOPICS, "qid string, entity string")
    return G.neighbour_walk(R.star_store(spark, sf_dir), topics, lambda relations: relations.filter(~F.contains("relation", F.lit("HAS"))))


@query(f"{_NEIGHBOURS_SQL} SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3")
def neighbour_targets(spark, sf_dir):
    """All that kept relations of a frontier lead to, five entities of a question going on."""
    return _neighbours(spark, sf_dir)[0]


@query(f"{_NEIGHBOURS_SQL} " + " UNION ALL ".join(f"SELECT qid, status, depth FROM z{k} WHERE status IS NOT NULL UNION ALL SELECT * FROM y{k}" for k in (1, 2, 3)) + " UNION ALL SELECT qid, 'open', 3 FROM g4")
def neighbour_states(spark, sf_dir):
    return _neighbours(spark, sf_dir)[1]


def _memory_sql(depth: int) -> str:
    """One depth of the bounded traversal: words, hits by side, scores, cut, the next topics."""
    k = depth
    sides = [f"SELECT qid, word, head, rel, tail, '{s}' AS side FROM v{k} JOIN named ON {f'contains({x}, word)' if k == 1 else f'{x} = word'}" for s, x in (("head", "hk"), ("tail", "tk"), *([("rel", "rk")] if k == 1 else []))]
    seen = " UNION ".join(["SELECT qid, lower(replace(trim(entity), '_', ' ')) AS word FROM topics", *[f"SELECT qid, word FROM v{j}" for j in range(1, k + 1)], *[f"SELECT qid, lower(replace(trim(entity), '_', ' ')) FROM t{j}" for j in range(2, k + 1)]])
    to = "CASE WHEN contains(lower(replace(trim(head), '_', ' ')), word) THEN [tail] WHEN contains(lower(replace(trim(tail), '_', ' ')), word) THEN [head] ELSE [head, tail] END"
    return f"""
s{k} AS (SELECT *, {_stub_sql('t', "head || ', ' || rel || ', ' || tail")} * 10 AS score FROM ({' UNION ALL '.join(sides)})),
m{k} AS (SELECT qid, {k} AS depth, seq, head, rel, tail, word, side FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, head, rel, tail, word, side) AS seq FROM s{k} WHERE score >= 8) WHERE seq <= 500),
o{k} AS (SELECT DISTINCT qid, unnest({to}) AS entity FROM m{k}),
t{k + 1} AS (SELECT qid, entity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY entity) AS n FROM o{k} WHERE (qid, lower(replace(trim(entity), '_', ' '))) NOT IN ({seen})) WHERE n <= 50),
v{k + 1} AS (SELECT DISTINCT qid, lower(replace(trim(entity), '_', ' ')) AS word FROM t{k + 1} WHERE (qid, lower(replace(trim(entity), '_', ' '))) NOT IN ({seen}))"""


_KT = "lower(replace(trim({}), '_', ' '))"


@query(f"""{_T}, topics AS (SELECT * FROM (VALUES {', '.join(str(t) for t in _TOPICS)}) v(qid, entity)),
named AS (SELECT *, {_KT.format('head')} AS hk, {_KT.format('rel')} AS rk, {_KT.format('tail')} AS tk FROM triples),
v1 AS (SELECT DISTINCT qid, unnest(string_split({_KT.format('entity')}, ' ')) AS word FROM topics),
{_memory_sql(1)},{_memory_sql(2)},{_memory_sql(3)}
SELECT qid, depth, seq::INT AS seq, head, rel, tail, word FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)
QUALIFY row_number() OVER (PARTITION BY qid, head, rel, tail ORDER BY depth, seq) = 1""")
def traverse_final(spark, sf_dir):
    topics = spark.createDataFrame(_TOPICS, "qid string, entity string")
    score = _stub("t")
    return G.traverse(R.star_triples(spark, sf_dir), topics, lambda q, x: score(q, x) * 10, max_depth=3)


def _shouted(prompts: pd.Series) -> pd.Series:
    """A model that scores each fact by a hash of it and repeats it in capitals and quotes, one without its quote's end."""

    def reply(prompt: str) -> str:
        facts = [x[1:-1] for x in prompt.split("\n")[1:]]
        return "\n".join(f"('{x.upper()}') (Score: {int(hashlib.md5(x.encode()).hexdigest()[:4], 16) % 10 + 1})" for x in facts)

    return prompts.map(reply)


_PATH_QUESTIONS = [("q1", "asia"), ("q2", "red widget"), ("q3", "nation 4"), ("q4", "nowhere")]


def _forest(spark, sf_dir):
    topics = spark.createDataFrame([*_TOPICS, ("q4", "nowhere")], "qid string, entity string")
    asked = spark.createDataFrame(_PATH_QUESTIONS, "qid string, question string")
    return P.path_forest(R.star_triples(spark, sf_dir), topics, M.pruner(asked, _shouted))


def _bare_sql(x: str) -> str:
    """The key by which spellings meet."""
    stops = ", ".join("'" + w + "'" for w in T.STOP_WORDS)
    bare = f"trim(translate(lower({x}), '{R._MARKS}', ''))"
    return f"CASE WHEN {bare} IN ({stops}) THEN '' ELSE {bare} END"


def _found_sql(depth: int) -> str:
    """One depth of a traversal with paths: words, hits, pruning by keys, the best new triples, the next words."""
    k = depth
    meet = "contains(hk, word) OR contains(tk, word) OR contains(rk, word)" if k == 1 else "hk = word OR tk = word"
    known = " UNION ALL ".join(f"SELECT qid, head, rel, tail FROM g{j}" for j in range(1, k)) or "SELECT NULL, NULL, NULL, NULL WHERE false"
    seen = " UNION ".join(["SELECT qid, lower(replace(trim(entity), '_', ' ')) AS word FROM topics", *[f"SELECT qid, word FROM w{j}" for j in range(1, k + 1)]])
    to = "CASE WHEN contains(lower(replace(trim(head), '_', ' ')), word) THEN [tail] WHEN contains(lower(replace(trim(tail), '_', ' ')), word) THEN [head] ELSE [head, tail] END"
    return f"""
n{k}(qid, head, rel, tail) AS ({known}),
h{k} AS (SELECT DISTINCT qid, word, parent_id, ways, head, rel, tail, key FROM w{k} JOIN keyed ON {meet} WHERE NOT EXISTS (SELECT 1 FROM n{k} n WHERE n.qid = w{k}.qid AND n.head = keyed.head AND n.rel = keyed.rel AND n.tail = keyed.tail)),
p{k} AS (SELECT qid, key, max(score) AS score FROM (SELECT qid, key, ('0x' || substr(md5(head || ', ' || rel || ', ' || tail), 1, 4))::BIGINT % 10 + 1 AS score FROM h{k}) WHERE score >= 8 GROUP BY qid, key),
e{k} AS (SELECT qid, head, rel, tail, max(score) AS score, min({{'p': coalesce(parent_id, 0), 'word': word, 'parent_id': parent_id, 'ways': ways}}) AS by_ FROM h{k} JOIN p{k} USING (qid, key) GROUP BY qid, head, rel, tail),
g{k} AS (SELECT qid, ({k}::BIGINT << 32) + seq AS path_id, by_.parent_id AS parent_id, {k} AS depth, seq, by_.word AS word, by_.ways AS ways, head, rel, tail FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, head, rel, tail) AS seq FROM e{k}) WHERE seq <= 500),
c{k} AS (SELECT qid, path_id, lower(replace(trim(unnest({to})), '_', ' ')) AS word FROM g{k}),
w{k + 1} AS (SELECT qid, word, parent_id, ways FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY parent_id, word) AS n FROM (SELECT qid, word, min(path_id) AS parent_id, count(DISTINCT path_id) AS ways FROM c{k} WHERE (qid, word) NOT IN ({seen}) GROUP BY qid, word)) WHERE n <= 50)"""


FOREST_SQL = f"""WITH RECURSIVE {R.TRIPLES_SQL}, topics AS (SELECT * FROM (VALUES {', '.join(str(t) for t in [*_TOPICS, ('q4', 'nowhere')])}) v(qid, entity)),
keyed AS (SELECT *, {_KT.format('head')} AS hk, {_KT.format('rel')} AS rk, {_KT.format('tail')} AS tk, {_bare_sql('head')} || chr(1) || {_bare_sql('rel')} || chr(1) || {_bare_sql('tail')} AS key FROM triples),
w1 AS (SELECT DISTINCT qid, unnest(string_split(lower(replace(trim(entity), '_', ' ')), ' ')) AS word, NULL::BIGINT AS parent_id, 0::BIGINT AS ways FROM topics),
{_found_sql(1)},{_found_sql(2)},{_found_sql(3)},
forest AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3)"""


@query(f"""{FOREST_SQL}, chain AS (
  SELECT qid, path_id, word || ' --> ' || head || ', ' || rel || ', ' || tail AS path FROM forest WHERE parent_id IS NULL
  UNION ALL SELECT f.qid, f.path_id, c.path || ' --> ' || f.head || ', ' || f.rel || ', ' || f.tail FROM forest f JOIN chain c ON f.qid = c.qid AND f.parent_id = c.path_id)
SELECT qid, path_id, parent_id, depth, seq::INT AS seq, word, ways, head, rel, tail, path FROM forest JOIN chain USING (qid, path_id)""")
def traverse_paths(spark, sf_dir):
    """Each triple of a traversal with the chain by which it was reached; a model prunes, in a spelling of its own."""
    return P.chains(_forest(spark, sf_dir)[0], 3)


@query(f"""{FOREST_SQL}, last AS (SELECT qid, max(depth) AS depth FROM (SELECT DISTINCT qid, 1 AS depth FROM w2 UNION ALL SELECT DISTINCT qid, 2 FROM w3 UNION ALL SELECT DISTINCT qid, 3 FROM w4) GROUP BY qid)
SELECT qid, CASE WHEN coalesce(depth, 0) = 3 THEN 'open' ELSE 'exhausted' END AS status, least(coalesce(depth, 0) + 1, 3)::INT AS depth FROM (SELECT DISTINCT qid FROM topics) LEFT JOIN last USING (qid)""")
def traverse_states(spark, sf_dir):
    """What became of each question of that traversal: none vanishes."""
    return _forest(spark, sf_dir)[1].select("qid", "status", "depth")


@query(f"""{FOREST_SQL}, led AS (SELECT f.qid, f.word, f.head || ', ' || f.rel || ', ' || f.tail AS line, b.word AS source, unnest(CASE WHEN contains({_KT.format('f.head')}, f.word) THEN [f.tail] WHEN contains({_KT.format('f.tail')}, f.word) THEN [f.head] ELSE [f.head, f.tail] END) AS candidate FROM forest f LEFT JOIN forest b ON b.qid = f.qid AND b.path_id = f.parent_id)
SELECT qid, word AS entity, array_to_string(list_sort(list(DISTINCT line)), ';') AS triples, coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ';'), '') AS sources, array_to_string(list_sort(list(DISTINCT {_KT.format('candidate')})), ';') AS candidates FROM led GROUP BY qid, word""")
def accumulated_entities(spark, sf_dir):
    """What each searched entity of a traversal matched, came from and leads to."""
    found = G.accumulated(_forest(spark, sf_dir)[0])
    return found.select("qid", "entity", *[F.array_join(c, ";").alias(c) for c in ("triples", "sources", "candidates")])


@query(f"""{_T} SELECT rel, tail, head FROM (SELECT *, count(*) OVER (PARTITION BY rel, tail) AS n, row_number() OVER (PARTITION BY rel, tail ORDER BY head) AS k FROM triples) WHERE n <= 100 OR k <= 30""")
def capped_candidates(spark, sf_dir):
    """Ends of a relation: all of up to a hundred, the first thirty of more."""
    return cut_large(R.star_triples(spark, sf_dir), ["rel", "tail"], ["head"], 101, 30).select("rel", "tail", "head")


_LABELLED = """e AS (SELECT c_custkey + 1000000 AS src_id, 7 AS relation_id, c_nationkey AS dst_id FROM customer UNION ALL SELECT n_nationkey, 8, n_regionkey + 1000 FROM nation UNION ALL SELECT s_suppkey + 2000000, 9, s_nationkey FROM supplier),
l AS (SELECT n_nationkey::BIGINT AS node_id, n_name AS label, 'en' AS lang FROM nation UNION ALL SELECT r_regionkey + 1000, r_name, 'en' FROM region UNION ALL SELECT * FROM (VALUES (7, 'lives in', 'en'), (7, 'wohnt in', 'de'), (8, 'part of', 'en'), (9, 'trades in', 'de')) p)"""


def _labelled(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, a, r, b: df.select(a.cast("long").alias("src_id"), F.lit(r).cast("long").alias("relation_id"), b.cast("long").alias("dst_id"))
    edges = edge(t("customer"), F.col("c_custkey") + 1000000, 7, F.col("c_nationkey")).union(edge(t("nation"), F.col("n_nationkey"), 8, F.col("n_regionkey") + 1000)).union(edge(t("supplier"), F.col("s_suppkey") + 2000000, 9, F.col("s_nationkey")))
    label = lambda df, a, b: df.select(a.cast("long").alias("node_id"), F.col(b).alias("label"), F.lit("en").alias("lang"))
    names = spark.createDataFrame([(7, "lives in", "en"), (7, "wohnt in", "de"), (8, "part of", "en"), (9, "trades in", "de")], "node_id long, label string, lang string")
    return edges, label(t("nation"), F.col("n_nationkey"), "n_name").union(label(t("region"), F.col("r_regionkey") + 1000, "r_name")).union(names)


@query(f"""WITH {_LABELLED}, w AS (SELECT label, min(node_id) AS node_id FROM l WHERE label IN (SELECT n_name FROM nation UNION SELECT r_name FROM region) GROUP BY label)
SELECT DISTINCT w.label, is_head, relation_id::BIGINT AS relation, p.label AS relation_label FROM w JOIN (SELECT src_id AS near, true AS is_head, relation_id FROM e UNION ALL SELECT dst_id, false, relation_id FROM e) s ON near = w.node_id JOIN l p ON p.node_id = relation_id AND p.lang = 'en'""")
def relation_label_search(spark, sf_dir):
    """English labels of the relations that leave and reach each nation and region."""
    edges, labels = _labelled(spark, sf_dir)
    wanted = table(spark, sf_dir, "nation").select(F.col("n_name").alias("label")).union(table(spark, sf_dir, "region").select("r_name"))
    return G.relation_labels(edges, labels, wanted)


@query(f"WITH {_LABELLED} SELECT w.label, min(node_id)::BIGINT AS node_id FROM (SELECT 'lives in' AS label UNION ALL SELECT 'part of' UNION ALL SELECT DISTINCT o_orderpriority FROM orders) w LEFT JOIN l ON l.label = w.label GROUP BY w.label")
def property_ids(spark, sf_dir):
    """Properties by their labels; null where there is none."""
    wanted = spark.createDataFrame([("lives in",), ("part of",)], "label string").union(table(spark, sf_dir, "orders").select("o_orderpriority").distinct())
    return G.label_lookup(_labelled(spark, sf_dir)[1], wanted).select("label", "node_id")


@query("""SELECT user_id, event_type, props, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type, props""")
def memory_dedupe(spark, sf_dir):
    from ..operators.relational import first_occurrence

    keys = ["user_id", "event_type", "props"]
    return first_occurrence(table(spark, sf_dir, "events").select(*keys, "event_id", "ts"), keys, ["ts", "event_id"]).select(*keys, "event_id")


@query(f"""{_T}, low AS (SELECT DISTINCT doc_id, lower(text) AS text FROM documents), w AS (SELECT DISTINCT unnest(['the', 'and', 'for', 'red']) AS head), v AS (SELECT DISTINCT unnest(['of', 'ring', 'the']) AS tail)
SELECT doc_id, head, tail FROM low, w, v WHERE head <> tail AND contains(text, head) AND contains(text, tail)""")
def hallucination_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("head", F.explode(F.array(*map(F.lit, ("the", "and", "for", "red"))))).withColumn("tail", F.explode(F.array(*map(F.lit, ("of", "ring", "the")))))
    return G.supported(found).select("doc_id", "head", "tail")


@query(f"""{_T} SELECT rel, count(*) AS n FROM triples WHERE NOT regexp_matches(rel || CASE WHEN rel LIKE 'HAS%' THEN ' number' ELSE '' END, '( ID| code| number|instance of|website|URL|inception|image| rate| count)$') AND NOT contains(rel, 'sameAs') GROUP BY rel""")
def prune_relation_suffix(spark, sf_dir):
    named = F.concat("rel", F.when(F.startswith(F.col("rel"), F.lit("HAS")), " number").otherwise(""))
    return R.star_triples(spark, sf_dir).filter(~T.is_identifier_relation(named) & ~T.is_abandoned_relation(F.col("rel"))).groupBy("rel").agg(F.count("*").alias("n"))


_QUERIES = "vec_id % 20 = 0"
_NEAR = f"""near AS (SELECT query_id, vec_id, distance, rank::INT AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) ** 2 AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.{_QUERIES}) WHERE rank <= 5)"""


def _near(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.top_k(e, e.filter(_QUERIES).select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query(f"WITH {_NEAR} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM near")
def vector_topk(spark, sf_dir):
    return _near(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_NEAR} SELECT query_id, vec_id, rank::INT AS rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || ':' || vec_id) DESC, vec_id) AS rank FROM near) WHERE rank <= 2")
def vector_rerank(spark, sf_dir):
    score = F.md5(F.concat_ws(":", "query_id", "vec_id").cast("binary"))
    return V.rerank(_near(spark, sf_dir), score).select("query_id", "vec_id", "rank")


def _hybrid(mode: str):
    def run(spark, sf_dir):
        vec = _near(spark, sf_dir).select("query_id", F.col("vec_id").alias("node_id"), (-F.round("distance", 6)).alias("score"))
        e = table(spark, sf_dir, "embeddings")
        asked, nodes = e.filter(_QUERIES).select(F.col("vec_id").alias("query_id"), "label"), e.select(F.col("vec_id").alias("node_id"), "label")
        if mode == "AND":
            # of all pairs of a label only those that the vectors found can be in both: those are looked up, and no label is multiplied out
            vec = written(vec)
            kg = vec.select("query_id", "node_id").join(asked, "query_id").join(nodes, ["node_id", "label"])
        else:
            kg = asked.join(nodes, "label")
        return V.hybrid(vec, kg.select("query_id", "node_id", F.lit(1000.0).alias("score")), mode, by=["query_id"])

    run.__name__ = f"hybrid_{mode.lower()}"
    kind = "JOIN" if mode == "AND" else "FULL JOIN"
    return query(f"""WITH {_NEAR}, kg AS (SELECT q.vec_id AS query_id, e.vec_id AS node_id FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.{_QUERIES})
SELECT coalesce(k.query_id, n.query_id) AS query_id, coalesce(k.node_id, n.vec_id) AS node_id, CASE WHEN k.node_id IS NULL THEN -round(distance, 6) ELSE 1000.0 END AS score, CASE WHEN k.node_id IS NULL THEN 'vector' WHEN n.vec_id IS NULL THEN 'kg' ELSE 'both' END AS origin
FROM near n {kind} kg k ON n.query_id = k.query_id AND n.vec_id = k.node_id""")(run)


_hybrid("OR")
_hybrid("AND")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def context_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return V.context_similarity(pairs, "embedding", "other").select("vec_id", F.round("similarity", 6).alias("similarity"))
