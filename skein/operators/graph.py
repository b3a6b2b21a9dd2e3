"""Triples (head, rel, tail): building, matching, neighbours, bounded traversal and beams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from ..sources.stores import GraphStore
from .contains import names_with
from .sampling import cut_large

SIDES = ("head", "rel", "tail")
FINISH = "[FINISH]"
UNNAMED = "UnName_Entity"
#: Different words up to which a search tries each on every triple instead of looking names up.
FEW_WORDS = 32
#: Rows of words up to which they are sent to all tasks.
SENT_ROWS = 1 << 16


def triples(edges: DataFrame, head: Column, rel: str, tail: Column) -> DataFrame:
    return edges.select(head.cast("string").alias("head"), F.lit(rel).alias("rel"), tail.cast("string").alias("tail"))


def nodes(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("head").alias("node")).union(graph.select(F.col("tail").alias("node"))).distinct()


def match_side(graph: DataFrame, pattern: str, side: str) -> DataFrame:
    """Triples whose side matches a regular expression anywhere."""
    return graph.filter(F.col(side).rlike(pattern))


def match_any(graph: DataFrame, pattern: str) -> DataFrame:
    return graph.filter(F.col("head").rlike(pattern) | F.col("tail").rlike(pattern) | F.col("rel").rlike(pattern))


def word_hits(words: DataFrame, graph: DataFrame, exact: bool = False, sides: bool = True) -> DataFrame:
    """(words' columns, head, rel, tail, side): triples where a word is in a side, or is the whole of head or tail.

    Words come in a column `word`, lower case. Whole sides are an equi-join on the side's
    lower-case text. Parts: up to FEW_WORDS different words are tried on each triple where
    it lies, so that nothing of the graph is shuffled and no task gets all that a word or
    a relation has; more of them meet the different names of all sides through their
    pieces (names_with), and triples are reached by an equi-join of names. Without
    `sides` there is no such column, and a word's triple comes once.
    """
    named = lambda side: graph.withColumn("_text", T.kg_text(F.col(side)))
    if exact:
        parts = [words.join(named(side), F.col("word") == F.col("_text")).withColumn("side", F.lit(side)) for side in ("head", "tail")]
        if not sides:
            parts[1] = parts[1].filter(F.coalesce(T.kg_text(F.col("head")) != F.col("word"), F.lit(True)))
    else:
        few = words.groupBy("word").agg(F.count("*").alias("n")).limit(FEW_WORDS + 1).collect()
        if len(few) <= FEW_WORDS:
            tried = _tried([r["word"] for r in few if r["word"] is not None], graph, sides)
            # hits are many and words few: they go to the hits, whatever Spark knows of their size
            asked = F.broadcast(words) if sum(r["n"] for r in few) <= SENT_ROWS else words
            return asked.join(tried, "word").select(*words.columns, *graph.columns, *(["side"] if sides else []))
        names = graph.select(F.explode(F.array(*[T.kg_text(F.col(side)) for side in SIDES])).alias("name")).distinct()
        found = names_with(words.select("word").distinct(), names).withColumnRenamed("name", "_text")
        keyed = words.join(found, "word")
        parts = [keyed.join(named(side), "_text").withColumn("side", F.lit(side)) for side in SIDES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.drop("_text")
    return out if sides else out.drop("side").distinct() if not exact else out.drop("side")


def _tried(words: list[str], graph: DataFrame, sides: bool) -> DataFrame:
    """graph with each of the words that is in a side as `word`, for each `side` or once."""
    text = graph.withColumns({f"_{s}": T.kg_text(F.col(s)) for s in SIDES})
    held = lambda side, word: F.contains(F.col(f"_{side}"), F.lit(word))
    if sides:
        met = [F.when(held(s, w), F.struct(F.lit(w).alias("word"), F.lit(s).alias("side"))) for w in words for s in SIDES]
    else:
        met = [F.when(held("head", w) | held("rel", w) | held("tail", w), F.struct(F.lit(w).alias("word"))) for w in words]
    kind = "array<struct<word:string,side:string>>" if sides else "array<struct<word:string>>"
    return text.select(*graph.columns, F.inline(F.array_compact(F.array(*met).cast(kind))))


def question_hits(frontier: DataFrame, graph: DataFrame, exact: bool = False) -> DataFrame:
    """(qid, head, rel, tail, by): what word_hits() finds for words of frontier (qid, word, parent_id, ways), each triple of the graph once for a question.

    by (p, word, parent_id, ways) is the least of the question's words that are in the
    triple, p being its parent or 0. Up to FEW_WORDS words are tried where a triple lies,
    as in word_hits(); whole sides are looked up in one pass over the graph, which is
    shuffled only if the words are too many to be sent. Neither way are hits shuffled to
    make them one for each question.
    """
    by = F.struct(F.coalesce("parent_id", F.lit(0)).cast("long").alias("p"), "word", "parent_id", "ways")
    if exact:
        words = frontier.filter("word IS NOT NULL").groupBy("word").agg(F.collect_list(F.struct("qid", by.alias("by"))).alias("_f"))
        words = F.broadcast(words) if frontier.limit(SENT_ROWS + 1).count() <= SENT_ROWS else words
        met = graph
        for s in ("head", "tail"):
            met = met.withColumn("_text", T.kg_text(F.col(s))).join(words.select(F.col("word").alias("_text"), F.col("_f").alias(f"_{s}")), "_text", "left").drop("_text")
        both = F.array_sort(F.concat("_head", "_tail"))
        # in order of questions and then of what is least: the first of each question
        least = F.filter(both, lambda x, i: (i == 0) | ~x["qid"].eqNullSafe(F.get(both, i - 1)["qid"]))
        met = met.filter("_head IS NOT NULL OR _tail IS NOT NULL")
        return met.select(*SIDES, F.inline(F.when(F.col("_head").isNull(), F.col("_tail")).when(F.col("_tail").isNull(), F.col("_head")).otherwise(least))).select("qid", *SIDES, "by")
    few = frontier.select("qid", "word", by.alias("by")).limit(FEW_WORDS + 1).collect()
    if len(few) > FEW_WORDS:
        hits = word_hits(frontier, graph, sides=False)
        return hits.groupBy("qid", *SIDES).agg(F.min(by).alias("by"))
    text = graph.withColumns({f"_{s}": T.kg_text(F.col(s)) for s in SIDES})
    kinds = {f.name: f.dataType for f in frontier.schema.fields}
    lit = lambda value, name: F.lit(value).cast(kinds[name]).alias(name)
    of = {}
    for r in few:
        if r["word"] is not None:
            of.setdefault(r["qid"], []).append(r["by"])
    held = lambda word: F.contains(F.col("_head"), F.lit(word)) | F.contains(F.col("_rel"), F.lit(word)) | F.contains(F.col("_tail"), F.lit(word))
    each = lambda b: F.struct(F.lit(b["p"]).cast("long").alias("p"), *[lit(b[n], n) for n in ("word", "parent_id", "ways")])
    # of a question's words, least first, the first that is held
    met = []
    for qid, found in of.items():
        first = F.lit(None)
        for b in sorted(found, key=lambda b: (b["p"], b["word"].encode("utf-8", "surrogatepass")), reverse=True):
            first = F.when(held(b["word"]), F.struct(lit(qid, "qid"), each(b).alias("by"))).otherwise(first)
        met.append(first)
    kind = frontier.select(F.array(F.struct("qid", by.alias("by")))).schema[0].dataType.simpleString()
    return text.select(*SIDES, F.inline(F.array_compact(F.array(*met).cast(kind)))).select("qid", *SIDES, "by")


def next_candidates(hits: DataFrame) -> DataFrame:
    """Hits with `candidate`: the word in the head leads to the tail, in the tail to the head, in the relation to both."""
    low = lambda c: T.kg_text(F.col(c))
    to = F.when(F.contains(low("head"), F.col("word")), F.array("tail")).when(F.contains(low("tail"), F.col("word")), F.array("head")).when(F.contains(low("rel"), F.col("word")), F.array("head", "tail"))
    return hits.withColumn("candidate", F.explode(to))


def entity_relations(graph: DataFrame, pattern: str) -> DataFrame:
    """(relation, is_head) of entities that match: once for a relation and direction."""
    heads = match_side(graph, pattern, "head").select(F.col("rel").alias("relation"), F.lit(True).alias("is_head"))
    return heads.union(match_side(graph, pattern, "tail").select(F.col("rel").alias("relation"), F.lit(False).alias("is_head"))).distinct()


def _ends(graph: DataFrame | GraphStore, keyed: DataFrame) -> DataFrame:
    """(_key, relation, is_head, candidate) at the keys of `keyed` alone: each side of the graph meets the few keys before anything of it is made distinct. A stored graph is joined in its buckets."""
    wanted = keyed.select(F.col("_key").alias("key")).distinct()
    sides = (graph.by_head, graph.by_tail) if isinstance(graph, GraphStore) else tuple(graph.withColumn("key", F.lower(s)) for s in ("head", "tail"))
    end = lambda side, to, is_head: side.join(wanted, "key", "left_semi").select(F.col("key").alias("_key"), F.col("rel").alias("relation"), F.lit(is_head).alias("is_head"), F.col(to).alias("candidate"))
    return end(sides[0], "tail", True).union(end(sides[1], "head", False))


def frontier_relations(graph: DataFrame | GraphStore, frontier: DataFrame) -> DataFrame:
    """(frontier's columns, relation, is_head) for frontier entities in `entity`, case aside."""
    keyed = frontier.withColumn("_key", F.lower("entity"))
    return keyed.join(_ends(graph, keyed).select("_key", "relation", "is_head").distinct(), "_key").drop("_key")


def entity_search(graph: DataFrame | GraphStore, wanted: DataFrame) -> DataFrame:
    """wanted (entity, relation, is_head, ...) with `candidate` at the other end, case aside."""
    keyed = wanted.withColumn("_key", F.lower("entity"))
    ends = _ends(graph, keyed).join(keyed.select("_key", "relation", "is_head").distinct(), ["_key", "relation", "is_head"], "left_semi")
    return keyed.join(ends.distinct(), ["_key", "relation", "is_head"]).drop("_key")


def neighbour_labels(edges: DataFrame, labels: DataFrame, wanted: DataFrame, lang: str = "en", most: int = 100) -> DataFrame:
    """(label, relation, is_head, neighbour): labels in `lang` of the nodes next to each wanted label's least node.

    edges (src_id, relation, dst_id), labels (node_id, label, lang), wanted (label). Of a
    label, relation and direction the first `most` neighbours by label are kept, as a
    limited lookup would. All labels of a hub's neighbours are looked up before the cut,
    for it goes by label; of these each task passes on no more than `most`.
    """
    named = label_lookup(labels, wanted.select("label").distinct()).filter("node_id IS NOT NULL")
    out = named.join(edges, F.col("node_id") == F.col("src_id")).select("label", "relation", F.lit(True).alias("is_head"), F.col("dst_id").alias("_to"))
    into = named.join(edges, F.col("node_id") == F.col("dst_id")).select("label", "relation", F.lit(False).alias("is_head"), F.col("src_id").alias("_to"))
    texts = labels.filter(F.col("lang") == lang).select(F.col("node_id").alias("_to"), F.col("label").alias("neighbour"))
    found = out.union(into).join(texts, "_to").select("label", "relation", "is_head", "neighbour").distinct()
    first = Window.partitionBy("label", "relation", "is_head").orderBy("neighbour")
    return found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")


def relation_labels(edges: DataFrame, labels: DataFrame, wanted: DataFrame, lang: str = "en", most: int = 100) -> DataFrame:
    """(label, is_head, relation, relation_label): the relations that leave and reach each wanted label's least node, with their labels in `lang`.

    edges (src_id, relation_id, dst_id), labels (node_id, label, lang), wanted (label). Of
    a label and direction the first `most` by label are kept. A node's relations are made
    distinct where its edges lie before any are shuffled, so a hub moves as many rows as
    it has relations.
    """
    named = label_lookup(labels, wanted.select("label").distinct()).filter("node_id IS NOT NULL")
    side = lambda at, is_head: named.join(edges, F.col("node_id") == F.col(at)).select("label", F.lit(is_head).alias("is_head"), F.col("relation_id").alias("relation")).distinct()
    texts = labels.filter(F.col("lang") == lang).select(F.col("node_id").alias("relation"), F.col("label").alias("relation_label"))
    found = side("src_id", True).union(side("dst_id", False)).join(texts, "relation").select("label", "is_head", "relation", "relation_label").distinct()
    first = Window.partitionBy("label", "is_head").orderBy("relation_label", "relation")
    return found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")


def accumulated(forest: DataFrame) -> DataFrame:
    """(qid, entity, triples, sources, candidates) of a traversal's rows: for each entity that was searched the triples found by it, the entities those before came from, and the entities they lead to, each set in order.

    As large as the traversal lets a question's triples be.
    """
    line = F.concat_ws(", ", *SIDES)
    before = forest.select("qid", F.col("path_id").alias("parent_id"), F.col("word").alias("source"))
    led = next_candidates(forest).join(before, ["qid", "parent_id"], "left")
    sets = {"triples": line, "sources": F.col("source"), "candidates": T.kg_text(F.col("candidate"))}
    return led.groupBy("qid", F.col("word").alias("entity")).agg(*[F.array_sort(F.collect_set(x)).alias(n) for n, x in sets.items()])


def label_lookup(labels: DataFrame, wanted: DataFrame, default: str | None = None) -> DataFrame:
    """wanted (label) with the least node of each label (node_id, label); without one, null or `default`."""
    first = labels.groupBy("label").agg(F.min("node_id").alias("node_id"))
    out = wanted.join(first, "label", "left")
    return out if default is None else out.withColumn("node_id", F.coalesce(F.col("node_id").cast("string"), F.lit(default)))


def drop_placeholders(found: DataFrame, by: list[str], column: str = "candidate", placeholder: str = UNNAMED) -> DataFrame:
    """Placeholder entities go, unless a group has nothing else."""
    named = F.sum((F.col(column) != placeholder).cast("int")).over(Window.partitionBy(*by))
    return found.withColumn("_named", named).filter((F.col(column) != placeholder) | (F.col("_named") == 0)).drop("_named")


def finish_status(found: DataFrame, by: list[str], column: str = "candidate") -> DataFrame:
    """(by, n_open, finished): how many entities of a group aren't finish markers, and whether all are."""
    mark = F.col(column) == FINISH
    return found.groupBy(*by).agg(F.count_if(~mark).alias("n_open"), F.bool_and(mark).alias("finished"))


def ranked_relations(relations: Column, scores: Column) -> Column:
    """array<struct(relation, score)> of two arrays; 1/n each where all scores are zero."""
    even = F.transform(scores, lambda s: F.lit(1.0) / F.size(scores))
    return F.zip_with(relations, F.when(F.forall(scores, lambda s: s == 0), even).otherwise(scores), lambda r, s: F.struct(r.alias("relation"), s.alias("score")))


def top_by_score(rows: DataFrame, by: list[str], score: str, ties: list[str], width: int) -> DataFrame:
    """The width best rows of each group, ties in the order given; zero scores go after the cut."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= width).drop("_rank").filter(F.col(score) != 0)


def uniform_scores(rows: DataFrame, by: list[str]) -> Column:
    """1/n for each of a group's n rows, to two digits, halves to even."""
    return F.bround(1.0 / F.count("*").over(Window.partitionBy(*by)), 2)


def khop(graph: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, depth) reached from seeds (node) within `hops` edges in either direction, at the least depth.

    A loop of at most `hops` steps; each joins the last frontier with the graph, takes
    out what was visited and writes what is left, so that no step repeats those before it.
    """
    both = graph.select(F.col("head").alias("node"), F.col("tail").alias("to")).union(graph.select(F.col("tail").alias("node"), F.col("head").alias("to")))
    frontier = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    visited = frontier
    for depth in range(1, hops + 1):
        frontier = written(frontier.join(both, "node").select(F.col("to").alias("node")).distinct().join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        visited = visited.union(frontier)
    return visited


Score = Callable[[Column, Column], Column]
Stop = Callable[[DataFrame], DataFrame]


def _beams(graph: DataFrame | GraphStore, topics: DataFrame, score_relation: Score, score_entity: Score, depth: int, width: int, retain: int, many: int, stop: Stop | None):
    """(depth, frontier, candidates, beam, those that stop) of each depth, each written: see beam_search()."""
    frontier, previous = topics.select("qid", "entity").distinct(), None
    for at in range(1, depth + 1):
        relations = frontier_relations(graph, frontier)
        if previous is not None:
            relations = relations.join(previous, ["qid", "relation", "is_head"], "left_anti")
        relations = relations.withColumn("relation_score", score_relation(F.col("qid"), F.col("relation")))
        # written, as are a hub's entities once they are cut: what is read again is small, and no side of the graph is searched twice
        relations = written(top_by_score(relations, ["qid", "entity"], "relation_score", ["relation", "is_head"], width))
        found = entity_search(graph, relations)
        group = ["qid", "entity", "relation", "is_head"]
        found = cut_large(found, group, [F.md5(F.col("candidate").cast("binary")), "candidate"], many, retain)
        found = written(found).withColumn("score", score_entity(F.col("qid"), F.col("candidate")) * F.col("relation_score"))
        beam = top_by_score(found, ["qid"], "score", ["candidate", "entity", "relation", "is_head"], width)
        beam = written(beam.select("qid", F.lit(at).alias("depth"), *group[1:], "candidate", "score"))
        stopped = None if stop is None else written(stop(beam).select("qid").distinct())
        yield at, frontier, found, beam, stopped
        previous = beam.select("qid", "relation", "is_head").distinct()
        frontier = beam.select("qid", F.col("candidate").alias("entity")).distinct()
        if stopped is not None:
            frontier = frontier.join(stopped, "qid", "left_anti")


def beam_search(graph: DataFrame | GraphStore, topics: DataFrame, score_relation: Score, score_entity: Score, depth: int = 3, width: int = 3, retain: int = 5, many: int = 20, stop: Stop | None = None) -> DataFrame:
    """(qid, depth, entity, relation, is_head, candidate, score): beams of all questions at once.

    topics (qid, entity). At each depth: relations of the frontier less the last ones of
    the question, the `width` best of each entity; entities at their ends, of `many` or
    more `retain` by hash; score of entity times relation; the `width` best of a
    question, zeros dropped; their candidates are the next frontier. stop(beam) names the
    qids (qid) that are answered and go no further.
    """
    out = None
    for _, _, _, beam, _ in _beams(graph, topics, score_relation, score_entity, depth, width, retain, many, stop):
        out = beam if out is None else out.union(beam)
    return out


def beam_history(graph: DataFrame | GraphStore, topics: DataFrame, score_relation: Score, score_entity: Score, depth: int = 3, width: int = 3, retain: int = 5, many: int = 20, stop: Stop | None = None) -> tuple[DataFrame, DataFrame]:
    """beam_search() with finish rows, and (qid, status, depth) of every question, so that none vanishes.

    Where an entity of a frontier leads nowhere there is a row of it with the candidate
    FINISH, no relation and score 0. A question is answered where stop() names it,
    exhausted where no entity of its frontier leads anywhere, pruned where all that was
    found scores 0, and open after the last depth.
    """
    history, states, going = None, None, topics.select("qid").distinct()
    ended = lambda qids, status, at: qids.select("qid", F.lit(status).alias("status"), F.lit(at).alias("depth"))
    for at, frontier, found, beam, stopped in _beams(graph, topics, score_relation, score_entity, depth, width, retain, many, stop):
        met = written(found.select("qid", "entity").distinct())
        nowhere = frontier.join(met, ["qid", "entity"], "left_anti")
        finish = nowhere.select("qid", F.lit(at).alias("depth"), "entity", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("boolean").alias("is_head"), F.lit(FINISH).alias("candidate"), F.lit(0.0).alias("score"))
        rows = beam.union(written(finish))
        history = rows if history is None else history.union(rows)
        dead = going.join(met.select("qid").distinct(), "qid", "left_anti")
        zero = going.join(dead.select("qid"), "qid", "left_anti").join(beam.select("qid").distinct(), "qid", "left_anti")
        here = ended(dead, "exhausted", at).union(ended(zero, "pruned", at))
        if stopped is not None:
            here = here.union(ended(going.join(stopped, "qid", "left_semi"), "answered", at))
        here = written(here)
        states = here if states is None else states.union(here)
        going = written(going.join(here.select("qid"), "qid", "left_anti"))
    return history, states.union(ended(going, "open", depth))


def neighbour_walk(graph: DataFrame | GraphStore, topics: DataFrame, keep: Callable[[DataFrame], DataFrame], max_depth: int = 3, max_entities: int = 5, stop: Stop | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbours, pruning, targets: (qid, depth, entity, relation, is_head, candidate), and (qid, status, depth) of every question.

    At each depth keep() gets the frontier's relations (qid, entity, relation, is_head)
    and returns those worth following; all they lead to are targets, of which the first
    max_entities of a question by text that weren't searched yet go on. Statuses are
    those of beam_history(); pruned is a question of whose relations none is kept.
    """
    frontier, seen = topics.select("qid", "entity").distinct(), None
    steps, states, going = None, None, topics.select("qid").distinct()
    ended = lambda qids, status, at: qids.select("qid", F.lit(status).alias("status"), F.lit(at).alias("depth"))
    for at in range(1, max_depth + 1):
        relations = written(frontier_relations(graph, frontier).select("qid", "entity", "relation", "is_head"))
        found = entity_search(graph, keep(relations).select("qid", "entity", "relation", "is_head").distinct())
        found = written(found.select("qid", F.lit(at).alias("depth"), "entity", "relation", "is_head", "candidate"))
        steps = found if steps is None else steps.union(found)
        seen = frontier if seen is None else seen.union(frontier)
        dead = going.join(relations.select("qid").distinct(), "qid", "left_anti")
        none = going.join(dead.select("qid"), "qid", "left_anti").join(found.select("qid").distinct(), "qid", "left_anti")
        here = ended(dead, "exhausted", at).union(ended(none, "pruned", at))
        if stop is not None:
            here = here.union(ended(going.join(stop(found).select("qid").distinct(), "qid", "left_semi"), "answered", at))
        here = written(here)
        onward = found.select("qid", F.col("candidate").alias("entity")).distinct().join(here.select("qid"), "qid", "left_anti").join(seen, ["qid", "entity"], "left_anti")
        first = Window.partitionBy("qid").orderBy("entity")
        frontier = written(onward.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max_entities).drop("_n"))
        left = going.join(here.select("qid"), "qid", "left_anti")
        stuck = written(ended(left.join(frontier.select("qid").distinct(), "qid", "left_anti"), "exhausted", at)) if at < max_depth else None
        states = here if states is None else states.union(here)
        if stuck is not None:
            states, left = states.union(stuck), left.join(stuck.select("qid"), "qid", "left_anti")
        going = written(left)
    return steps, states.union(ended(going, "open", max_depth))


def chains(beam: DataFrame) -> DataFrame:
    """(qid, chains): a question's triples in the order of depth and score, rendered."""
    triple = F.when(F.col("is_head"), F.struct(F.col("entity").alias("head"), F.col("relation").alias("rel"), F.col("candidate").alias("tail"))).otherwise(F.struct(F.col("candidate").alias("head"), F.col("relation").alias("rel"), F.col("entity").alias("tail")))
    listed = F.array_sort(F.collect_list(F.struct("depth", (-F.col("score")).alias("_s"), triple.alias("t"))))
    return beam.groupBy("qid").agg(listed.alias("_l")).select("qid", T.path_text(F.transform("_l", lambda x: x["t"])).alias("chains"))


Reason = Callable[[DataFrame, DataFrame], DataFrame]


def _walk(graph: DataFrame, topics: DataFrame, score: Callable[[Column, Column], Column], max_depth: int, least: float, most_triples: int, most_topics: int, reason: Reason | None) -> tuple[DataFrame, DataFrame | None]:
    """The memory of a traversal and, with `reason`, what it said of questions that were answered."""
    name = T.kg_text(F.col("entity"))
    visited = topics.select("qid", name.alias("word")).limit(0)
    memory, answers, frontier = None, None, topics.select("qid", "entity").distinct().withColumn("clue", F.lit(False))
    for depth in range(1, max_depth + 1):
        in_parts = F.col("clue") | F.lit(depth == 1)
        words = frontier.withColumn("word", F.explode(F.when(in_parts, T.search_words(name)).otherwise(F.array(name))))
        words = words.select("qid", "word", in_parts.alias("in_parts")).distinct().join(visited, ["qid", "word"], "left_anti")
        partial, whole = words.filter("in_parts").drop("in_parts"), words.filter("NOT in_parts").drop("in_parts")
        line = F.concat_ws(", ", *SIDES)
        scored = lambda hits: hits.withColumn("score", score(F.col("qid"), line)).filter(F.col("score") >= least)
        if depth == 1:
            found = scored(word_hits(partial, graph))
        else:
            found = scored(word_hits(whole, graph, exact=True))
            if reason is not None:
                # a word can be both: of hits that score enough each once
                found = found.unionByName(scored(word_hits(partial, graph))).distinct()
        ranked = Window.partitionBy("qid").orderBy(F.col("score").desc(), "head", "rel", "tail", "word", "side")
        found = found.withColumn("seq", F.row_number().over(ranked)).filter(F.col("seq") <= most_triples)
        found = written(found.select("qid", F.lit(depth).alias("depth"), "seq", *SIDES, "word", "side"))
        memory = found if memory is None else memory.union(found)
        # written, as is the frontier: otherwise each depth plans and computes those before it three times over
        visited = written(visited.union(words.select("qid", "word")).union(frontier.select("qid", name.alias("word"))).distinct())
        onward = next_candidates(found).select("qid", F.col("candidate").alias("entity")).distinct()
        onward = onward.withColumn("word", name).join(visited, ["qid", "word"], "left_anti")
        kept = Window.partitionBy("qid").orderBy("entity")
        onward = onward.withColumn("_n", F.row_number().over(kept)).filter(F.col("_n") <= most_topics).select("qid", "entity", F.lit(False).alias("clue"))
        if reason is not None:
            said = written(reason(found, frontier.select("qid").distinct()).select("qid", F.lit(depth).alias("depth"), "stop", "answer", "clues"))
            done = said.filter("stop")
            answers = done if answers is None else answers.union(done)
            clues = said.filter("NOT stop").select("qid", F.explode("clues").alias("entity")).distinct()
            clues = clues.withColumn("word", name).join(visited, ["qid", "word"], "left_anti").select("qid", "entity", F.lit(True).alias("clue"))
            onward = onward.join(done.select("qid"), "qid", "left_anti").union(clues)
        if depth < max_depth:
            frontier = written(onward)
    first = Window.partitionBy("qid", *SIDES).orderBy("depth", "seq")
    return memory.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "side"), answers


def traverse(graph: DataFrame, topics: DataFrame, score: Callable[[Column, Column], Column], max_depth: int = 3, least: float = 8, most_triples: int = 500, most_topics: int = 50) -> DataFrame:
    """(qid, depth, seq, head, rel, tail, word): memory of a bounded traversal, first occurrence of each triple.

    topics (qid, entity). Depth 1 finds words of topics anywhere in triples, later depths
    whole entities. Triples with score(qid, triple text) of at least `least` stay, the
    best most_triples of a question; the ends they lead to that weren't visited are the
    next topics, at most most_topics, in a fixed order. Visited words and entities are
    frames keyed by question.
    """
    return _walk(graph, topics, score, max_depth, least, most_triples, most_topics, None)[0]


def traverse_with_clues(graph: DataFrame, topics: DataFrame, score: Callable[[Column, Column], Column], reason: Reason, max_depth: int = 3, least: float = 8, most_triples: int = 500, most_topics: int = 50) -> DataFrame:
    """(qid, depth, answer, context): a traversal that asks after each depth whether its triples are enough.

    reason(found, asked) gives (qid, stop, answer, clues) for the questions of `asked`
    (qid), of which `found` holds this depth's triples, if any. A question that stops has
    its answer, and the depth, as the first line of its context; the clues of others are
    searched for by words at the next depth, beside the next topics. A context lists at
    most max_depth times most_triples triples, in the order in which they were found.
    """
    memory, answers = _walk(graph, topics, score, max_depth, least, most_triples, most_topics, reason)
    listed = F.array_sort(F.collect_list(F.struct("depth", "seq", F.concat_ws(", ", *SIDES).alias("line"))))
    lines = memory.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("_lines"))
    out = topics.select("qid").distinct().join(lines, "qid", "left").join(answers.select("qid", "depth", "answer"), "qid", "left")
    first = F.when(F.col("answer").isNotNull(), F.concat(F.lit("Answer: "), F.col("answer"), F.lit("\n\n"))).otherwise("")
    return out.select("qid", "depth", "answer", F.concat(first, F.lit("KG context:\n"), F.coalesce("_lines", F.lit("")), F.lit("\n")).alias("context"))


def extend_paths(paths: DataFrame, found: DataFrame) -> DataFrame:
    """paths (qid, last, path) with each triple that starts at their last entity appended, and a path of its own where there is none."""
    triple = F.struct("head", "rel", "tail")
    keyed = found.select("qid", F.lower("head").alias("_key"), triple.alias("triple"), F.col("tail").alias("next"))
    joined = keyed.join(paths.select("qid", F.lower("last").alias("_key"), "path"), ["qid", "_key"], "left")
    return joined.select("qid", F.col("next").alias("last"), F.concat(F.coalesce("path", F.array().cast("array<struct<head:string,rel:string,tail:string>>")), F.array("triple")).alias("path"))


def supported(found: DataFrame, text: str = "text") -> DataFrame:
    """Triples with different ends that both occur in the text, case aside."""
    low = F.lower(F.col(text))
    return found.filter((F.col("head") != F.col("tail")) & F.contains(low, F.lower("head")) & F.contains(low, F.lower("tail")))
