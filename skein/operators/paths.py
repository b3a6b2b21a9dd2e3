"""Traversals that keep how each triple was reached: a forest of parent pointers, and chains made of it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .graph import SIDES, Reason, next_candidates, question_hits

Prune = Callable[[DataFrame], DataFrame]


def spelling_keys(df: DataFrame) -> DataFrame:
    """df with _head, _rel and _tail, what each name has in common with other spellings of it: letter case, quotes and punctuation aside, and stop words alone are nothing.

    In two steps, each of which names what is before it, so that no name is translated twice.
    """
    bare = df.withColumns({f"_{s}": T.without_punctuation(F.replace(s, F.lit("’"), F.lit(""))) for s in SIDES})
    return bare.withColumns({f"_{s}": T.no_stop_word(F.col(f"_{s}")) for s in SIDES})


def stored_spelling(pruned: DataFrame, stored: DataFrame) -> DataFrame:
    """stored (qid, head, rel, tail, ...) that a pruned triple (qid, head, rel, tail, score) means, by the keys of all three parts; the greatest score of several.

    Keys are told apart by two hashes, 128 bits, which are what is shuffled and sorted.
    """

    def keyed(df: DataFrame) -> DataFrame:
        of = ["qid", *[f"_{s}" for s in SIDES]]
        # a name without a key is null itself; asked of keys, they would be made twice
        return spelling_keys(df.dropna(subset=["qid", *SIDES])).withColumns({"_k1": F.xxhash64(*of), "_k2": F.xxhash64(F.lit(1), *of)}).drop(*of[1:])

    meant = keyed(pruned).groupBy("_k1", "_k2").agg(F.max("score").alias("score"))
    return keyed(stored).join(meant, ["_k1", "_k2"]).drop("_k1", "_k2")


def by_score(score: Callable[[Column, Column], Column], least: float) -> Prune:
    """A pruning step that keeps triples with score(qid, triple text) of at least `least`."""
    return lambda stored: stored.select("qid", *SIDES, score(F.col("qid"), F.concat_ws(", ", *SIDES)).alias("score")).filter(F.col("score") >= least)


def path_forest(graph: DataFrame, topics: DataFrame, prune: Prune, max_depth: int = 3, most_triples: int = 500, most_topics: int = 50, reason: Reason | None = None) -> tuple[DataFrame, DataFrame]:
    """A traversal's triples with how each was reached, and what became of its questions.

    topics (qid, entity). Depth 1 finds words of topics anywhere in triples, later depths
    whole entities, and words of clues if `reason` gives any. prune() gets the triples
    (qid, head, rel, tail) of a depth, each once for a question if it is in the graph once, and returns those worth keeping with a
    score, in whatever spelling a model gives them; they meet the stored ones by keys.
    Of the triples that are new to a question the most_triples best are kept, and of the
    entities they lead to that weren't visited the most_topics of the best triples.

    The first table: (qid, path_id, parent_id, depth, seq, word, ways, head, rel, tail), a
    row for each triple of a question. parent_id is the best triple of an earlier depth
    that led to `word`, by which this one was found, and null for words of topics and
    clues; ways counts the triples that led there. A row has one parent, so the forest is
    as large as the triples, however many chains there may be through them.

    The second: (qid, status, depth, answer), a row for each question: answered, if
    reason() stopped it, exhausted, if nothing was left to search, or open after max_depth.

    What is found, visited and to be searched are tables keyed by question, written at
    each depth. A question without topics has no rows; a topic without words finds nothing.
    """
    name = T.kg_text(F.col("entity"))
    asked = topics.select("qid").distinct()
    visited = topics.select("qid", name.alias("word")).distinct()
    parts = T.search_words(name)
    frontier = topics.select("qid", F.explode(parts).alias("word")).distinct().withColumns({"partial": F.lit(True), "parent_id": F.lit(None).cast("long"), "ways": F.lit(0).cast("long")})
    forest, states, going = None, None, asked
    for depth in range(1, max_depth + 1):
        partial, whole = frontier.filter("partial").drop("partial"), frontier.filter("NOT partial").drop("partial")
        # of the words that found a triple `by` is the one with the best parent, and by its text
        hits = question_hits(partial, graph) if depth == 1 or reason is not None else question_hits(whole, graph, exact=True)
        if depth > 1 and reason is not None:
            hits = hits.unionByName(question_hits(whole, graph, exact=True)).groupBy("qid", *SIDES).agg(F.min("by").alias("by"))
        if forest is not None:
            hits = hits.join(forest.select("qid", *SIDES), ["qid", *SIDES], "left_anti")
        hits = written(hits)
        kept = stored_spelling(prune(hits.select("qid", *SIDES)), hits)
        # ranks that equal triples share cut most before a graph's repeated triples are made one
        ranked = Window.partitionBy("qid").orderBy(F.col("score").desc(), *SIDES)
        each = kept.withColumn("_n", F.dense_rank().over(ranked)).filter(F.col("_n") <= most_triples)
        each = each.groupBy("qid", *SIDES).agg(F.max("score").alias("score"), F.min("by").alias("by")).withColumn("seq", F.row_number().over(ranked))
        path_id = F.shiftleft(F.lit(depth).cast("long"), 32) + F.col("seq")
        found = written(each.select("qid", path_id.alias("path_id"), "by.parent_id", F.lit(depth).alias("depth"), "seq", "by.word", "by.ways", *SIDES))
        forest = found if forest is None else forest.union(found)
        visited = written(visited.union(frontier.select("qid", "word")).distinct())
        onward = next_candidates(found).select("qid", T.kg_text(F.col("candidate")).alias("word"), "path_id")
        onward = onward.groupBy("qid", "word").agg(F.min("path_id").alias("parent_id"), F.count_distinct("path_id").alias("ways")).join(visited, ["qid", "word"], "left_anti")
        first = Window.partitionBy("qid").orderBy("parent_id", "word")
        onward = onward.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most_topics)
        onward = onward.select("qid", "word", F.lit(False).alias("partial"), "parent_id", "ways")
        if reason is not None:
            said = written(reason(found, going).select("qid", "stop", "answer", "clues"))
            done = said.filter("stop").select("qid", F.lit("answered").alias("status"), F.lit(depth).alias("depth"), "answer")
            states = done if states is None else states.union(done)
            clues = said.filter("NOT stop").select("qid", F.explode("clues").alias("entity")).select("qid", F.explode(T.search_words(name)).alias("word")).distinct().join(visited, ["qid", "word"], "left_anti")
            clues = clues.select("qid", "word", F.lit(True).alias("partial"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("ways"))
            onward = onward.join(done.select("qid"), "qid", "left_anti").union(clues)
        frontier = written(onward.select("qid", "word", "partial", "parent_id", "ways"))
        stopped = going if reason is None else going.join(done.select("qid"), "qid", "left_anti")
        dead = stopped.join(frontier.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit("exhausted").alias("status"), F.lit(depth).alias("depth"), F.lit(None).cast("string").alias("answer"))
        states = dead if states is None else states.union(dead)
        going = written(stopped.join(frontier.select("qid").distinct(), "qid", "left_semi"))
    left = going.select("qid", F.lit("open").alias("status"), F.lit(max_depth).alias("depth"), F.lit(None).cast("string").alias("answer"))
    return forest, states.union(left)


def chains(forest: DataFrame, max_depth: int) -> DataFrame:
    """forest with `path`: the word it starts from, then its triples from the first to the row's own, ` --> ` between.

    By pointer doubling: in each round a row takes over the text and the parent of its
    parent, so that chains of up to max_depth triples need log2(max_depth) joins.
    """
    line = F.concat_ws(", ", *SIDES)
    state = forest.select("qid", "path_id", F.col("parent_id").alias("up"), F.when(F.col("parent_id").isNull(), F.concat_ws(" --> ", "word", line)).otherwise(line).alias("path"))
    for _ in range(math.ceil(math.log2(max(max_depth, 1)))):
        above = state.select("qid", F.col("path_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        state = state.join(above, ["qid", "up"], "left").select("qid", "path_id", F.col("_up").alias("up"), F.concat_ws(" --> ", "_path", "path").alias("path"))
        state = written(state)
    return forest.join(state.select("qid", "path_id", "path"), ["qid", "path_id"])


def path_context(forest: DataFrame, states: DataFrame, max_depth: int) -> DataFrame:
    """(qid, status, depth, answer, context): the chains of a question that lead on to no other, in the order in which they were found, after its answer if it has one.

    A context lists at most max_depth times most_triples chains of at most max_depth triples.
    """
    ended = chains(forest, max_depth).join(forest.select("qid", F.col("parent_id").alias("path_id")).distinct(), ["qid", "path_id"], "left_anti")
    listed = F.array_sort(F.collect_list(F.struct("path_id", "path")))
    lines = ended.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["path"]), "\n").alias("_lines"))
    first = F.when(F.col("answer").isNotNull(), F.concat(F.lit("Answer: "), F.col("answer"), F.lit("\n\n"))).otherwise("")
    return states.join(lines, "qid", "left").select("qid", "status", "depth", "answer", F.concat(first, F.lit("KG context:\n"), F.coalesce("_lines", F.lit("")), F.lit("\n")).alias("context"))
