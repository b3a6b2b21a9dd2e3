from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import models as M
from skein.operators import paths as P
from skein.plans import registry as R
from skein.plans import searching as S


def _plain(triples, topic, triples_most=500, topics_most=50):
    """Every triple passes: first the topic's word anywhere, then whole entities; the first depth of each triple."""
    depths, visited, frontier = {}, set(), [topic]
    for depth in (1, 2, 3):
        hits = [t for t in triples if any(w in x.split() if depth == 1 else w == x for w in frontier for x in t)]
        hits = sorted(hits)[:triples_most]
        for t in hits:
            depths.setdefault(t, depth)
        visited |= set(frontier)
        frontier = sorted({x for t in hits for x in (t[0], t[2])} - visited)[:topics_most]
    return depths


def test_traverse_final_against_plain_traversal(spark, monkeypatch):
    triples = [("alpha", "has", f"x{k:02d}") for k in range(70)] + [(f"x{k:02d}", "has", f"y{k:02d}") for k in range(70)]
    monkeypatch.setattr(R, "star_triples", lambda spark, sf_dir: spark.createDataFrame(triples, "head string, rel string, tail string"))
    monkeypatch.setattr(S, "_stub", lambda salt: lambda q, x: F.lit(1.0))
    monkeypatch.setattr(S, "_TOPICS", [("q1", "alpha")])
    found = {(r["head"], r["rel"], r["tail"]): r["depth"] for r in S.traverse_final(spark, "").collect()}
    assert found == _plain(triples, "alpha")
    assert len(found) == 120


def _forest(spark, triples, topics, prune=None, **how):
    graph = spark.createDataFrame(triples, "head string, rel string, tail string")
    asked = spark.createDataFrame(topics, "qid string, entity string")
    forest, states = P.path_forest(graph, asked, prune or P.by_score(lambda q, x: F.length(x).cast("double"), 0), **how)
    rows = {r["path_id"]: r for r in P.chains(forest, how.get("max_depth", 3)).collect()}
    return rows, {r["qid"]: (r["status"], r["depth"]) for r in states.collect()}, (forest, states)


def _walked(rows, path_id):
    """A chain by following parents one by one."""
    out, at = [], path_id
    while at is not None:
        r = rows[at]
        out.append(", ".join((r["head"], r["rel"], r["tail"])))
        first, at = r["word"], r["parent_id"]
    return " --> ".join([first, *out[::-1]])


def test_paths_branch_and_meet(spark):
    """alpha leads to three, two of which lead to the same one, which branches again."""
    triples = [("alpha", "r", "b1"), ("alpha", "r", "b2"), ("b3", "r", "alpha"), ("b1", "to", "c"), ("c", "to", "b2"), ("b3", "own", "d"), ("c", "on", "e1"), ("e2", "on", "c"), ("e1", "back", "alpha"), ("f", "far", "e1"), ("stray", "r", "stray2")]
    rows, states, _ = _forest(spark, triples, [("q", "alpha"), ("none", "nothing here"), ("d", "stray")], max_depth=4)
    mine = {k: r for k, r in rows.items() if r["qid"] == "q"}
    assert len(mine) == 10 and all(r["path"] == _walked(mine, k) for k, r in mine.items())
    by = {(r["head"], r["tail"]): r for r in mine.values()}
    assert by["e1", "alpha"]["depth"] == 1 and by["f", "e1"]["depth"] == 2
    assert {by[x]["depth"] for x in (("b1", "c"), ("c", "b2"))} == {2} and by["c", "e1"]["ways"] == 1
    led = [by[x]["path_id"] for x in (("b1", "c"), ("c", "b2"), ("c", "e1"))]
    assert by["e2", "c"]["ways"] == 3 and by["e2", "c"]["parent_id"] == min(led)
    assert states == {"q": ("exhausted", 4), "none": ("exhausted", 1), "d": ("exhausted", 2)}


def test_long_chains_by_doubling(spark):
    triples = [(f"n{k}", "next", f"n{k + 1}") for k in range(9)]
    for depth in (2, 5):
        rows, states, _ = _forest(spark, triples, [("q", "n0")], max_depth=depth)
        assert sorted(r["path"] for r in rows.values()) == sorted(" --> ".join(["n0", *[f"n{j}, next, n{j + 1}" for j in range(k)]]) for k in range(1, depth + 1))
        assert states == {"q": ("open", depth)}


def test_pruned_triples_meet_stored_ones_in_another_spelling(spark):
    triples = [("The Cat's", "Likes", "milk"), ("the", "sits on", "mat"), ("cats", "likes", "milk"), ("dog", "likes", "milk")]
    said = [("q", "'THE CATS'", "'likes'", "Milk!", 9.0), ("q", "A", "Sits On", " mat ", 8.0), ("q", "dog", "hates", "milk", 10.0)]
    prune = lambda stored: spark.createDataFrame(said, "qid string, head string, rel string, tail string, score double")
    rows, _, _ = _forest(spark, triples, [("q", "cat mat likes")], prune, max_depth=1)
    # a stop word alone is as good as another; "the cats" isn't "cats"
    assert sorted((r["head"], r["seq"]) for r in rows.values()) == [("The Cat's", 1), ("the", 2)]


def test_pruning_model_sees_blocks(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(prompts):
        for p in prompts:
            assert p.count("\n") <= 90
            seen.add(p.count("\n"))
        return prompts.map(lambda p: "\n".join(x.replace("x", "X") + " (Score: 8)" for x in p.split("\n")[1:]))

    triples = [("alpha", "has", f"x{k:03d}") for k in range(200)]
    asked = spark.createDataFrame([("q", "what?")], "qid string, question string")
    rows, _, _ = _forest(spark, triples, [("q", "alpha")], M.pruner(asked, model), max_depth=1)
    assert len(rows) == 200 and seen.value >= 200


def test_answers_stop_and_clues_go_on(spark):
    triples = [("alpha", "r", "beta"), ("beta", "r", "gamma"), ("delta", "is", "answer"), ("one", "r", "two")]

    def reason(found, asked):
        got = found.groupBy("qid").agg(F.max(F.col("tail") == "answer").alias("stop"))
        stop = F.coalesce("stop", F.lit(False))
        return asked.join(got, "qid", "left").select("qid", stop.alias("stop"), F.when(stop, "it").alias("answer"), F.when((F.col("qid") == "q") & ~stop, F.array(F.lit("delta"))).otherwise(F.array().cast("array<string>")).alias("clues"))

    rows, states, tables = _forest(spark, triples, [("q", "alpha"), ("p", "one")], max_depth=3, reason=reason)
    assert states == {"q": ("answered", 2), "p": ("exhausted", 2)}
    context = {r["qid"]: r["context"] for r in P.path_context(*tables, 3).collect()}
    assert context["q"] == "Answer: it\n\nKG context:\ndelta --> delta, is, answer\nalpha --> alpha, r, beta --> beta, r, gamma\n"
    assert context["p"] == "KG context:\none --> one, r, two\n"


def test_beams_say_what_became_of_each_question(spark):
    triples = [("a", "r1", "b"), ("b", "r2", "c"), ("c", "r3", "d"), ("d", "r4", "e"), ("lone", "r9", "lone"), ("zero", "z", "none"), ("s", "r1", "stop")]
    topics = spark.createDataFrame([(x, x) for x in ("a", "lone", "zero", "s", "missing")], "qid string, entity string")
    graph = spark.createDataFrame(triples, "head string, rel string, tail string")
    one = lambda q, x: F.when(x == "z", 0.0).otherwise(1.0)
    history, states = G.beam_history(graph, topics, one, one, stop=lambda beam: beam.filter("candidate = 'stop'"))
    assert {r["qid"]: (r["status"], r["depth"]) for r in states.collect()} == {"a": ("open", 3), "lone": ("exhausted", 2), "zero": ("exhausted", 1), "s": ("answered", 1), "missing": ("exhausted", 1)}
    rows = history.collect()
    assert {(r["qid"], r["depth"], r["entity"]) for r in rows if r["candidate"] == G.FINISH} == {("lone", 2, "lone"), ("zero", 1, "zero"), ("missing", 1, "missing")}
    plain = G.beam_search(graph, topics, one, one, stop=lambda beam: beam.filter("candidate = 'stop'"))
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r) for r in rows if r["candidate"] != G.FINISH)
    none = lambda q, x: F.when(x == "none", 0.0).otherwise(1.0)
    assert {r["qid"]: r["status"] for r in G.beam_history(graph, topics, none, none)[1].collect()}["zero"] == "pruned"


def test_neighbours_pruned_and_followed(spark):
    triples = [("a", "to", f"n{k}") for k in range(9)] + [(f"n{k}", "to", f"m{k}") for k in range(9)] + [("b", "drop", "c"), ("d", "to", "d")]
    topics = spark.createDataFrame([(x, x) for x in ("a", "b", "d", "missing")], "qid string, entity string")
    steps, states = G.neighbour_walk(spark.createDataFrame(triples, "head string, rel string, tail string"), topics, lambda r: r.filter("relation = 'to'"), max_depth=3, max_entities=4)
    assert {r["qid"]: (r["status"], r["depth"]) for r in states.collect()} == {"a": ("open", 3), "b": ("pruned", 1), "d": ("exhausted", 1), "missing": ("exhausted", 1)}
    at = lambda depth: {(r["entity"], r["candidate"]) for r in steps.collect() if r["qid"] == "a" and r["depth"] == depth}
    assert at(1) == {("a", f"n{k}") for k in range(9)}
    assert at(2) == {(f"n{k}", x) for k in range(4) for x in ("a", f"m{k}")}
    assert at(3) == {(f"m{k}", f"n{k}") for k in range(4)}


def test_prompts_of_one_question_are_answered_in_many_tasks(spark):
    from pyspark import TaskContext

    seen = spark.sparkContext.accumulator(0)

    def model(prompts):
        seen.add(1 << TaskContext.get().partitionId())
        return prompts.map(lambda p: "\n".join(x + " (Score: 9)" for x in p.split("\n")[1:]))

    stored = spark.range(2000).select(F.lit("q").alias("qid"), F.concat(F.lit("h"), "id").alias("head"), F.lit("r").alias("rel"), F.lit("t").alias("tail"))
    asked = spark.createDataFrame([("q", "what?")], "qid string, question string")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        kept = M.pruner(asked, model)(stored).collect()
    finally:
        for n, x in zip(names, before, strict=True):
            spark.conf.set(n, x)
    assert sorted(r["head"] for r in kept) == sorted(f"h{k}" for k in range(2000))
    # accumulators add: of one task alone, or of one batch of each of several
    assert bin(seen.value).count("1") > 1


def test_hits_of_a_question_come_once_and_are_not_shuffled(spark):
    triples = [("Red_ring", "is", "red"), ("ring", "has", "red ring"), ("blue", "is", "ring"), ("red", "meets", "Ring"), ("x", "y", "z")]
    graph = spark.createDataFrame(triples, "head string, rel string, tail string")
    given = [("q", "red", 7, 1), ("q", "ring", 5, 2), ("p", "ring", 9, 1), ("p", "is", 9, 3)]
    frontier = spark.createDataFrame(given, "qid string, word string, parent_id long, ways long")
    low = lambda x: x.replace("_", " ").lower()
    for exact in (False, True):
        wanted = {}
        for q, w, parent, ways in given:
            for t in triples:
                if any(w == low(x) for x in (t[0], t[2])) if exact else any(w in low(x) for x in t):
                    wanted[q, *t] = min(wanted.get((q, *t), (99,)), (parent, w, parent, ways))
        hits = G.question_hits(frontier, graph, exact)
        rows = [tuple(r) for r in hits.collect()]
        assert sorted((*r[:4], tuple(r[4])) for r in rows) == sorted((*k, v) for k, v in wanted.items())
        if not exact:
            assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
    many = spark.createDataFrame([("q", f"w{k}", None, 0) for k in range(G.FEW_WORDS)] + [("q", "red", None, 0), ("q", "ring", None, 0)], frontier.schema)
    assert sorted((*r[:4], r["by"]["word"]) for r in G.question_hits(many, graph).collect()) == sorted(("q", *t, "red" if any("red" in low(x) for x in t) else "ring") for t in triples[:4])


def test_replies_are_read_as_columns_read_them(spark):
    import pyarrow as pa

    from skein.functions import text as T

    replies = ["('A B', r, \"c's\") (Score: 9)\n(a, b) (Score: 9)\n(a, b, c, d) (Score: 10)", "(x, y , 'z)** (Score: 8) tail ( a , '' ,b ) (Score: 12)", "(x\ny, b, c) (Score: 9) (q, r, s) (Score: 7)", "((n), m, o) (Score: 08) (k, l, m) (Score: 9)", "", None, "(a,b,c)(Score: 9) (, ,) (Score: 9)"]
    rows = spark.createDataFrame(list(enumerate(replies)), "qid long, response string")
    wanted = rows.select("qid", F.inline(T.parse_scored_triples(F.coalesce("response", F.lit("")), 8))).collect()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(replies))), pa.array(replies)], names=["qid", "response"])
    found = [tuple(r.values()) for b in M._scored_triples(8, iter([batch])) for r in b.to_pylist()]
    assert found and found == [tuple(r) for r in wanted]
