import itertools

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import answerers as A

ROWS = "id long, question_code string, document_code string, question string, qtype string"


def _model(calls, log=None):
    """Names say what is replied at each try; made here, so that workers get it by value."""

    def model(prompts):
        out = []
        for p in prompts:
            calls.add(1)
            name = p.split("# Question: ")[1].split("\n")[0]
            tries = name.split("/")
            said = tries[min(p.count("assistant: "), len(tries) - 1)]
            if said == "fail":
                raise ValueError("down")
            out.append(f"# Answer: {said}\n\t if: c")
        return out

    return model


def test_only_undecided_rows_are_asked_again(spark):
    calls = spark.sparkContext.accumulator(0)
    names = [("yes", "yes/no"), ("maybe/no", "yes/no"), ("maybe/still", "yes/no"), ("maybe/no", "span"), ("No", "yes/no"), ("maybe/fail", "yes/no"), ("x", None)]
    rows = spark.createDataFrame([(n, "q", "d", name, kind) for n, (name, kind) in enumerate(names)], ROWS).repartition(7)
    found = {r["id"]: r for r in A.code_answers(rows, _model(calls), remember=True).collect()}
    answers = lambda n: [a["answer"] for a in found[n]["answers"]]
    assert [answers(n) for n in range(7)] == [["yes"], ["no"], ["yes", "no"], ["maybe"], ["No"], ["yes", "no"], ["x"]]
    assert {n for n in found if found[n]["response2"] is not None} == {1, 2} and all(r["error"] is None for r in found.values())
    # seven first tries, three second ones of which one fails: its batch and then three tries of its own
    assert calls.value == 7 + 2 + 4


def test_what_failed_at_first_isnt_asked_again(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(1, "q", "d", "fail/yes", "yes/no"), (2, "q", "d", "maybe", "yes/no")], ROWS).repartition(2)
    found = {r["id"]: r for r in A.code_answers(rows, _model(calls), remember=True).collect()}
    assert found[1]["answers"] is None and "down" in found[1]["error"] and len(found[2]["answers"]) == 2
    plain = {r["id"]: r for r in A.code_answers(rows, _model(calls)).collect()}
    assert plain[1]["answers"] is None and [a["answer"] for a in plain[2]["answers"]] == ["yes", "no"] and plain[2]["response2"] is None
    assert A.code_answers(rows.limit(0), _model(calls), remember=True).count() == 0


def _parsed(text, yes_no, rationales, conditions):
    answer, found = text, []
    if rationales and "Answer: " in answer:
        answer = answer.split("Answer: ")[1].strip()
    if conditions and "Conditions: " in answer:
        found = answer.split("Conditions: ")[1].strip().split("\n")
        answer = answer.split(". Conditions:")[0].strip()
    return [("yes", []), ("no", [])] if yes_no and answer.lower() not in ("yes", "no") else [(answer, found)]


def test_replies_to_text_prompts(spark):
    texts = ["yes", "No", "no.", "Answer: yes", "so\nAnswer:  Yes \n", "a Answer: b Answer: c", "Answer: no . Conditions: x\ny", "no . Conditions: x", "no. Conditions: ", "Conditions: x", "", "Answer: ", "é\nAnswer: yes\n. Conditions:  a \n b "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for yes_no, rationales, conditions in itertools.product([True, False], repeat=3):
        found = df.select("t", T.parse_text_answer("t", F.lit(yes_no), rationales, conditions).alias("a")).collect()
        assert [(r["t"], [(a["answer"], a["conditions"]) for a in r["a"]]) for r in found] == [(t, _parsed(t, yes_no, rationales, conditions)) for t in texts]


@pytest.mark.parametrize(("rationales", "conditions"), [(True, True), (False, False)])
def test_examples_of_a_kind(spark, rationales, conditions):
    kinds = ["yes", "no", "some span"]
    train = spark.createDataFrame([(n, f"q{n}", "d", kinds[n % 3], ["c"] if n % 2 else [], ["e"]) for n in range(60)], "id long, question string, document string, answer string, conditions array<string>, evidence array<string>").repartition(5)
    rows = spark.createDataFrame([(1, "why?", "doc", "yes/no"), (2, "what?", "doc", "span"), (3, "odd?", "doc", None)], "id long, question string, document string, qtype string")
    prompts = {r["id"]: r["prompt"] for r in A.text_prompts(rows, train, 6, 4, 7, rationales, conditions).collect()}
    turns = lambda k: [x for x in prompts[k].split("\n") if x.startswith(("assistant: ", "Answer: "))]
    assert prompts[1].count("human: ") == 7 and prompts[2].count("human: ") == 5 and prompts[3].replace("odd?", "what?") == prompts[2]
    assert sum("yes" in x for x in turns(1)) == 3 == sum("no" in x for x in turns(1)) and sum("some span" in x for x in turns(2)) == 4
    assert ("Conditions: c" in prompts[1] + prompts[2]) == conditions and ("assistant: e" in prompts[1]) == rationales
    again = {r["id"]: r["prompt"] for r in A.text_prompts(rows.repartition(3), train.repartition(2), 6, 4, 7, rationales, conditions).collect()}
    assert again == prompts
    none = A.text_prompts(rows, train.limit(0)).collect()
    assert len(none) == 3 and all(r["prompt"].count("human: ") == 1 for r in none)
