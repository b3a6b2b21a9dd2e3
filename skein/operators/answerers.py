"""Answering questions over a document: by worked examples in text, and by code with a second try that remembers the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from .models import Model, complete, template
from .sampling import draw_key, random_sample

YES_NO, SPAN = "yes/no", "span"
_NONE = "array<string>"


def said(role: str, text: Column) -> Column:
    """A turn of a chat as text."""
    return F.concat(F.lit(f"{role}: "), text)


def _reminder(kind: str, conditions: bool) -> str:
    return template("remind", kind) + (" " + template("remind_conditions") if conditions else "")


def _question(question: Column, document: Column, kind: str, rationales: bool, conditions: bool) -> Column:
    """What a human asks: question, document, what an answer should be."""
    lead = template("step_by_step") if rationales else "Answer:"
    return F.format_string("Question: %s\nDocument: %s\n%s %s", question, document, F.lit(_reminder(kind, conditions)), F.lit(lead))


def _reply(answer: Column, evidence: Column, conditions: Column, with_rationales: bool, with_conditions: bool) -> Column:
    """What an assistant says in an example: the evidence, the answer, and its conditions if it has any."""
    out = F.concat(F.array_join(evidence, "\n"), F.lit("\nAnswer: "), answer) if with_rationales else answer
    if with_conditions:
        out = F.when(F.size(conditions) > 0, F.concat(out, F.lit(" . Conditions: "), F.array_join(conditions, "\n"))).otherwise(out)
    return out


def worked_examples(train: DataFrame, kind: str, n: int, seed: int = 1, rationales: bool = True, conditions: bool = True) -> DataFrame:
    """One row (kind, block): n drawn examples of a kind as turns of a chat, in a drawn order.

    train (id, question, document, answer, conditions, evidence). yes/no takes n // 2 with
    each answer, span takes n with neither. A block holds n examples whatever the size of
    train; an empty one is the empty text.
    """
    if kind == YES_NO:
        some = random_sample(train.filter("answer = 'yes'"), n // 2, "id", seed).union(random_sample(train.filter("answer = 'no'"), n // 2, "id", seed))
    else:
        some = random_sample(train.filter("answer NOT IN ('yes', 'no')"), n, "id", seed)
    human = said("human", _question(F.col("question"), F.col("document"), kind, rationales, conditions))
    assistant = said("assistant", _reply(F.col("answer"), F.col("evidence"), F.col("conditions"), rationales, conditions))
    listed = F.array_sort(F.collect_list(F.struct(draw_key(seed + 1, "id").alias("d"), "id", F.concat(human, F.lit("\n"), assistant, F.lit("\n")).alias("x"))))
    return some.agg(F.lit(kind).alias("kind"), F.array_join(F.transform(listed, lambda e: e["x"]), "").alias("block"))


def text_prompts(rows: DataFrame, train: DataFrame, n_yes_no: int = 4, n_span: int = 4, seed: int = 1, rationales: bool = True, conditions: bool = True) -> DataFrame:
    """rows (question, document, qtype, ...) with `prompt`: the task, worked examples of the row's kind, the question. Any type that isn't yes/no is a span."""
    blocks = worked_examples(train, YES_NO, n_yes_no, seed, rationales, conditions).union(worked_examples(train, SPAN, n_span, seed, rationales, conditions))
    kind = F.when(F.col("qtype") == YES_NO, YES_NO).otherwise(SPAN)
    rows = rows.withColumn("_kind", kind).join(F.broadcast(blocks), F.col("_kind") == F.col("kind"))  # two rows of a fixed number of examples
    task, asked = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in (YES_NO, SPAN):
        task = F.when(F.col("_kind") == k, said("system", F.lit(template("answer_task") % _reminder(k, conditions)))).otherwise(task)
        asked = F.when(F.col("_kind") == k, said("human", _question(F.col("question"), F.col("document"), k, rationales, conditions))).otherwise(asked)
    return rows.withColumn("prompt", F.concat(task, F.lit("\n"), F.col("block"), asked)).drop("_kind", "kind", "block")


def text_answers(rows: DataFrame, train: DataFrame, model: Model, n_yes_no: int = 4, n_span: int = 4, seed: int = 1, rationales: bool = True, conditions: bool = True) -> DataFrame:
    """rows with prompt, response, error and `answers`, array<struct(answer, conditions)>; null where the model failed. See text_prompts()."""
    out = complete(text_prompts(rows, train, n_yes_no, n_span, seed, rationales, conditions), F.col("prompt"), model)
    parsed = T.parse_text_answer("response", F.col("qtype") == YES_NO, rationales, conditions)
    return out.withColumn("answers", F.when(F.col("response").isNotNull(), parsed))


def code_prompt(question_code: Column, document_code: Column, question: Column, reminder: Column) -> Column:
    return F.concat_ws("\n", question_code, document_code, F.concat(F.lit("# Question: "), question), reminder)


def code_answers(rows: DataFrame, model: Model, remember: bool = False) -> DataFrame:
    """rows (question_code, document_code, question, qtype, ...) with response, response2, error and `answers`.

    A yes/no question whose answer is neither is asked once more if `remember` is set,
    with the first prompt and reply ahead, and only such rows are: the first replies are
    written, so no prompt is sent twice. Where it stays undecided both answers stand,
    with what conditions there are. Rows the model failed on have an error and null
    answers, those it failed on at the second try their first answers.
    """
    yes_no = F.col("qtype") == YES_NO
    reminder = F.when(yes_no, template("remind_code", YES_NO)).otherwise(template("remind_code", SPAN))
    parts = (F.col("question_code"), F.col("document_code"), F.col("question"))
    first = complete(rows.withColumn("_first", code_prompt(*parts, reminder)), F.col("_first"), model)
    if not remember:
        return _answered(first.drop("_first").withColumn("response2", F.lit(None).cast("string")), yes_no)
    first = written(first)
    unsure = yes_no & F.col("response").isNotNull() & (F.size(T.parse_code_answer("response", F.lit(True))) > 1)
    again = F.format_string(template("again"), F.col("response"))
    second = F.concat_ws("\n", said("human", F.col("_first")), said("assistant", F.col("response")), said("human", code_prompt(*parts, again)))
    retried = complete(first.filter(unsure).withColumnRenamed("error", "_error"), second, model, "response2").drop("error").withColumnRenamed("_error", "error")
    sure = first.filter(~F.coalesce(unsure, F.lit(False))).withColumn("response2", F.lit(None).cast("string"))
    return _answered(sure.unionByName(retried).drop("_first"), yes_no)


def _answered(out: DataFrame, yes_no: Column) -> DataFrame:
    text = F.coalesce("response2", "response")
    return out.withColumn("answers", F.when(text.isNotNull(), T.parse_code_answer(text, F.coalesce(yes_no, F.lit(False)))))
