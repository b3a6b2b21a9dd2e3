"""Model steps: any completion model is a function from prompts to texts, given from outside."""

from __future__ import annotations

import argparse
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import MISSING, dataclass, fields
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from .sampling import draw_key, random_sample

Model = Callable[[pd.Series], pd.Series]

#: Questions up to which they are sent to all tasks.
SENT_ROWS = 1 << 16

#: Our own wording, by name, question type and number of examples; blanks are filled with format_string.
TEMPLATES = {
    ("answer", "yes/no", 0): "Context:\n%s\n\nQuestion: %s\nReply `Answer: yes` or `Answer: no`.",
    ("answer", "yes/no_conditional", 0): "Context:\n%s\n\nQuestion: %s\nReply `Answer: yes` or `Answer: no`, then `Conditions:` and one condition a line.",
    ("answer", "span", 0): "Context:\n%s\n\nQuestion: %s\nReply `Answer:` and the shortest phrase that answers.",
    ("answer", "span_conditional", 0): "Context:\n%s\n\nQuestion: %s\nReply `Answer:` and a phrase, then `Conditions:` and one condition a line.",
    ("keywords", "any", 0): "List the keywords of this question, between commas, after `KEYWORDS:`.\n%s",
    ("prune_relations", "any", 0): "Of these relations of %s keep the %d that help most to answer `%s`, each as `NAME (Score: 0.5)`, scores adding up to 1.\n%s",
    ("score_entities", "any", 0): "Score how much each entity helps to answer `%s`, as decimals that add up to 1.\nRelation: %s\nEntities: %s",
    ("prune_triples", "any", 0): "Score each fact from 1 to 10 for `%s`, as `(a, b, c) (Score: 8)`.\n%s",
    ("reason", "any", 0): "Question: %s\nFacts: %s\nIf they are enough reply {Yes} and {the answer}, otherwise {No} and what to look for in braces.",
    ("reason_alone", "any", 0): "Question: %s\nNo facts were found. Name in braces what to look for.",
    ("answer_alone", "any", 0): "Question: %s\nAnswer from what you know, as `Answer:` and a short phrase.",
    ("keep_relations", "any", 0): "Relations of %s, one a line:\n%s\nRepeat those that help to answer `%s`, one a line.",
    ("filter_paths", "any", 0): "Question: %s\nPaths: %s\nRepeat the facts that are enough to answer, as `(a, b, c)`, one a line.",
    ("extract", "any", 0): "Write the facts of this text as `(subject, predicate, object)`, one a line, at most %d.\n%s",
    ("extract_refine", "any", 0): "Text: %s\nFacts so far: %s\nAdd facts that are missing, in the same form.",
    ("classify", "any", 0): "Is the answer to this question a span of text, or yes or no? %s",
    ("doc_to_code", "any", 4): "%s\n\n# Document\n%s\n# Code\n",
    ("question_to_code", "any", 4): "%s\n\n# Question\n%s\n# Code\n",
    ("code_to_text", "any", 4): "%s\n\n# Code\n%s\n# Text, with every condition in words\n",
    ("judge_correctness", "any", 0): "Question: %s\nReference: %s\nAnswer: %s\nRate the answer from 1 to 5, the number alone in the first line.",
    ("judge_relevancy", "any", 0): "Question: %s\nAnswer: %s\nContext:\n%s\nDo question and answer fit the context? YES or NO.",
    ("judge_faithfulness", "any", 0): "Statement: %s\nContext:\n%s\nDoes the context bear the statement out? YES or NO.",
    ("passage", "any", 0): "Write a passage that answers this question.\n%s",
    ("answer_task", "any", 0): "You answer questions about a document. %s Examples come first.",
    ("remind", "yes/no", 0): "Say yes or no and nothing else, even if you aren't sure.",
    ("remind", "span", 0): "Say a short span of the document and nothing else.",
    ("remind_conditions", "any", 0): "If sentences of the document must hold for the answer, write them after it as conditions.",
    ("step_by_step", "any", 0): "Go step by step:",
    ("remind_code", "yes/no", 0): "# Answer with `# Answer: yes` or `# Answer: no`, then conditions as `\t if: `",
    ("remind_code", "span", 0): "# Answer with `# Answer: ` and a span of the comments, then conditions as `\t if: `",
    ("again", "any", 0): "# Your answer `%s` is neither yes nor no. Answer with `# Answer: yes` or `# Answer: no` and nothing else but conditions as `\t if: `",
    ("code_answer", "any", 0): "%s\n%s\n# Answer with `# Answer: ` and conditions as `\\t if: `\n",
}


def template(name: str, qtype: str = "any", shots: int = 0) -> str:
    """A template by name; its type and then the number of examples fall back to any and 0."""
    for key in ((name, qtype, shots), (name, qtype, 0), (name, "any", shots), (name, "any", 0)):
        if key in TEMPLATES:
            return TEMPLATES[key]
    raise ValueError(f"no template {name} for {qtype} with {shots} examples")


def templates(spark) -> DataFrame:
    return spark.createDataFrame([(n, q, s, b) for (n, q, s), b in TEMPLATES.items()], "name string, qtype string, shots int, body string")


def answer_prompt(context: Column, question: Column, qtype: Column) -> Column:
    """The answer template of each row's type, filled in."""
    out = F.lit(None).cast("string")
    for kind in ("span", "span_conditional", "yes/no", "yes/no_conditional"):
        out = F.when(qtype == kind, F.format_string(template("answer", kind), context, question)).otherwise(out)
    return F.coalesce(out, F.format_string(template("answer", "span"), context, question))


def complete(df: DataFrame, prompt: Column, model: Model, name: str = "response", tries: int = 3, wait: float = 0.0, read: tuple[Callable, str | StructType] | None = None) -> DataFrame:
    """df with the model's texts and an `error` column: failures are retried, then kept as data, and never fail the task.

    Batches go to the model as pandas series; each worker holds one copy of it. A batch
    that fails is asked row by row, `tries` times each, so an error is its own row's alone.
    `read`, if given, makes other batches of these where they are, and says their schema.
    """
    columns = df.columns
    schema = df.withColumn("_prompt", prompt)
    out = schema.drop("_prompt").withColumns({name: F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema

    def ask(prompts: pd.Series) -> tuple[list, str | None]:
        try:
            return list(model(prompts)), None
        except Exception as e:  # the model's own failures are data
            return [None] * len(prompts), f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column("_prompt").to_pandas()
            answers, error = ask(prompts)
            errors = [None] * len(prompts)
            for k in range(len(prompts) if error else 0):
                for attempt in range(tries):
                    (answers[k],), errors[k] = ask(prompts.iloc[k : k + 1])
                    if errors[k] is None:
                        break
                    time.sleep(wait * 2**attempt)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*columns, name, "error"])

    return schema.mapInArrow(run, out) if read is None else schema.mapInArrow(lambda batches: read[0](run(batches)), read[1])


def refine(df: DataFrame, text: str, model: Model, prompts: int = 3, most: int = 30) -> DataFrame:
    """Triples by several prompts: each gets what the one before gave; parsed triples of the last in `triples`."""
    out = complete(df, F.format_string(template("extract"), F.lit(most), F.col(text)), model, "facts").drop("error")
    for _ in range(prompts - 1):
        out = complete(out.withColumnRenamed("facts", "_facts"), F.format_string(template("extract_refine"), F.col(text), F.col("_facts")), model, "facts").drop("error", "_facts")
    return out.withColumn("triples", T.parse_triplets("facts"))


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, facts) of lines (qid, _block, line) in which those of a block follow each other: a row for each block."""
    held = None
    for b in chain(batches, (None,)):
        if b is not None:
            held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        if held is None or not len(held):
            continue
        begins = np.ones(len(held), dtype=bool)
        begins[1:] = False
        for c in ("qid", "_block"):
            values = held.column(c).chunk(0)
            begins[1:] |= np.asarray(pc.not_equal(values[1:], values[:-1]))
        first = np.flatnonzero(begins)
        upto = len(held) if b is None else first[-1]
        first = first[first < upto]
        if len(first):
            offsets, line = np.append(first, upto).astype(np.int32), held.column("line").chunk(0)
            yield pa.RecordBatch.from_arrays([held.column("qid").chunk(0).take(pa.array(first)), pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), line), "\n")], names=["qid", "facts"])
        held = held.slice(upto)


#: What T.parse_scored_triples() looks for, in lines and digits as Java knows them.
_SCORED = re.compile("\\(([^\n\r\u0085\u2028\u2029]*?)\\)(?:\\*\\*)? \\(Score: ([0-9]+)\\)")


def _scored_triples(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, head, rel, tail, score) as T.parse_scored_triples() reads them of each response, where the model's texts are: as a Column it costs ten times as much."""
    for b in batches:
        rows, found = [], []
        for n, text in enumerate(b.column("response").to_pylist()):
            for inner, score in _SCORED.findall(text or ""):
                if int(score) >= least and inner.count(",") == 2:
                    rows.append(n)
                    found.append((*[x.strip(" ").strip("'\"") for x in inner.split(",")], int(score)))
        sides = zip(*found, strict=True) if found else ((), (), (), ())
        head, rel, tail, score = sides
        yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(rows, pa.int64())), *[pa.array(x, pa.string()) for x in (head, rel, tail)], pa.array(score, pa.int32())], names=["qid", "head", "rel", "tail", "score"])


def pruner(questions: DataFrame, model: Model, least: int = 8, block: int = 40) -> Callable[[DataFrame], DataFrame]:
    """What path_forest asks at each depth: which triples (qid, head, rel, tail) a model scores at least `least`, with its own spelling and score.

    questions (qid, question). A question's triples go to the model in prompts of about
    `block` triples, dealt by hash, so that no prompt and no task grows with a hub.
    Up to SENT_ROWS questions are sent to the prompts: dealt by question, all prompts of
    one would be answered in one task.
    """
    questions = questions.select("qid", "question")
    sent = F.broadcast if questions.limit(SENT_ROWS + 1).count() <= SENT_ROWS else lambda df: df

    def kept(stored: DataFrame) -> DataFrame:
        asked_of = stored.groupBy("qid").agg(F.ceil(F.count("*") / block).alias("_blocks"))
        blocks = sent(asked_of.join(questions.select("qid"), "qid", "left_semi"))
        dealt = stored.join(blocks, "qid").withColumn("_block", F.pmod(F.xxhash64("head", "rel", "tail"), F.col("_blocks")))
        line = F.concat(F.lit("("), F.concat_ws(", ", "head", "rel", "tail"), F.lit(")"))
        # sorted by a hash of the prompt, which tells rows apart without their texts, and a prompt's lines by themselves
        lines = dealt.select("qid", "_block", F.xxhash64("qid", "_block").alias("_at"), line.alias("line")).repartition("qid", "_block").sortWithinPartitions("_at", "qid", "_block", "line")
        facts = lines.select("qid", "_block", "line").mapInArrow(_joined_lines, StructType([stored.schema["qid"], StructField("facts", StringType())]))
        asked = facts.join(sent(questions), "qid")
        prompt = F.format_string(template("prune_triples"), F.col("question"), F.col("facts"))
        sides = [StructField(n, StringType()) for n in ("head", "rel", "tail")]
        return complete(asked, prompt, model, read=(partial(_scored_triples, least), StructType([stored.schema["qid"], *sides, StructField("score", IntegerType())])))

    return kept


def reasoner(questions: DataFrame, model: Model) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """What traverse_with_clues asks after each depth: a model's word on the triples found, or on the question alone where there are none.

    questions (qid, question). A first {Yes} stops a question that has triples, and the
    text in the next braces is its answer; otherwise the texts in braces are clues. A
    reply that is missing neither stops nor gives clues.
    """

    def said(found: DataFrame, asked: DataFrame) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(", ", "head", "rel", "tail").alias("line"))))
        facts = found.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("facts"))
        rows = asked.join(questions.select("qid", "question"), "qid").join(facts, "qid", "left")
        alone = F.format_string(template("reason_alone"), F.col("question"))
        prompt = F.when(F.col("facts").isNull(), alone).otherwise(F.format_string(template("reason"), F.col("question"), F.col("facts")))
        text = F.coalesce("response", F.lit(""))
        stop = F.col("facts").isNotNull() & T.is_yes(T.first_brace(text))
        answer = F.coalesce(F.try_element_at(T.braces(text), F.lit(1)), F.lit(""))
        none = F.array().cast("array<string>")
        return complete(rows, prompt, model).select("qid", stop.alias("stop"), F.when(stop, answer).alias("answer"), F.when(stop, none).otherwise(T.braces(text)).alias("clues"))

    return said


def answer_chains(questions: DataFrame, chains: DataFrame, model: Model) -> DataFrame:
    """(qid, ans_from, response, error): questions (qid, question, qtype) answered from their chains (qid, chains), or without a graph where they have none."""
    rows = questions.select("qid", "question", "qtype").join(chains.select("qid", "chains"), "qid", "left")
    alone = F.format_string(template("answer_alone"), F.col("question"))
    rows = rows.withColumn("ans_from", F.when(F.col("chains").isNull(), "model").otherwise("model+graph"))
    prompt = F.when(F.col("chains").isNull(), alone).otherwise(answer_prompt(F.col("chains"), F.col("question"), F.col("qtype")))
    return complete(rows, prompt, model).select("qid", "ans_from", "response", "error")


def demonstration(question_code: Column, document_code: Column, question: Column, answer: Column, reminder: Column | None = None, rationale: Column | None = None, conditions: Column | None = None) -> Column:
    """struct(prompt, reply) of a worked example in the form that parse_code_answer reads.

    A rationale, if given, stands as comment lines before the answer; conditions, if
    given, follow it, one a line, and a row without any has no mark of them.
    """
    mark = F.lit("# Reasons:" if rationale is not None else "# Answer:")
    prompt = F.concat_ws("\n", question_code, document_code, F.concat(F.lit("# Question: "), question), *([] if reminder is None else [reminder]), mark)
    reply = answer if rationale is None else F.concat(F.lit("# "), F.replace(rationale, F.lit("\n"), F.lit("\n# ")), F.lit("\n# Answer: "), answer)
    if conditions is not None:
        reply = F.concat(reply, F.array_join(F.transform(conditions, lambda c: F.concat(F.lit("\n\t if: "), c)), ""))
    return F.struct(prompt.alias("prompt"), reply.alias("reply"))


def evaluate(examples: DataFrame, judges: dict[str, Column], predict: Callable[[DataFrame], DataFrame] | None = None, contexts: str = "contexts") -> DataFrame:
    """(id, metric, score) of examples: predictions are made first if `predict` is given, then judged; a score is null where a row has no contexts."""
    judged = judge(examples if predict is None else predict(examples), judges, contexts)
    return judged.select("id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("score")) for n in judges])))


def judge(df: DataFrame, judges: dict[str, Column], contexts: str = "contexts") -> DataFrame:
    """df with a column for each judge; null where a row has no contexts."""
    return df.withColumns({n: F.when(F.size(F.col(contexts)) > 0, score) for n, score in judges.items()})


def model_judges(rows: DataFrame, model: Model, least: float = 4.0) -> DataFrame:
    """rows (question, reference, response, contexts) with correctness, passing, relevancy and faithfulness by a model's word.

    correctness is the number in the first line of its reply, passing whether it is at
    least `least`; the other two are 1 where it says yes and 0 otherwise, null where a row
    has no contexts, which isn't sent then. A reply without a number, and one that failed,
    scores null.
    """
    blank, contexts = F.lit(""), F.array_join("contexts", "\n")
    text = lambda c: F.coalesce(F.col(c), blank)
    out = complete(rows, F.format_string(template("judge_correctness"), text("question"), text("reference"), text("response")), model, "_said").drop("error")
    number = F.regexp_extract(F.element_at(F.split("_said", "\n"), 1), r"(\d+(?:\.\d+)?)", 1)
    out = out.withColumn("correctness", F.when(number != "", number.cast("double"))).withColumn("passing", F.col("correctness") >= least).drop("_said")
    some = F.coalesce(F.size("contexts") > 0, F.lit(False))
    prompts = {"relevancy": F.format_string(template("judge_relevancy"), text("question"), text("response"), contexts), "faithfulness": F.format_string(template("judge_faithfulness"), text("response"), contexts)}
    alone = out.filter(~some).withColumns({n: F.lit(None).cast("double") for n in prompts})
    asked = out.filter(some)
    for name, prompt in prompts.items():
        asked = complete(asked, prompt, model, "_said").drop("error").withColumn(name, F.contains(F.lower("_said"), F.lit("yes")).cast("double")).drop("_said")
    return asked.unionByName(alone)


def translate(rows: DataFrame, column: str, task: str, demos: DataFrame, model: Model, n: int = 4, seed: int = 1) -> DataFrame:
    """rows with prompt, response and error of a translation: doc_to_code, question_to_code or code_to_text.

    demos (id, given, made): n drawn ones stand ahead of what is to be translated, so a
    prompt has as many examples whatever the size of demos.
    """
    line = F.concat(F.col("given"), F.lit("\n"), F.col("made"))
    listed = F.array_sort(F.collect_list(F.struct(draw_key(seed, "id").alias("d"), "id", line.alias("x"))))
    block = random_sample(demos, n, "id", seed).agg(F.array_join(F.transform(listed, lambda s: s["x"]), "\n\n").alias("_block"), F.lit(task).alias("_task"))
    joined = rows.withColumn("_task", F.lit(task)).join(F.broadcast(block), "_task")  # one row of n examples
    joined = joined.withColumn("prompt", F.format_string(template(task, shots=4), F.col("_block"), F.col(column))).drop("_block", "_task")
    return complete(joined, F.col("prompt"), model)


def extract_linear(rows: DataFrame, text: str, model: Model) -> DataFrame:
    """rows with `triples` that an extraction model writes in its linear form; null where it failed."""
    out = complete(rows, F.col(text), model, "_said").drop("error")
    return out.withColumn("triples", F.when(F.col("_said").isNotNull(), T.linear_triples("_said"))).drop("_said")


def classify(df: DataFrame, question: str, model: Model) -> DataFrame:
    """df with `qtype` by a model's word: span if it says so, yes/no otherwise."""
    out = complete(df, F.format_string(template("classify"), F.col(question)), model, "_kind")
    return out.withColumn("qtype", F.when(F.contains(F.lower("_kind"), F.lit("span")), "span").otherwise("yes/no")).drop("_kind")


def few_shots(demos: DataFrame, by: str, order: str, question: str, answer: str) -> DataFrame:
    """(by, block): the examples of each group as one text, in order."""
    line = F.concat(F.lit("Question: "), F.col(question), F.lit("\nAnswer: "), F.col(answer))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x"))))
    return demos.groupBy(by).agg(F.array_join(F.transform(listed, lambda s: s["x"]), "\n\n").alias("block"))


@dataclass(frozen=True)
class RetrievalConfig:
    """What the command line of a run sets."""

    framework: str = "stub"
    model: str = "stub"
    embedding: str = "stub"
    mode: str = "hybrid"
    combine: str = "OR"
    documents: str = ""
    references: str = ""
    shots: int = 0
    top_k: int = 5
    rerank_n: int = 2
    retry: bool = False


@dataclass(frozen=True)
class BeamConfig:
    width: int = 3
    depth: int = 3
    max_length: int = 256
    retain: int = 5
    temperatures: tuple[float, float] = (0.4, 0.0)
    prune_tool: str = "llm"


@dataclass(frozen=True)
class EvaluationConfig:
    predictions: str
    references: str
    output: str
    missing: str = "skip"
    metrics: tuple[str, ...] = ("em", "conditional_em", "f1", "conditional_f1")


def config_from_args(kind, args: list[str]):
    """A config from `--name value` pairs; fields of several values take them one after another."""
    parser = argparse.ArgumentParser()
    for f in fields(kind):
        flag = f"--{f.name.replace('_', '-')}"
        default = f.default if f.default is not MISSING else None if f.default_factory is MISSING else f.default_factory()
        if isinstance(default, bool):
            parser.add_argument(flag, action="store_true")
        elif isinstance(default, tuple):
            parser.add_argument(flag, nargs="+", type=type(default[0]), default=default)
        else:
            parser.add_argument(flag, required=default is None, type=type(default) if isinstance(default, (int, float)) else str, default=default)
    found = vars(parser.parse_args(args))
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})
