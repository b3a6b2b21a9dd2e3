"""Scoring predictions against references, and reports."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

METRICS = ("em", "conditional_em", "f1", "conditional_f1")


def match(refs: DataFrame, preds: DataFrame, key: str, missing: str = "skip") -> DataFrame:
    """References with their predictions. missing: "skip" leaves references without one out, "zero" keeps them with null predictions."""
    if missing not in ("skip", "zero"):
        raise ValueError(f"missing is skip or zero, not {missing}")
    return refs.join(preds, key, "inner" if missing == "skip" else "left")


def rollup_means(scored: DataFrame, by: str, metrics: list[str], total: str = "joint") -> DataFrame:
    """Rows and means of each stratum, and of all rows as stratum `total`."""
    out = scored.rollup(by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics], F.grouping(by).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, total).otherwise(F.col(by)).alias(by), "n", *metrics)


def evaluate_files(predictions: DataFrame, references: DataFrame, key: str = "id", kind: str = "qtype") -> DataFrame:
    """(file, qtype, n, em, f1, precision, recall): means of every prediction file by question type, of the file (type joint) and of all files (file all, type joint).

    predictions (key, file, answer), references (key, answer, kind). All files are scored
    in one pass and summed at three levels at once. Predictions without a reference are
    left out, as are references that a file has no prediction for; a null type is the
    type `unknown`.
    """
    gold = references.select(key, F.col("answer").alias("_gold"), F.coalesce(kind, F.lit("unknown")).alias("qtype"))
    met = predictions.select(key, "file", F.col("answer").alias("_said")).join(gold, key)
    scored = met.select("file", "qtype", T.exact_match("_said", "_gold").alias("em"), T.multihop_scores("_said", "_gold").alias("_s")).select("file", "qtype", "em", "_s.*")
    metrics = ["em", "f1", "precision", "recall"]
    levels = scored.groupingSets([["file", "qtype"], ["file"], []], "file", "qtype").agg(F.grouping("file").alias("_f"), F.grouping("qtype").alias("_q"), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])
    return levels.select(F.when(F.col("_f") == 1, "all").otherwise(F.col("file")).alias("file"), F.when(F.col("_q") == 1, "joint").otherwise(F.col("qtype")).alias("qtype"), "n", *metrics)


def slice_means(scored: DataFrame, slices: Mapping[str, Column], metrics: list[str]) -> DataFrame:
    """(slice, n, metrics): means over slices that may overlap, 0 for an empty one, in one pass and without grouping rows."""
    cells = [x for name, on in slices.items() for x in (F.count_if(on).alias(f"{name}|n"), *[F.coalesce(F.avg(F.when(on, F.col(m))), F.lit(0.0)).alias(f"{name}|{m}") for m in metrics])]
    wide = scored.agg(*cells)
    rows = F.array(*[F.struct(F.lit(name).alias("slice"), F.col(f"`{name}|n`").alias("n"), *[F.col(f"`{name}|{m}`").alias(m) for m in metrics]) for name in slices])
    return wide.select(F.inline(rows))


def weighted_score(qtype: Column, f1: Column, similarity: Column, condition_similarity: Column) -> Column:
    """0.8 of the answer's score and 0.2 of the conditions' for conditional types, the answer's alone for others; yes/no is scored by F1, spans by similarity."""
    answer = F.when(F.startswith(qtype, F.lit("yes/no")), f1).otherwise(similarity)
    return F.when(F.contains(qtype, F.lit("conditional")), 0.8 * answer + 0.2 * condition_similarity).otherwise(answer)


def best_pair(predictions: Column, references: Column, score) -> Column:
    """The greatest score(prediction, reference) over all pairs of two arrays; null if either is empty."""
    return F.array_max(F.flatten(F.transform(predictions, lambda p: F.transform(references, lambda r: score(p, r)))))


def _field(name: str):
    return lambda x: x[name]


def _fields(name: str):
    return lambda row: F.transform(row, _field(name))


def one_reference_metric(predictions: Column, reference: Column) -> Column:
    """The four metrics against one reference answer: the best prediction of each, times the length discount; none counts as one blank."""
    none = F.array(F.struct(F.lit("").alias("answer"), F.array().cast("array<string>").alias("conditions")))
    given = F.when(F.size(predictions) == 0, none).otherwise(predictions)
    pairs = F.transform(given, lambda p: T.em_f1(p["answer"], p["conditions"], reference["answer"], reference["conditions"]))
    gamma = T.length_discount(F.size(given), F.lit(1))
    return F.struct(*[(F.array_max(F.transform(pairs, _field(m))) * gamma).alias(m) for m in METRICS])


def best_assignment(scores: list[list[float]]) -> float:
    """The greatest sum of scores[row][column] with each row on a column of its own (rows at most columns): Hungarian method."""
    n, m = len(scores), len(scores[0]) if scores else 0
    up, down, of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, used = [math.inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j] = True
            row, delta, to = of[j], math.inf, 0
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -scores[row - 1][k - 1] - up[row] - down[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    up[of[k]] += delta
                    down[k] -= delta
                else:
                    least[k] -= delta
            j = to
            if not of[j]:
                break
        while j:
            of[j] = of[way[j]]
            j = way[j]
    return sum(scores[of[k] - 1][k - 1] for k in range(1, m + 1) if of[k])


def assignment_metric(pairs: DataFrame, key: str = "id") -> DataFrame:
    """(key, metrics) of rows (key, predictions, answers), each array<struct(answer, conditions)>.

    Each metric is the greatest mean over references of an assignment of predictions to
    them, chosen for that metric alone, times exp(1 - predicted / references) where there
    are more predictions; fewer ones are filled up with blanks. Without references all
    are 1 if nothing is predicted and 0 otherwise. Scores of pairs are computed by Spark;
    only a row's matrix goes to the assignment, which never enumerates permutations.
    """
    blank = F.struct(F.lit("").alias("answer"), F.array().cast("array<string>").alias("conditions"))
    short = F.greatest(F.size("answers") - F.size("predictions"), F.lit(0))
    given = pairs.withColumn("_p", F.concat("predictions", F.array_repeat(blank, short)))
    cells = F.transform("answers", lambda r: F.transform("_p", lambda p: T.em_f1(p["answer"], p["conditions"], r["answer"], r["conditions"])))
    ready = given.withColumn("_cells", cells).select(F.col(key).alias("key"), F.size("answers").alias("refs"), F.size("predictions").alias("preds"), *[F.transform("_cells", _fields(m)).alias(m) for m in METRICS])

    def assign(batches):
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            out: list[list[float]] = []
            for refs, preds, *matrices in zip(*columns[1:], strict=True):
                if not refs:
                    out.append([float(not preds)] * len(METRICS))
                else:
                    gamma = math.exp(1 - max(preds, refs) / refs)
                    out.append([best_assignment(m) / refs * gamma for m in matrices])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[k] for o in out], pa.float64()) for k in range(len(METRICS))]], names=["key", *METRICS])

    kind = pairs.schema[key].dataType.simpleString()
    return ready.mapInArrow(assign, f"key {kind}, " + ", ".join(f"{m} double" for m in METRICS)).withColumnRenamed("key", key)


def usage_summary(usage: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Sum, mean, greatest and least of each column."""
    return usage.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("sum", F.sum), ("mean", F.avg), ("max", F.max), ("min", F.min))])


def metric_means(evaluations: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, mean_score) of wide evaluations; nulls, as without contexts, don't count."""
    return evaluations.unpivot([], metrics, "metric", "score").groupBy("metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean_score"))
