"""Similarity of texts by the vectors of their tokens: greedy matching, with the vectors given from outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Gives for texts a matrix each: a row for each token, all of one width, no rows for a text without tokens.
Encoder = Callable[[list[str]], list[np.ndarray]]
#: The three maxima of similarity_maxima().
MAXIMA = ("similarity", "with_conditions", "conditions_only")
#: Texts and bytes of their matrices from which a task forgets those that it doesn't need at once.
KEPT_TEXTS, KEPT_BYTES = 4096, 32 << 20
#: Bytes of the rows whose texts are encoded together, and cosines that are taken at once.
SLICE_BYTES, CELLS = 256 << 10, 1 << 20


def greedy_match(candidate: np.ndarray, reference: np.ndarray) -> tuple[float, float, float]:
    """(precision, recall, f1) of two token matrices: the mean over the candidate's tokens of their best cosine among the reference's, the same the other way round, and their harmonic mean.

    Without tokens on either side all are 1, without those of one side 0. A row of zeros has cosine 0.
    """
    if not len(candidate) or not len(reference):
        return (float(len(candidate) == len(reference)),) * 3
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    c, r = unit(candidate.astype(np.float64)), unit(reference.astype(np.float64)).T
    # some of the candidate's tokens at a time: two long texts have more pairs of tokens than a task has memory
    best, others, step = np.empty(len(candidate)), np.full(len(reference), -np.inf), max(1, CELLS // len(reference))
    for at in range(0, len(candidate), step):
        cosines = c[at : at + step] @ r
        best[at : at + step] = cosines.max(axis=1)
        np.maximum(others, cosines.max(axis=0), out=others)
    p, r = float(best.mean()), float(others.mean())
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


class _Scorer:
    """Scores of texts, each encoded once for as long as it is kept."""

    def __init__(self, encode: Encoder):
        self.encode, self.known = encode, {}

    def learn(self, texts: set[str]) -> None:
        if len(self.known) > KEPT_TEXTS or sum(m.nbytes for m in self.known.values()) > KEPT_BYTES:
            self.known = {t: m for t, m in self.known.items() if t in texts}
        new = sorted(texts - self.known.keys())
        self.known.update(zip(new, self.encode(new) if new else [], strict=True))

    def score(self, candidate: str, reference: str) -> tuple[float, float, float]:
        return greedy_match(self.known[candidate], self.known[reference])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of rows of about SLICE_BYTES, or one larger row: what is encoded at once doesn't grow with an Arrow batch."""
    for b in batches:
        first = size = 0
        for n in range(b.num_rows):
            size += sum(c.nbytes for c in b.slice(n, 1).columns)
            if size >= SLICE_BYTES:
                yield b.slice(first, n + 1 - first)
                first, size = n + 1, 0
        if first < b.num_rows:
            yield b.slice(first)


def token_similarity(pairs: DataFrame, candidate: str, reference: str, encode: Encoder) -> DataFrame:
    """pairs with `precision`, `recall` and `f1` of greedy matching of two text columns, compared after normalising; null texts are empty."""
    ready = pairs.withColumns({"_c": F.coalesce(T.normalize_answer(candidate), F.lit("")), "_r": F.coalesce(T.normalize_answer(reference), F.lit(""))})
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(encode)
        for b in _slices(batches):
            c, r = b.column("_c").to_pylist(), b.column("_r").to_pylist()
            scorer.learn({*c, *r})
            scores = np.array([scorer.score(x, y) for x, y in zip(c, r, strict=True)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in columns], *[pa.array(scores[:, k]) for k in range(3)]], names=[*columns, "precision", "recall", "f1"])

    out = pairs.withColumns({n: F.lit(None).cast("double") for n in ("precision", "recall", "f1")}).schema
    return ready.mapInArrow(run, out)


def _normalised(answers: Column) -> Column:
    """array<struct(answer, conditions, n)>: answers and joined conditions as they are compared, and how many conditions there were."""
    one = lambda a: F.struct(F.coalesce(T.normalize_answer(a["answer"]), F.lit("")).alias("answer"), F.coalesce(T.normalize_answer(F.array_join(a["conditions"], " ")), F.lit("")).alias("conditions"), F.coalesce(F.size(a["conditions"]), F.lit(0)).alias("n"))
    return F.transform(F.coalesce(answers, F.array().cast("array<struct<answer:string,conditions:array<string>>>")), one)


def similarity_maxima(pairs: DataFrame, encode: Encoder, key: str = "id") -> DataFrame:
    """(key, similarity, with_conditions, conditions_only) of rows (key, predictions, answers), each array<struct(answer, conditions)>.

    Every prediction is compared with every answer, and each of the three is the greatest
    over all pairs by itself: the F of the answers' texts; the mean of it and the F of
    the conditions, joined; the latter alone. An answer without conditions adds 0 to the
    last two, a prediction without some where the answer has them counts 0 for them.
    Without answers all are 1 if nothing is predicted and 0 otherwise. Texts are encoded
    once a task, whatever the number of pairs; null lists are empty.
    """
    kind = pairs.schema[key].dataType.simpleString()
    ready = pairs.select(F.col(key).alias("key"), _normalised(F.col("predictions")).alias("p"), _normalised(F.col("answers")).alias("a"))

    def best(scorer: _Scorer, predictions: list[dict], answers: list[dict]) -> tuple[float, float, float]:
        if not answers:
            return (float(not predictions),) * 3
        top = [0.0, 0.0, 0.0]
        for a in answers:
            for p in predictions:
                f = scorer.score(p["answer"], a["answer"])[2]
                scores = [f, 0.0, 0.0]
                if a["n"]:
                    c = scorer.score(p["conditions"], a["conditions"])[2] if p["n"] else 0.0
                    scores = [f, (f + c) / 2, c]
                top = [max(x, y) for x, y in zip(top, scores, strict=True)]
        return tuple(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(encode)
        for b in _slices(batches):
            rows = list(zip(b.column("p").to_pylist(), b.column("a").to_pylist(), strict=True))
            scorer.learn({x[part] for p, a in rows for x in (*p, *a) for part in ("answer", "conditions")})
            found = np.array([best(scorer, p, a) for p, a in rows]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(found[:, k]) for k in range(3)]], names=["key", *MAXIMA])

    return ready.mapInArrow(run, f"key {kind}, " + ", ".join(f"{m} double" for m in MAXIMA)).withColumnRenamed("key", key)
