"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import small_batches, written

THRESHOLD = 0.7
#: Labelled rows, at most about, from which lexicon and trees are learned.
SAMPLE_ROWS = 12_000
#: A word or its beginning is learned if this share of toxic sample rows, and so many of them, have it, and it is
#: this many times as frequent there as in others.
LEXICON_SHARE, LEXICON_ROWS, LEXICON_TIMES, LEXICON_WORDS = 0.02, 4, 20.0, 400
#: Letters of a beginning: endings change with inflection.
STEM = 5
#: Words between an insult and a second person that still belong together.
NEAR = 5

#: Insults and second persons of the four languages.
INSULTS = frozenset(
    """asshole bastard bitch bullshit clown coward crap cretin degenerate disgusting dumb dumbass dumbest failure fool
    freak garbage idiot idiotic idiots imbecile jerk loser losers lowlife moron moronic morons pathetic pig
    psycho scum scumbag shit stupid trash ugly vermin vile worthless
    arschloch blöd depp dreck dumm dummkopf idioten miststück schwachkopf trottel versager wertlos widerlich
    abruti connard crétin débile imbécile minable merde ordure pourriture stupide
    asqueroso basura cabrón estúpido gilipollas idiota imbécil inútil mierda patético tonto""".split()
)
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
LEET = str.maketrans("013457@$!|+", "oleastasiit")

_WORD = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(.)\1+")
_AROUND = ".,;:!?\"'()[]"
_MARKS = "!?.,;:*#@$%&\"'()"
FEATURES = ("insult_density", "learned_density", "hidden_density", "second_person_density", "near_density", "hits", "window_hits", "capitals", "capital_words", "exclamations", "punctuation", "obfuscation", "log_words")


def _plain(token: str) -> str:
    """A token without its disguise: look-alikes as letters, separators gone, runs of a letter as one."""
    return _RUNS.sub(r"\1", "".join(c for c in token.strip(".,;:?\"'()[]").translate(LEET) if c.isalpha()))


_PLAIN_INSULTS = frozenset(_RUNS.sub(r"\1", w) for w in INSULTS)


def features(text: str | None, learned: Collection[str] = frozenset()) -> list[float]:
    """FEATURES of the whole text; a text without words has zeros."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    tokens = low.split()
    mixed = [t for t in tokens if not t.isalpha() and not t.strip(_AROUND).isalpha() and any(map(str.isalpha, t))]
    hidden = sum(_plain(t) in _PLAIN_INSULTS for t in mixed) + sum(_plain(s) in _PLAIN_INSULTS for s in _spelled(tokens))
    there = set(words)
    hits = [i for i, w in enumerate(words) if w in INSULTS] if not INSULTS.isdisjoint(there) else []
    second = [i for i, w in enumerate(words) if w in YOU] if not YOU.isdisjoint(there) else []
    near = sum(any(abs(second[k] - i) <= NEAR for k in (bisect_left(second, i) - 1, bisect_left(second, i)) if 0 <= k < len(second)) for i in hits)
    window = max((bisect_left(hits, i + 50) - k for k, i in enumerate(hits)), default=0)
    known = {w for w in there if w[:STEM] in learned} if learned else ()
    learned_hits = sum(w in known for w in words) if known else 0
    upper = _capitals(text, low)
    shouted = sum(len(t) > 1 and t.isupper() for t in text.split()) if upper else 0
    marks = sum(map(text.count, _MARKS))
    per = 100.0 / n
    return [len(hits) * per, learned_hits * per, hidden * per, len(second) * per, near * per, math.log1p(len(hits) + learned_hits + hidden), float(window), upper / max(len(text), 1), shouted * per, text.count("!") * per, marks / max(len(text), 1), len(mixed) * per, math.log1p(n)]


def _capitals(text: str, low: str) -> int:
    """Characters that lower case changes; where that also changes the length, upper-case ones."""
    if len(text) != len(low):
        return sum(map(str.isupper, text))
    return int(np.count_nonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)))


def _spelled(tokens: list[str]) -> list[str]:
    """Words spelled out: runs of four or more tokens of one character."""
    out, run = [], []
    for i in [i for i, t in enumerate(tokens) if len(t) == 1]:
        if run and i != run[-1] + 1:
            out.append(run)
            run = []
        run.append(i)
    return ["".join(tokens[i] for i in r) for r in [*out, run] if len(r) > 3]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)).cast("int")


def _sample(docs: DataFrame, labels: DataFrame, rows: int, learn: Callable[[Column], Column]) -> DataFrame:
    """(text, toxic) of about `rows` labelled rows at most, by hash of the id; conflicting labels count as toxic."""
    named = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic is not null")
    named = named.filter(learn(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    there = named.count()
    drawn = named.filter(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(there, 1))))
    # bounded by the sample's size, so it may be sent to all
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(ids.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"))


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Beginnings of words that many toxic rows of the sample have and few others: counted once for a row, added over partitions."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((w, toxic) for w in {w[:STEM] for w in _WORD.findall((text or "").lower())})
        at = list(seen)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([seen[k] if k[1] else 0 for k in part], pa.int64()), pa.array([0 if k[1] else seen[k] for k in part], pa.int64())], names=["word", "toxic", "clean"])

    toxic, clean = sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not toxic or not clean:
        return frozenset()
    words = sample.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    kept = words.filter((F.col("t") >= max(LEXICON_ROWS, LEXICON_SHARE * toxic)) & (F.col("t") / toxic >= LEXICON_TIMES * (F.col("c") + 0.5) / clean))
    return frozenset(r["word"] for r in kept.orderBy(F.desc("t"), "word").limit(LEXICON_WORDS).collect())


def _model(docs: DataFrame, labels: DataFrame, sample_rows: int, learn: Callable[[Column], Column]) -> tuple[frozenset[str], boosting.Boosted]:
    sample = _sample(docs, labels, sample_rows, learn)
    lexicon = learn_lexicon(sample)

    def measure(batches):
        for b in batches:
            rows = [features(t, lexicon) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    found = sample.mapInArrow(measure, "doc_id long, toxic int, x array<double>").toPandas().sort_values(["doc_id", "toxic"], kind="stable")
    y = (found["toxic"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        # nothing to learn from: insults decide
        knots = (np.array([0.0, math.log1p(1), math.log1p(3)]), np.array([0.05, 0.6, 0.95]))
        steps = [boosting.Tree(np.array([5, -1, -1]), np.array([math.log1p(k) - 1e-9, 0, 0]), np.array([0, 0, math.log1p(k) - math.log1p(k - 1)])) for k in (1, 2, 3)]
        return lexicon, boosting.Boosted(0.0, steps, knots)
    return lexicon, boosting.fit(np.array(found["x"].tolist()), y)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, learn: Callable[[Column], Column] = lambda i: fold(i) != 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents, of whole texts alone.

    Lexicon, trees and calibration are learned from about sample_rows labelled rows at
    most, only of ids that `learn` admits; held_out is true for the others. If those have
    no rows or one class, insults alone decide. score rises with the chance of label 1;
    predicted is 1 from `threshold` on.

    Null and empty texts, and texts without words, have zero features and are scored as
    such. Equal texts have equal scores. Rows that repeat give a row each; a null doc_id
    is held out only if `learn` says so of null, which counts as admitted. Labels of
    unknown ids, null labels and repeated ones are allowed: the highest counts. No rows
    give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    lexicon, model = _model(docs, labels, sample_rows, learn)

    def run(batches):
        for b in batches:
            x = np.array([features(t, lexicon) for t in b.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            score = np.clip(model.score(x), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(~learn(doc_id), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, learn: Callable[[Column], Column] = lambda i: fold(i) != 1) -> DataFrame:
    """The rows of docs whose text is not predicted to be toxic, all columns kept: one pass, each row by its own text."""
    small_batches(docs.sparkSession)
    lexicon, model = _model(docs, labels, sample_rows, learn)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([features(None if t is None else str(t), lexicon) for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(np.clip(model.score(x), 0.0, 1.0) < threshold))

    return docs.mapInArrow(run, docs.schema)
