"""Readers, writers, dumps and registries of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWERS = "array<struct<answer:string,conditions:array<string>>>"
QA = "id string, scenario string, question string, url string, evidences array<string>, answers string, not_answerable boolean"
PREDICTION = "id string, Prompt string, Question string, Question_Type string, answers string, Actual_Answer string, Score struct<EM:double,Conditional_EM:double,F1:double,Conditional_F1:double>, Error string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """A JSON array file, or a row a line with blank ones skipped; always with a schema."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def parse_answers(answers: Column) -> Column:
    """`[["yes", ["condition"]], ...]`, arrays of a text and an array, as array<struct(answer, conditions)>."""
    raw = F.from_json(answers, "array<array<string>>")
    return F.transform(raw, lambda a: F.struct(a[0].alias("answer"), F.coalesce(F.from_json(a[1], "array<string>"), F.array().cast("array<string>")).alias("conditions")))


def write_json(df: DataFrame, path: str, append: bool = False, single: bool = False) -> None:
    """Rows as JSON lines; single for small summaries alone."""
    (df.coalesce(1) if single else df).write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table with a header in one file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def checked_vectors(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Vectors of the dimension given; any other fails the query."""
    return df.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"a vector should have {dim} elements, not "), F.size(column).cast("string")))))


def read_turtle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges (src_id, edge_id, dst_id), labels (node_id, label)) of a dump of blocks of numbered nodes."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("src_id", F.regexp_extract("value", r"(?:^|\n)\s*(?:\w*:|<[^>]*?)(\d+)>?\s", 1)).filter("src_id <> ''")
    label = F.regexp_extract("value", r"ns1:id\s+\"((?:[^\"\\]|\\.)*)\"", 1)
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(r"(?:\w+:|<[^>\s]*?)(\d+)>?\s+(?:\w+:|<[^>\s]*?)(\d+)>?\s*[;.,]"), F.lit(1)).alias("e"), F.regexp_extract_all("value", F.lit(r"(?:\w+:|<[^>\s]*?)(\d+)>?\s+(?:\w+:|<[^>\s]*?)(\d+)>?\s*[;.,]"), F.lit(2)).alias("d"))
    edges = blocks.select(F.col("src_id").cast("long"), F.inline(pairs)).toDF("src_id", "edge_id", "dst_id").select("src_id", F.col("edge_id").cast("long"), F.col("dst_id").cast("long"))
    return edges, blocks.select(F.col("src_id").cast("long").alias("node_id"), label.alias("label")).filter("label <> ''")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines."""
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s*\.\s*$"
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, k).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))])


def next_run(df: DataFrame, column: str = "run_id") -> int:
    """The number after the greatest run."""
    last = df.agg(F.max(column)).first()[0]
    return 0 if last is None else last + 1


def with_file(df: DataFrame, folder: bool = False) -> DataFrame:
    """Rows with the file they came from, to evaluate all files of a folder in one job; with `folder` the folder it lies in, as Spark writes what is one file elsewhere."""
    return df.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$" if folder else r"([^/]+)$", 1))


def history(df: DataFrame, session: str, order: str = "turn") -> DataFrame:
    """(session, history): the turns of each session as one text."""
    line = F.concat_ws(": ", "role", "text")
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x"))))
    return df.groupBy(session).agg(F.array_join(F.transform(listed, lambda s: s["x"]), "\n").alias("history"))


#: Data sets by name: the reader of their rows and the field that holds the question.
REGISTRY: dict[str, tuple[str, str]] = {"conditionalqa": (QA, "question"), "predictions": (PREDICTION, "Question")}


def dataset(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, str]:
    if name not in REGISTRY:
        raise ValueError(f"no data set {name}; there are {', '.join(REGISTRY)}")
    schema, field = REGISTRY[name]
    return read_json(spark, path, schema), field


def references(spark: SparkSession, path: str) -> DataFrame:
    """(id, reference, question, qtype) that a file of predictions carries beside them."""
    rows = read_json(spark, path, PREDICTION)
    return rows.select("id", F.col("Actual_Answer").alias("reference"), F.col("Question").alias("question"), F.col("Question_Type").alias("qtype"))


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy_MM_dd-hh_mm_ss_a")
