"""Stores: tables that are built once from their inputs and loaded from then on, until an input changes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import no_shuffles_left, shared_dir
from .tables import checked_vectors

#: Stands in a store's folder once all of it is written.
MARKER = "_built.json"
#: The least number of buckets, and bytes of input files for each of more: what a bucket's task sorts stays as large, whatever the input.
BUCKETS, BUCKET_BYTES = 16, 16 << 20


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def manifest(inputs: list[DataFrame]) -> list[list]:
    """[path, bytes, time of the last change] of every file that the inputs read, in order."""
    out = []
    for path in sorted({f for df in inputs for f in df.inputFiles()}):
        files, where = _files(inputs[0].sparkSession, path)
        status = files.getFileStatus(where)
        out.append([path, status.getLen(), status.getModificationTime()])
    return out


def _label(name: str, folder: str) -> str:
    """The session's name of a bucketed table: by name and folder, so that stores of other folders are other tables."""
    return f"skein_{name}_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"


def stored(spark: SparkSession, name: str, inputs: list[DataFrame], build: Callable[[], DataFrame], bucket: str | None = None, buckets: int | None = None, key: Column | None = None, repeats: bool = False) -> DataFrame:
    """The table that build() makes of inputs, written when it is first asked for and whenever the inputs' files are other ones.

    A version lies in a folder of its own, named by a hash of its manifest, so that what
    reads an older one goes on. A build that dies half-way leaves no marker and is done
    anew. With `bucket` rows are dealt by that column into `buckets` sorted buckets of one
    file each, as many as the input's bytes ask for if not given, and joins on it don't
    shuffle the table. `key`, if given, makes that column of build()'s rows; with
    `repeats` rows are made distinct in their buckets.
    """
    files_read = manifest(inputs)
    if bucket and buckets is None:
        buckets = max(BUCKETS, sum(size for _, size, _ in files_read) // BUCKET_BYTES)
    version = hashlib.sha256(json.dumps([files_read, bucket, buckets if bucket else 0]).encode()).hexdigest()[:24]
    folder = f"{shared_dir(spark)}/skein/stores/{name}/{version}"
    files, marker = _files(spark, f"{folder}/{MARKER}")
    label = _label(name, folder)
    if not files.exists(marker):
        files.delete(_files(spark, folder)[1], True)
        made = build()
        with no_shuffles_left(spark):
            if bucket:
                spark.sql(f"DROP TABLE IF EXISTS {label}")
                keyed = lambda df: df if key is None else df.select(key.alias(bucket), *made.columns)
                # rows that repeat meet where their key is dealt, so it is dealt with them; others get it afterwards
                dealt = keyed(made).repartition(buckets, bucket).distinct() if repeats else keyed(made.repartition(buckets, F.col(bucket) if key is None else key))
                dealt.write.format("parquet").option("path", f"{folder}/rows").option("compression", "zstd").bucketBy(buckets, bucket).sortBy(bucket).saveAsTable(label)
            else:
                made.write.parquet(f"{folder}/rows", compression="zstd")
        out = files.create(marker, True)
        out.write(bytearray(json.dumps({"name": name, "inputs": files_read}).encode()))
        out.close()
    rows = spark.read.parquet(f"{folder}/rows")
    if not bucket:
        return rows
    if not spark.catalog.tableExists(label):  # built by another session
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        spark.sql(f"CREATE TABLE {label} ({columns}) USING parquet CLUSTERED BY (`{bucket}`) SORTED BY (`{bucket}`) INTO {buckets} BUCKETS LOCATION '{folder}/rows'")
    return spark.table(label)


def drop_versions(spark: SparkSession, name: str, keep: str | None = None) -> int:
    """Delete the versions of a store but the one whose folder is named `keep`; how many there were. For when nothing reads them."""
    top = f"{shared_dir(spark)}/skein/stores/{name}"
    files, folder = _files(spark, top)
    found = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    gone = [p for p in found if p.getName() != keep]
    for p in gone:
        spark.sql(f"DROP TABLE IF EXISTS {_label(name, f'{top}/{p.getName()}')}")
        files.delete(p, True)
    return len(gone)


@dataclass(frozen=True)
class GraphStore:
    """Triples (key, head, rel, tail), once dealt by the lower-case head and once by the tail as `key`."""

    by_head: DataFrame
    by_tail: DataFrame


def graph_store(spark: SparkSession, name: str, inputs: list[DataFrame], build: Callable[[], DataFrame], buckets: int | None = None, repeats: bool = False) -> GraphStore:
    """Both tables of a graph, created or loaded; build() gives (head, rel, tail).

    With `repeats` triples of build() may come several times: they are made distinct where
    heads are dealt, and the other table is made of that one, so that each triple is
    shuffled once for each table.
    """
    triples = lambda df: df.select("head", "rel", "tail")
    side = lambda column, rows, again=False: stored(spark, f"{name}_by_{column}", inputs, lambda: triples(rows()), "key", buckets, F.lower(column), again)
    by_head = side("head", build, repeats)
    return GraphStore(by_head, side("tail", (lambda: by_head) if repeats else build))


def vector_store(spark: SparkSession, name: str, vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """A table of vectors, created or loaded; one of another dimension than `dim` fails the build."""
    return stored(spark, name, [vectors], lambda: checked_vectors(vectors, dim, column))
