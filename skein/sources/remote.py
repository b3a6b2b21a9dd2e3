"""Tables behind a service that answers a page at a time and may ask to wait."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class Throttled(Exception):
    """The service asks to come back later, after `wait` seconds if it says so."""

    def __init__(self, wait: float | None = None):
        super().__init__(wait)
        self.wait = wait


class Unavailable(Exception):
    """The service went on asking to wait."""


class Client(Protocol):
    """What a scan needs of a service; it is sent to tasks, so it must pickle."""

    def bounds(self) -> tuple[int, int] | None:
        """Least and greatest key; None of an empty table."""

    def page(self, after: int, upto: int, most: int) -> list[tuple]:
        """At most `most` rows with after < key <= upto in the order of keys, whole rows in the order of the schema."""


def with_backoff(call: Callable[[], object], tries: int = 5, base: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after base, 2 base, 4 base, ... seconds (or what the service says) while it is throttled, `tries` times in all. Other errors pass."""
    for attempt in range(tries):
        try:
            return call()
        except Throttled as t:
            if attempt == tries - 1:
                raise Unavailable(f"still throttled after {tries} tries") from t
            sleep(min(base * 2**attempt if t.wait is None else t.wait, longest))
    raise ValueError("tries is 1 at least")


class _Range(InputPartition):
    def __init__(self, after: int, upto: int):
        super().__init__((after, upto))
        self.after, self.upto = after, upto


class _Reader(DataSourceReader):
    def __init__(self, client: Client, schema, key: str, options: dict):
        self.client, self.key, self.place = client, key, schema.fieldNames().index(key)
        self.parts, self.rows, self.limit = int(options.get("partitions", 8)), int(options.get("page", 1000)), int(options.get("limit", 0))
        self.tries, self.base = int(options.get("tries", 5)), float(options.get("wait", 2.0))
        self.least, self.greatest = None, None

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        """Bounds of the key go to the service; Spark applies the others."""
        for f in filters:
            bound = {GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0), EqualTo: (0, 0)}.get(type(f))
            if bound is None or f.attribute != (self.key,) or not isinstance(f.value, int):
                yield f
                continue
            if bound[0] is not None:
                self.least = max(f.value + bound[0], self.least if self.least is not None else f.value + bound[0])
            if bound[1] is not None:
                self.greatest = min(f.value + bound[1], self.greatest if self.greatest is not None else f.value + bound[1])

    def partitions(self):
        found = with_backoff(self.client.bounds, self.tries, self.base)
        if found is None:
            return [_Range(0, 0)]  # Spark wants one at least
        low = found[0] if self.least is None else max(found[0], self.least)
        high = found[1] if self.greatest is None else min(found[1], self.greatest)
        if high < low:
            return [_Range(0, 0)]
        parts = min(self.parts, high - low + 1)
        edges = [low - 1 + (high - low + 1) * k // parts for k in range(parts + 1)]
        return [_Range(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition) -> Iterator[tuple]:
        after, left = partition.after, self.limit or None
        while after < partition.upto and left != 0:
            want = self.rows if left is None else min(self.rows, left)
            rows = with_backoff(lambda after=after, want=want: self.client.page(after, partition.upto, want), self.tries, self.base)
            yield from rows
            if len(rows) < want:
                return
            after, left = rows[-1][self.place], None if left is None else left - len(rows)


def remote_table(spark: SparkSession, name: str, client: Client, schema: str, key: str, **options) -> DataFrame:
    """A table behind a service, keyed by whole numbers that differ, as a data source of Spark's.

    Ranges of the key are read side by side, `partitions` of them, each a `page` of rows
    at a time, so a lost task repeats its own range only. A throttled page waits in its
    task (`tries`, `wait`). Filters on the key narrow the ranges; limit=n lets a range
    end after n rows, for a caller that wants no more than n in all and cuts with
    limit(n), since Spark tells a Python source no limits.
    """
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)

    class Remote(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return kind

        def reader(self, schema):
            return _Reader(client, schema, key, {k.lower(): v for k, v in self.options.items()})

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Remote)
    return spark.read.format(name).options(**options).load()
