import pytest
from pyspark.sql import functions as F

from skein.sources.shared import new_path
from skein.streaming import incremental as I


def _ids(df):
    return sorted(r["id"] for r in df.collect())


def test_nothing_counts_between_write_and_commit(spark, monkeypatch):
    path, rows = new_path(spark), spark.range(40)
    assert I.append_new(rows.filter("id < 10"), path, "id", lambda df: df).count() == 10

    def lost(self, batch):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(I.ResultTable, "commit", lost)
        with pytest.raises(RuntimeError):
            I.append_new(rows, path, "id", lambda df: df)
    # written, but not committed: not there, and done anew
    assert _ids(I.ResultTable(spark, path).read()) == list(range(10))
    assert _ids(I.append_new(rows, path, "id", lambda df: df)) == list(range(40))
    assert _ids(I.append_new(rows, path, "id", lambda df: df)) == list(range(40))


def test_a_step_that_dies_in_its_write(spark):
    path, rows = new_path(spark), spark.range(40).repartition(4)
    bad = F.when(F.col("id") == 33, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id"))
    with pytest.raises(Exception, match="lost"):
        I.append_new(rows, path, "id", lambda df: df.select(bad.alias("id")))
    assert I.ResultTable(spark, path).read() is None
    assert _ids(I.append_new(rows, path, "id", lambda df: df)) == list(range(40))


def test_batches_go_on_where_a_run_ended(spark):
    path, rows, seen = new_path(spark), spark.range(95).repartition(5), []

    def step(df, most):
        seen.append(df.count())
        if len(seen) > most:
            raise RuntimeError("lost")
        return df

    with pytest.raises(RuntimeError):
        I.run_in_batches(rows, path, ["id"], 10, lambda df: step(df, 3))
    assert _ids(I.ResultTable(spark, path).read()) == list(range(30))
    assert _ids(I.run_in_batches(rows, path, ["id"], 10, lambda df: step(df, 99))) == list(range(95))
    assert seen == [10] * 4 + [10] * 6 + [5]
    I.run_in_batches(rows, path, ["id"], 10, lambda df: step(df, 99))
    assert len(seen) == 11
    assert I.run_in_batches(rows.limit(0), new_path(spark), ["id"], 10, lambda df: df).count() == 0


def test_a_stream_that_dies_between_write_and_commit(spark, monkeypatch):
    source, sink, state = new_path(spark), new_path(spark), new_path(spark)
    rows = spark.range(20)
    rows.write.parquet(source)
    run = lambda: I.stream_step(spark, source, rows.schema, sink, state, lambda df: df).awaitTermination()

    def lost(self, batch):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(I.ResultTable, "commit", lost)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    rows.select((F.col("id") + 20).alias("id")).write.mode("append").parquet(source)
    run()
    assert _ids(I.ResultTable(spark, sink).read()) == list(range(40))
