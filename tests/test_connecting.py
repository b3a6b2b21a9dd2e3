import os

import duckdb
import pytest

from skein.plans import catalogue
from test_engine import SF, _rows


@pytest.mark.parametrize("name", ["json_round_trip", "csv_round_trip", "rdf_ntriples", "file_stream", "event_windows", "judged_rows"])
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for x in os.listdir(SF):
        c.execute(f"create view {x.removesuffix('.parquet')} as select * from '{SF}/{x}'")
    assert _rows(catalogue.queries()[name](spark, SF).toPandas()) == _rows(c.execute(catalogue.oracle_sql()[name]).df())
