"""Queries against their SQL over the smallest tables."""

import os

import duckdb
import pytest

from skein.plans import catalogue
from test_engine import SF, _rows

NAMES = (
    "similarity_maxima best_pair_max one_reference evaluated_files render_context hybrid_and conditional_sample incremental_append store_rebuild remote_scan text_answerer code_second_try "
    "translations extracted_relations keywords_written model_judged numbered_runs capped_candidates relation_label_search property_ids passage_search merged_properties flattened_sections traverse_paths"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, name):
    c = duckdb.connect()
    for x in os.listdir(SF):
        c.execute(f"create view {x.removesuffix('.parquet')} as select * from '{SF}/{x}'")
    assert _rows(catalogue.queries()[name](spark, SF).toPandas()) == _rows(c.execute(catalogue.oracle_sql()[name]).df())
