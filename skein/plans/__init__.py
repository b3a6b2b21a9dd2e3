"""Queries over the test tables, with DuckDB SQL beside each that SQL can express."""
