"""Running a registered query and its SQL side by side."""

from __future__ import annotations

import glob
import os

import duckdb

import __spark_entry__ as registered

QUERIES, ORACLE = registered.queries(), registered.oracle_sql()


def open_tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, key, sf_dir):
    """Number of rows after asserting equal columns and equal values."""
    found = QUERIES[key](spark, sf_dir)
    names, mine = rows_of(found.columns, [tuple(r) for r in found.collect()])
    answer = con.execute(ORACLE[key])
    expected_names, expected = rows_of([d[0] for d in answer.description], answer.fetchall())
    assert names == expected_names
    assert len(mine) == len(expected), (len(mine), len(expected))
    for a, b in zip(mine, expected):
        assert a == b, (a, b)
    return len(mine)
