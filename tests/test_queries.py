"""Every registered query that has SQL against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lorespan.plans import data_queries, reference_queries

CORE = {**reference_queries.ORACLES, **data_queries.ORACLES}


def rows(names, records):
    def plain(x):
        if isinstance(x, float):
            return round(x, 5)
        return list(x) if isinstance(x, list) else x

    at = [names.index(n) for n in sorted(names)]
    return sorted(([plain(r[k]) for k in at] for r in records), key=repr)


def sql_rows(folder, sql):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, data, name):
    folder = data
    names, want = sql_rows(folder, CORE[name])
    if not want:  # nothing to compare on the smallest tables
        folder = data.replace("sf0.001", "sf0.01")
        names, want = sql_rows(folder, CORE[name])
    ours = entry.queries()[name](spark, folder)
    assert sorted(ours.columns) == sorted(names) and want
    got = rows(ours.columns, [tuple(r) for r in ours.collect()])
    assert repr(got) == repr(rows(names, want))  # as text, so that NaN equals NaN only, not null


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
