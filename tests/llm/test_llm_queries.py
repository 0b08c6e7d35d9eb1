from pathlib import Path

import duckdb
import pytest

from lorespan.llm import queries

COLUMNS = {
    "p2_found": ["ord_a", "ord_b"], "p3_found": ["conv_id", "pos", "message_id", "role"], "p4_found": ["src", "ord", "pos", "kind", "found_text"], "p6_found": ["group_ord", "confidence_ord", "valid_from_ord", "evidence_ord"],
    "p7_found": ["src", "ord", "pos", "new_md5"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "start_at", "end_at"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, data, name):
    out = queries.QUERIES[name](spark, data)
    assert out.count() > 0
    if name in COLUMNS:
        assert out.columns == COLUMNS[name]
        types = dict(out.dtypes)
        assert all(types[c] == "bigint" for c in out.columns if c in ("ord", "pos", "ord_a", "ord_b", "start_at", "end_at", "doc_id") or c.endswith("_ord"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    ours = queries.QUERIES[name](spark, data).select(*names)
    assert sorted(tuple(r) for r in ours.collect()) == sorted(cursor.fetchall())
