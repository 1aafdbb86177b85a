"""Queries that once read only the first rows of their table, against their SQL without that filter."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from heathgrid import queries

FILTERS = (" where id <= 40 and lng + 12 > 180", " where lng + 12 > 180"), (" where id <= 40", ""), (" where l_orderkey <= 400", "")


def rows(found):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in found)


@pytest.mark.parametrize("name", ["tiles_for_bbox", "tile_counts", "offline_estimate", "tile_anti_join", "tile_coverage", "tile_exclusive", "selection_ci"])
def test_every_row_counts(spark, tmp_path, name):
    tables = {"customer": {"c_custkey": list(range(1, 121))}, "lineitem": {"l_orderkey": [k * 30 for k in range(1, 60)], "l_linenumber": [k % 7 + 1 for k in range(1, 60)]}}
    con, sql = duckdb.connect(), queries.oracle_sql()[name]
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    for old, new in FILTERS:
        sql = sql.replace(old, new)
    assert "<= 40" not in sql
    found = queries.queries()[name](spark, str(tmp_path))
    assert rows(map(tuple, found.select(*sorted(found.columns)).collect())) == rows(con.execute(f"select {', '.join(sorted(found.columns))} from ({sql})").fetchall())
