"""The queries' SQL against DuckDB on the small tables."""

from pathlib import Path

import duckdb
import pytest

from lenscube.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    rows = [dict(zip((d[0] for d in want.description), r, strict=True)) for r in want.fetchall()]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)
