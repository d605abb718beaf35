"""Every core query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from sagekeep.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(data).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    frame = QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert len(set(frame.columns)) == len(frame.columns)
    if name in ORACLES:
        result = sql.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        assert got == expected


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
