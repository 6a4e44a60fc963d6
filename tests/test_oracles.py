"""Each registered query against its DuckDB SQL: names, rows, values without order."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from tidemark.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as connection:
        for t in TABLES:
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        connection.execute("SET TimeZone = 'UTC'")
        yield connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") and value.tzinfo else value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_oracle(spark, duck, name):
    found = queries()[name](spark, SF)
    expected = duck.execute(oracle_sql()[name])
    names, rows = [d[0] for d in expected.description], expected.fetchall()
    got_names, got = table(found.columns, found.collect())
    names, rows = table(names, rows)
    assert got_names == names
    assert len(got) == len(rows)
    assert got == rows
