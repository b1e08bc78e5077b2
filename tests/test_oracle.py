"""Every query against its SQL twin, on whole tables."""

import math

import duckdb
import pytest

from linewatch.queries import load

from .conftest import TESTDATA

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SF = f"{TESTDATA}/sf0.001"
ENTRIES = load()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_matches_sql(spark, con, name):
    entry = ENTRIES[name]
    # every batch of a stream starts a worker per partition
    spark.conf.set("spark.sql.shuffle.partitions", "2" if entry.run.__module__.endswith(".streaming") else "8")
    df = entry.run(spark, SF)
    rows = df.collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    if entry.sql is None:
        assert rows
        return
    result = con.execute(entry.sql)
    types = {c[0]: str(c[1]) for c in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    columns = sorted(types)
    order = [list(types).index(c) for c in columns]
    want = sorted(tuple(canonical(r[i]) for i in order) for r in result.fetchall())
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in rows)
    assert got == want
