"""Every registered query of the package against its SQL on DuckDB, on the smallest tables."""

import datetime
import math
import re

import duckdb
import pytest

from litspark import registry
from litspark.testviews import TABLES

SMALL = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return f"{float(v):.9g}"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    df = registry.QUERIES[name](spark, SMALL)
    got = df.collect()
    if name not in registry.ORACLES:
        assert df.columns
        return
    found = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, found.fetchall())


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SMALL).count() > 0


def test_registry_needs_no_training_data():
    import pathlib

    root = pathlib.Path(registry.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
