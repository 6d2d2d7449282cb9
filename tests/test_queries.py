"""Every query of the registry against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(rows):
    show = lambda x: ("nan" if math.isnan(x) else f"{x:.9g}") if isinstance(x, float) else str(x)
    return [tuple(None if x is None else show(x) for x in r) for r in rows]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no reference tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in registry.ORACLES:
        result = con.execute(registry.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        key = lambda rows: sorted(rows, key=repr)
        assert key(got) == key(plain(tuple(r[i] for i in at) for r in result.fetchall()))
    else:
        assert got


def test_the_rest_works_without_the_training_data_package():
    import pathlib

    for path in pathlib.Path(registry.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessera.llm" not in path.read_text(), path
