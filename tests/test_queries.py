"""Every registered query of the engine with SQL, against DuckDB on the same files."""
import duckdb
import pytest

from tallyforge import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


def ordered(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, repr(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert ordered(rows, df.columns) == ordered(want.fetchall(), names)
