import duckdb
import pytest

from sourcelode.plans import analyses, catalog  # noqa: F401  (analyses adds its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str([_plain(x) for x in (v.tolist() if hasattr(v, "tolist") else v)]) if not isinstance(v, (int, float)) and not hasattr(v, "dtype") or getattr(v, "ndim", 0) else f"{float(v):.6g}"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted(str([_plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    at = [want.columns.index(c) for c in sorted(want.columns)]
    b = sorted(str([_plain(r[i]) for i in at]) for r in want.fetchall())
    assert a == b
