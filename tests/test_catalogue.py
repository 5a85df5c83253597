"""Every registered query against its SQL on the smallest data."""

import math

import pytest

from quern.catalogue import ORACLE_SQL, QUERIES


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "__float__") and not isinstance(x, str):
        return f"{float(x):.5f}".replace("-0.00000", "0.00000")
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    sql = duck.sql(ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    assert rows == sorted(tuple(plain(x) for x in r) for r in sql.select(*columns).fetchall())


def test_modules_import_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True, timeout=120)
