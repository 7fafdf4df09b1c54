"""The driver contract: importable without a session, and queries that match their SQL on the smallest tables."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest

from fieldspark.plans import catalog

SF = "/root/testdata/sf0.001"
OWN = sorted(set(catalog.ORACLE_SQL))


def test_import_needs_no_session():
    script = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60"
    subprocess.run([sys.executable, "-c", script], check=True, cwd=Path(entry.__file__).parent)


def plain(row):
    return tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else float(v) if type(v).__name__ == "Decimal" else v for v in row)


@pytest.mark.parametrize("name", OWN)
def test_results_match_their_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    frame = entry.queries()[name](spark, SF)
    wanted = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(frame.columns)
    assert Counter(plain(r) for r in frame.select(names).collect()) == Counter(map(plain, wanted.fetchall()))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
