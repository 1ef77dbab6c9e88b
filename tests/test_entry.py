import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from featloom import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    cursor = con.execute(sql)
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["datum_id", "feature_id", "value"] and df.count() > 0


def test_entry_without_what_the_training_data_operators_need():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; assert 'flagship' in e.queries() and 'flagship' in e.oracle_sql(); assert not [q for q in e.queries() if q.startswith('op')]"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
