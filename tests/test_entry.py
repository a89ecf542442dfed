import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) >= 100


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["summary", "paired_runs", "line_match", "gate_verdicts", "stratified_sample", "normalize_currency", "different_party"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    if name not in entry.oracle_sql():
        pytest.skip("no SQL")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain(df.select(*columns).collect()) == plain(result)
