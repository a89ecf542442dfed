import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def duck(sql: str, tables: dict | None = None, folder: str = SF):
    """Rows of ``sql`` over the driver's tables, or over the given pandas frames where named."""
    con = duckdb.connect()
    for file in os.listdir(folder) if os.path.isdir(folder) else ():
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    for name, frame in (tables or {}).items():
        con.register(f"_{name}", frame)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM _{name}")
    return con.execute(sql).fetchall()


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
