"""Every registered query of the engine against its SQL."""

import os

import duckdb
import pytest

from tidewater.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, tmp_path, name):
    df = registry.queries()[name](spark, DATA)
    df.write.parquet(str(tmp_path / "out"))
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    oracle.execute(f"CREATE OR REPLACE TABLE ours AS SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    oracle.execute(f"CREATE OR REPLACE TABLE theirs AS SELECT {columns} FROM ({registry.oracle_sql()[name].strip()})")
    count = lambda q: oracle.execute(f"SELECT count(*) FROM ({q})").fetchall()[0][0]
    assert count("FROM ours") == count("FROM theirs")
    assert count("FROM ours EXCEPT ALL FROM theirs") == 0
    kinds = [[r[1] for r in oracle.execute(f"DESCRIBE {t}").fetchall()] for t in ("ours", "theirs")]
    assert kinds[0] == kinds[1]
