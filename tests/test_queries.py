import glob
import os

import duckdb
import pytest

from webloom.plans.registry import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(float(r[i]), 6) if isinstance(r[i], float) or hasattr(r[i], "as_tuple") else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in oracle_sql():
        db = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        want = db.execute(oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(want.fetchall(), names)
    else:
        assert rows
