import duckdb
import pytest

import __spark_entry__ as entry
from lumagrid.plans import images, shapes

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


QUERIES, ORACLES = images.QUERIES | shapes.QUERIES, images.ORACLES | shapes.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in NAMES.split():
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = QUERIES[name](spark, SF)
    cols = sorted(ours.columns)
    theirs = db.sql(ORACLES[name])
    assert sorted(theirs.columns) == cols
    assert sorted(map(tuple, ours.select(cols).collect()), key=str) == sorted(theirs.select(", ".join(f'"{c}"' for c in cols)).fetchall(), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())
