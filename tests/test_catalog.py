"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from venuelake.plans import catalog, flows, shapes
from venuelake.plans import rows as more_rows

SF = "/root/testdata/sf0.001"
assert shapes and flows and more_rows  # their queries are in the catalogue
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if pd.isna(x):
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x.is_integer() else x

    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, db, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(catalog.SQL[name]).fetchdf())


def test_flagship_plan_prunes_columns(spark):
    plan = catalog.flagship_open_nearby(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan.split("ReadSchema")[1]
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_no_row_is_left_out(spark):
    for name, source in (("nearest_known_region", "customer"), ("normal_forms", "nation")):
        assert catalog.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
