"""Every registered query of the core against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidelog import catalogue

DATA = os.environ.get("TIDELOG_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_matches(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLE:
        want = oracle.sql(catalogue.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)
