"""Every k-mer query against its SQL at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__
from basewell.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name, tmp_path):
    catalogue.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    db.execute(f"create or replace temp table expected as {catalogue.oracle_sql()[name]}")
    columns = ", ".join(sorted(x[0] for x in db.execute("describe expected").fetchall()))
    found = f"select {columns} from '{tmp_path}/out/*.parquet'"
    assert db.execute(f"select count(*) from ({found})").fetchone()[0] > 0
    for a, b in ((found, f"select {columns} from expected"), (f"select {columns} from expected", found)):
        assert db.execute(f"select count(*) from ({a} except all {b})").fetchone()[0] == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
