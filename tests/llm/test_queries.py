from types import SimpleNamespace

import duckdb
import pytest

from fleetlens.llm.common import shared_dir
from fleetlens.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.01"


def test_names():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)} and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = queries()[name](spark, FOLDER)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall()) != []


@pytest.mark.parametrize("named, master, warehouse, expected", [("hdfs:/c", "spark://h:7077", "file:/w", "hdfs:/c"), (None, "spark://h:7077", "hdfs:/w/", "hdfs:/w/_staged"), (None, "spark://h:7077", "file:/w", None)])
def test_the_shared_folder_is_no_machines_own(named, master, warehouse, expected):
    context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named})
    session = SimpleNamespace(sparkContext=context, conf={"spark.sql.warehouse.dir": warehouse})
    if expected:
        assert shared_dir(session) == expected
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session)
