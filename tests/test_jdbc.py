"""Tables of a database by JDBC, from one that Spark brings along."""

import pytest

from heritree.sources import schemas

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def database(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    for name, schema in schemas.TABLES.items():
        rows = []
        if name == "persons":
            rows = [[k if f.name == "id" else f"P-{k}" if f.name == "wiki_id" else None for f in schema] for k in range(1, 41)]
        loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
        spark.createDataFrame(rows, loose).write.jdbc(url, name, properties=DRIVER)
    return url


@pytest.mark.parametrize("partitions", [1, 4])
def test_tables_by_jdbc(spark, database, partitions):
    found = schemas.jdbc_tables(spark, database, DRIVER, partitions)
    assert set(found) == set(schemas.TABLES)
    persons = found["persons"]
    assert [f.name for f in persons.schema] == schemas.TABLES["persons"].names and persons.rdd.getNumPartitions() == partitions
    assert sorted(r.wiki_id for r in persons.collect()) == sorted(f"P-{k}" for k in range(1, 41))
    assert found["locations"].count() == 0
    # filters and columns go to the database
    plan = persons.where("id > 30").select("wiki_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and persons.where("id > 30").count() == 10
