"""Catalog, session and SQL: decisions on edge cases."""

import pytest
from pyspark.errors import PySparkException

from murmurate import queries
from murmurate.operators import sql
from murmurate.session import Engine, NotConnectedError
from murmurate.sources.tables import database_name

from .conftest import SMALL


@pytest.fixture
def engine(spark):
    e = Engine(spark).connect(SMALL, "test_lake")
    yield e
    if e.connected:
        e.disconnect()


def test_lists_tables_and_databases(engine):
    assert sorted(r[0] for r in engine.tables().collect()) == sorted(queries.TABLES)
    assert "test_lake" in [r["Database"] for r in engine.databases().collect()]
    assert engine.current_database() == "test_lake" and engine.health() and Engine.session_exists()


def test_temporary_views_are_no_tables(spark, engine):
    spark.range(1).createOrReplaceTempView("only_a_view")
    assert "only_a_view" not in [r[0] for r in engine.tables().collect()]
    spark.catalog.dropTempView("only_a_view")


def test_use_gives_name_and_tables(spark, engine):
    spark.sql("CREATE DATABASE IF NOT EXISTS empty_one")
    row = engine.use("empty_one").first()
    assert row["DBName"] == "empty_one" and row["DBTable"] == []
    assert engine.use("test_lake").first()["DBTable"] == sorted(queries.TABLES)
    spark.sql("DROP DATABASE empty_one")


@pytest.mark.parametrize("name", ["no_such_database", "a;b", "x-y", "test_lake; DROP DATABASE test_lake"])
def test_bad_names_raise_and_change_nothing(engine, name):
    with pytest.raises(PySparkException):
        engine.tables(name).collect()
    with pytest.raises(PySparkException):
        engine.use(name)
    assert engine.current_database() == "test_lake"


def test_connecting_twice_is_harmless_and_disconnecting_forgets(spark):
    e = Engine(spark).connect(SMALL, "twice").connect(SMALL, "twice")
    e.disconnect()
    assert not e.connected and not spark.catalog.databaseExists("twice") and spark.catalog.currentDatabase() == "default"
    with pytest.raises(NotConnectedError):
        e.tables()
    assert spark.sql("SELECT 1").first()[0] == 1  # the session goes on


def test_failed_connect_leaves_nothing(spark, tmp_path):
    e = Engine(spark)
    with pytest.raises(FileNotFoundError):
        e.connect(str(tmp_path), "nothing")
    assert not e.connected


def test_another_root_replaces_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "numbers.parquet"))
    e = Engine(spark).connect(SMALL, "moving").connect(str(tmp_path), "moving")
    assert [r[0] for r in e.tables().collect()] == ["numbers"]
    assert e.query("SELECT count(*) AS n FROM moving.numbers").first()["n"] == 3
    e.disconnect()


def test_database_name():
    assert database_name("sf0.01") == "sf0_01"


def test_parameters(engine):
    q = "SELECT count(*) AS n FROM test_lake.nation WHERE n_nationkey < ? -- really?"
    assert engine.query(q, [3]).first()["n"] == 3
    assert engine.query("SELECT ? AS x", [None]).first()["x"] is None
    assert engine.query("SELECT ? AS x", ["a' OR '1'='1"]).first()["x"] == "a' OR '1'='1"
    for bad in ([], [1, 2]):
        with pytest.raises(ValueError):
            engine.query(q, bad)
    assert sql.parameter_count("SELECT '?', \"?\", `?` /* ? */ , ? -- ?\n, ?") == 2


def test_several_statements(engine):
    first, second = engine.queries(["SELECT 1 AS a;", "SELECT 'x;y' AS b"])
    assert first.first()["a"] == 1 and second.first()["b"] == "x;y"


def test_filters_reach_the_scan(engine):
    plan = engine.query("SELECT o_orderkey FROM test_lake.orders WHERE o_totalprice > ?", [100.0])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100.0)]" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]


def test_server_information(engine):
    row = engine.server_information().first()
    assert row["ServerInformation"]["default_storage_engine"] == "parquet" and isinstance(row["ServerInformation"]["port"], int)
    assert row["SoftwareInformation"]["sparkVersion"] and row["SoftwareInformation"]["javaVersion"]


def test_insert_works_and_update_is_refused(spark, tmp_path):
    spark.sql(f"CREATE TABLE written (a INT) USING parquet LOCATION '{tmp_path}/t'")
    spark.sql("INSERT INTO written VALUES (1), (2)")
    assert spark.table("written").count() == 2
    with pytest.raises(PySparkException):
        spark.sql("UPDATE written SET a = 3")
    spark.sql("DROP TABLE written")
