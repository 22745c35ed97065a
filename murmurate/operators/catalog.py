"""Databases and tables of the session's catalog. Names are bound, never pasted into SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("Database"))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``table_name`` of every table of a database, the current one by default. Temporary views
    are no tables of a database. A missing database raises an error."""
    name = database or spark.catalog.currentDatabase()
    return spark.sql("SHOW TABLES FROM IDENTIFIER(:d)", args={"d": name}).where("NOT isTemporary").select(F.col("tableName").alias("table_name"))


def use_database(spark: SparkSession, database: str) -> DataFrame:
    """Make a database current; one row of its name and its tables in order. On an error the
    current database stays."""
    spark.catalog.setCurrentDatabase(database)
    tables = list_tables(spark, database).agg(F.sort_array(F.collect_list("table_name")).alias("DBTable"))
    return tables.select(F.lit(database).alias("DBName"), "DBTable")


def current_database(spark: SparkSession) -> str:
    return spark.catalog.currentDatabase()
