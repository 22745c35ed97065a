"""Directories of Parquet tables as databases of the session's catalog."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Roots that were registered last, by application and database.
_registered: dict[tuple[str, str], tuple[str, list[str]]] = {}

_NAME = re.compile(r"[A-Za-z0-9_]+")


def parquet_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Names and paths of the ``*.parquet`` entries of ``root``, through Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.endswith(".parquet"):
            found[name.removesuffix(".parquet")] = status.getPath().toString()
    return dict(sorted(found.items()))


def database_name(display: str) -> str:
    """A legal schema name: every other character becomes an underscore."""
    return re.sub(r"[^A-Za-z0-9_]", "_", display)


def database_tables(spark: SparkSession, database: str) -> list[str]:
    rows = spark.sql("SHOW TABLES FROM IDENTIFIER(:d)", args={"d": database}).where("NOT isTemporary").select("tableName").collect()
    return sorted(r[0] for r in rows)


def register_database(spark: SparkSession, root: str, database: str) -> list[str]:
    """Make the Parquet entries of ``root`` the tables of ``database``; returns their names.

    Tables of the database that point elsewhere or are not in ``root`` are dropped from the
    catalog; no file is touched."""
    if not _NAME.fullmatch(database):
        raise ValueError(f"{database!r} is no legal database name")
    known = (spark.sparkContext.applicationId, database)
    if known in _registered and _registered[known][0] == root and spark.catalog.databaseExists(database) and database_tables(spark, database) == _registered[known][1]:
        return _registered[known][1]
    tables = parquet_tables(spark, root)
    if not tables:
        raise FileNotFoundError(f"no Parquet table in {root}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in database_tables(spark, database):
        if name not in tables or _location(spark, database, name) != tables[name]:
            spark.sql(f"DROP TABLE {database}.`{name}`")
    there = set(database_tables(spark, database))
    for name, path in tables.items():
        if name not in there:
            quoted = path.replace("'", "\\'")
            spark.sql(f"CREATE TABLE {database}.`{name}` USING parquet LOCATION '{quoted}'")
    _registered[known] = (root, list(tables))
    return list(tables)


def _location(spark: SparkSession, database: str, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {database}.`{name}`").where("col_name = 'Location'").select("data_type").collect()
    return rows[0][0] if rows else ""
