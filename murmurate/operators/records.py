"""Small transformations of records, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_to_list(df: DataFrame, column: str) -> DataFrame:
    """One row with all values of a column, in their order, as ``values``. For bounded tables
    such as catalog listings: the list is one row."""
    return df.agg(F.sort_array(F.collect_list(column)).alias("values"))


def nest(df: DataFrame, name: str, **constants: Column) -> DataFrame:
    """Each row's columns as one struct ``name``, and further columns."""
    return df.select(F.struct("*").alias(name), *(v.alias(k) for k, v in constants.items()))


def set_field(df: DataFrame, column: str, field: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.col(column).withField(field, value))


def decode_json(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """The fields of a JSON body; malformed bodies give nulls."""
    return df.select(F.from_json(column, schema).alias("_body")).select("_body.*")


def first_match(df: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first row by ``order`` that fulfils the condition, or none."""
    return df.where(condition).orderBy(order).limit(1)


def update_where(df: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    """``column`` set where the condition holds; where it is false or null the row stays."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def append(df: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """``rows`` after those of ``df``, numbered on from the greatest ``order`` by their own."""
    last = df.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_last"))
    moved = rows.crossJoin(F.broadcast(last)).withColumn(order, F.col(order) + F.col("_last") + 1).drop("_last")  # one row
    return df.unionByName(moved)


def view_nodes(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(v.alias(k) for k, v in columns.items()))


def count_matching(df: DataFrame, column: str, text: str) -> DataFrame:
    """How many rows contain a text."""
    return df.where(F.contains(column, F.lit(text))).agg(F.count("*").alias("n"))


def characters(df: DataFrame, column: str, step: int = 100, delay: int = 0) -> DataFrame:
    """A row for each character (code point) with ``place`` and ``offset`` = place * step + delay."""
    chars = df.select("*", F.posexplode(F.split(column, "")).alias("place", "character"))
    return chars.where("character <> ''").withColumn("offset", F.col("place") * step + delay)
