"""KEY=VALUE files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_env(spark: SparkSession, text: str) -> DataFrame:
    """``key, value`` of every pair of a small text. Lines that begin with ``#`` are dropped; a
    line may hold several pairs, apart by white space; a word without ``=`` is left out."""
    lines = spark.createDataFrame([(x,) for x in text.splitlines()], "value string")
    words = lines.where(~F.startswith("value", F.lit("#"))).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("pair"))
    return words.where(F.contains("pair", F.lit("="))).select(F.substring_index("pair", "=", 1).alias("key"), F.expr("substring(pair, instr(pair, '=') + 1)").alias("value"))


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """``parse_env`` of a small file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:  # Spark's readers pass over files whose names begin with a dot
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return parse_env(spark, text)
