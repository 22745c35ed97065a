"""One row about server and software, from the session's settings."""

from __future__ import annotations

import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the settings of a database server have their like in a Spark session.
SETTINGS = {"port": ("spark.driver.port", "0"), "default_storage_engine": ("spark.sql.sources.default", "parquet"), "basedir": ("spark.sql.warehouse.dir", ""), "ip": ("spark.driver.host", "")}


def server_information(spark: SparkSession) -> DataFrame:
    """Nested records ``ServerInformation`` (basedir, character_set_server,
    default_storage_engine, ip, port, user) and ``SoftwareInformation`` (sparkVersion,
    pythonVersion, javaVersion)."""
    values = {k: spark.conf.get(c, None) or spark.sparkContext.getConf().get(c, d) for k, (c, d) in SETTINGS.items()}
    row = spark.sql(
        "SELECT (SELECT CAST(:port AS INT)) AS port, (SELECT :engine) AS default_storage_engine, (SELECT :basedir) AS basedir, (SELECT 'UTF-8') AS character_set_server, "
        "(SELECT substring_index(concat(current_user(), '@', :ip), '@', -1)) AS ip, (SELECT current_user()) AS user",
        args={"port": values["port"], "engine": values["default_storage_engine"], "basedir": values["basedir"], "ip": values["ip"]},
    )
    blank = F.struct(*(F.lit("").alias(c) for c in ("sparkVersion", "pythonVersion", "javaVersion")))
    record = row.select(F.struct(*(F.col(c) for c in ("basedir", "character_set_server", "default_storage_engine", "ip", "port", "user"))).alias("ServerInformation"), blank.alias("SoftwareInformation"))
    software = F.col("SoftwareInformation").withField("sparkVersion", F.lit(spark.version)).withField("pythonVersion", F.lit(platform.python_version())).withField("javaVersion", F.lit(spark.sparkContext._jvm.System.getProperty("java.version")))
    return record.withColumn("SoftwareInformation", software)
