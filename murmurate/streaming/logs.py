"""Log lines: one transformation for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.logs import classify_line, line_port, strip_prefix
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The lines of text files as they appear in a folder."""
    return spark.readStream.options(**options).text(folder)


def classify_logs(lines: DataFrame, column: str = "value", keep_ports: bool = False) -> DataFrame:
    """``line, class, port`` of each line, a leading ``[digits]`` removed. Lines that announce the
    port are dropped unless asked for. Stateless, hence the same for batches and streams."""
    stripped = lines.select(strip_prefix(F.col(column)).alias("line"))
    out = stripped.select("line", classify_line(F.col("line")).alias("class"))
    out = out.withColumn("port", F.when(F.col("class") == "port", line_port(F.col("line"))))
    return out if keep_ports else out.where("class <> 'port'")


def write_logs(stream: DataFrame, checkpoint: str, path: str | None = None, name: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Write a classified stream to Parquet files at ``path``, a memory table ``name`` (all of it in
    the driver's memory, hence for small streams), or the console."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.format("parquet").option("path", path) if path else writer.format("memory").queryName(name) if name else writer.format("console")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
