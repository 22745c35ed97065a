"""What the operators of this subpackage share: scratch tables, words, components."""

from __future__ import annotations

import contextlib
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space. ``bytes.split()``
#: cuts at exactly these bytes, and ``bytes.lower()`` changes A-Z alone.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of the Arrow batches that Python workers get.
BATCH_BYTES = 8 << 20

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where it is unset, a folder of this
    machine if all runs here, else an error: executors would write to disks of their own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="murmurate-")
    return _own_dirs[app]


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _new_path(spark: SparkSession) -> str:
    """A new folder for scratch data, deleted when the session ends if not before."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    return path


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES while a table is written: both sides of every Python
    worker hold some at a time. (A longer row is a batch of its own.)"""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, compression: str = "lz4") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and what
    follows does not compute it again. Lost executors do not lose it. ``release`` deletes the
    files, the end of the session at the latest."""
    spark = df.sparkSession
    path = _new_path(spark)
    with _small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``written``, bucketed by ``column``: joins and groups by it read the files where they lie.
    The table's entry in the catalog is only needed to resolve it and does not stay."""
    spark = df.sparkSession
    name, path = f"murmurate_{uuid.uuid4().hex}", _new_path(spark)
    with _small_batches(spark):
        df.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(buckets, column).saveAsTable(name)
    found = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return found


def release(*frames: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            files, where = _hadoop(df.sparkSession, path)
            files.delete(where, True)


def _give_back() -> None:
    """Return memory that Python's and Arrow's allocators hold but do not use to the system:
    workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function for ``mapInArrow`` (a generator), or for ``applyInArrow`` with a key and one or
    two tables, after which the worker gives memory back."""
    if inspect.isgeneratorfunction(run):

        def over(batches):
            try:
                yield from run(batches)
            finally:
                _give_back()

        return over
    if len(inspect.signature(run).parameters) == 2:

        def one(key, group):
            try:
                return run(key, group)
            finally:
                _give_back()

        return one

    def two(key, group, other):
        try:
            return run(key, group, other)
        finally:
            _give_back()

    return two


def private(columns, *names: str) -> list[str]:
    """Names for columns of an operator's own that clash with none of ``columns``."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else, whatever the locale or script."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` (longs, not null).

    Returns ``(node, component)`` for every node with an edge to another node; the component
    is its smallest node. Labels are hooked to the smallest label among neighbours, the old
    roots with them, and then shortened by pointer jumping, so rounds grow with the logarithm
    of the longest path. Labels that many nodes have are hot: what they point at is found for
    the distinct ones first, and joined to the nodes in a stage of its own, whose partitions AQE
    may split. Every round's labels are written to the shared folder, none is collected, and
    those of the round before deleted.
    """
    e = edges.where("a <> b").select("a", "b")
    both = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component"))
    labels = files = written(labels)
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = written(labels.join(seen, "node").select("node", "component", F.least("component", "near").alias("hook")))
        moved = hooked.where("hook < component").groupBy(F.col("component").alias("node")).agg(F.min("hook").alias("hook"))
        pointers = hooked.select("node", "hook").union(moved).groupBy(F.col("node").alias("hook")).agg(F.min("hook").alias("top"))
        tops = written(hooked.select("hook").distinct().join(pointers, "hook").where("top < hook"))
        new = F.coalesce("top", "hook")
        nxt = written(hooked.join(tops, "hook", "left").select("node", new.alias("component"), (new != F.col("component")).alias("changed")))
        release(files, hooked, tops)
        labels, files = nxt.select("node", "component"), nxt
        if nxt.where("changed").limit(1).count() == 0:
            release(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
