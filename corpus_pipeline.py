"""The corpus pipeline: language ID, line dedup, near-dedup, substring dedup, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir), works on all its
predecessor kept and returns a DataFrame with the columns of ``documents``, the last one the
places of the documents in batches. Other columns of the input are not passed on. Every stage
takes nulls in any column, empty texts and tables, and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurate.llm import langid, line_dedup, near_dedup, packing, substring_dedup
from murmurate.llm.common import release, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is certain, with that language in ``lang``. The model learns from
    ``docs``, whole texts of any length; the column ``lang`` is the declaration, ``source`` the place. Rejected: null
    texts, texts without letters, texts unlike every language, doubtful ones."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    found = langid.fuse(docs, model, F.col("text"), F.lower("lang"), [F.col("source")], [F.col(c) for c in COLUMNS])
    return found.where("kept").select("doc_id", "text", F.col("language").alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without later occurrences of three-line windows; ``n_chars`` follows."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each component; of rows alike in id and text, one."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without 50-byte strings that a row of a smaller id has; characters cut in two
    at the edges go too. ``n_chars`` follows. Null texts come back empty."""
    found = substring_dedup.dedup_substrings(docs, carry=["lang", "source", "n_chars"])
    raw = F.col("kept").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "�", ""))
    out = found.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row, repeated ones and those with null ids too; null and
    empty texts have no words and go to the bucket of the shortest."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packed)]

#: Language identification and packing have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:  # the last one's rows are no longer read
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
