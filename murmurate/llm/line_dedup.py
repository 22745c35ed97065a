"""Line dedup over overlapping windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, private, written

WINDOW = 3


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``text_col`` rid of repeated windows, and ``n_lines``, ``n_removed`` (ints).

    A window is three consecutive lines with a word (lines are cut at line feeds and compared
    exactly; lines without a word are passed over and stay). Of equal windows the first by
    (id, place) stays; the lines of every later one are removed, overlapping windows merged.
    Windows are judged on the input. Null text stays null with no lines; texts of fewer than
    three such lines are unchanged; null ids come first. Rows alike in id and text are one
    document and get the same result. Other columns stay, whatever their names; ``n_lines`` and ``n_removed``
    replace columns of these names. Long texts are judged whole: a text is one row, its lines
    an array. An empty table gives an empty one.

    Plan: windows travel as two 64-bit hashes with seeds of their own, id and place; repeated
    ones are found by a partial aggregation, so that a hot window costs each task one row.
    Joining back moves repeated windows alone. Texts are shuffled once, by id.
    """
    _id, _t, _lines, _w, _starts, _gone, _id2, _t2 = private(docs.columns, "id", "t", "lines", "w", "starts", "gone", "id2", "t2")
    lines = F.split(F.col(text_col), "\n", -1)
    worded = F.filter(F.transform(F.col(_lines), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(WORD))
    hashed = lambda i: [F.xxhash64(F.lit(seed), *(F.get(_w, i + k)["line"] for k in range(WINDOW))).alias(f"h{seed}") for seed in (1, 2)]
    spans = F.when(F.size(_w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(_w) - WINDOW), lambda i: F.struct(i.alias("i"), *hashed(i))))
    # Arrays that lambdas use stand in projections of their own, each used there more than
    # once, so that none is computed anew for every element.
    base = docs.select(F.col(id_col).alias(_id), F.xxhash64(text_col).alias(_t), lines.alias(_lines)).select(_id, _t, worded.alias(_w))
    windows = written(base.select(_id, _t, F.inline_outer(spans)).where("i IS NOT NULL"))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct(_id, "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(F.struct(_id, "i") > F.col("first"))
    starts = later.groupBy(_id, _t).agg(F.collect_set("i").alias(_starts))
    own = docs.drop("n_lines", "n_removed").withColumns({_id: F.col(id_col), _t: F.xxhash64(text_col)})
    s = starts.select(F.col(_id).alias(_id2), F.col(_t).alias(_t2), _starts)
    joined = own.join(s, F.col(_id).eqNullSafe(F.col(_id2)) & F.col(_t).eqNullSafe(F.col(_t2)), "left")
    out = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = joined.withColumn(_lines, lines).withColumn(_w, F.when(F.col(_starts).isNotNull(), worded))
    gone = F.array_distinct(F.flatten(F.transform(_starts, lambda i: F.array(*(F.get(_w, i + k)["at"] for k in range(WINDOW))))))
    rows = rows.withColumn(_gone, gone)
    kept = F.array_except(F.sequence(F.lit(0), F.size(_lines) - 1), F.col(_gone))
    text = F.when(F.col(_gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(_lines, i)), "\n"))
    return rows.select(
        *(text.alias(c) if c == text_col else F.col(c) for c in out),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines)).alias("n_lines"),
        F.coalesce(F.size(_gone), F.lit(0)).alias("n_removed"),
    )


#: The contract of ``dedup_lines`` for DuckDB, with texts as digests.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, text, ls,
         list_filter(range(len(ls)), lambda i: regexp_matches(ls[i + 1], '[^\x20\x09-\x0D]')) AS ps FROM l),
x AS (
  SELECT doc_id, ps, ls, unnest(range(len(ps) - 2)) AS i FROM w WHERE len(ps) >= 3),
y AS (
  SELECT doc_id, ps, i, ls[ps[i + 1] + 1] || chr(10) || ls[ps[i + 2] + 1] || chr(10) || ls[ps[i + 3] + 1] AS win FROM x),
z AS (
  SELECT doc_id, ps, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM y),
g AS (
  SELECT doc_id, list_distinct(flatten(list([ps[i + 1], ps[i + 2], ps[i + 3]]))) AS gone FROM z WHERE n > 1 GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.ls), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN l.text ELSE
         array_to_string(list_transform(list_filter(range(len(l.ls)), lambda i: NOT list_contains(gone, i)), lambda i: l.ls[i + 1]), chr(10)) END) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id)
"""
