"""Packing: optimal length buckets over the global histogram, token-budget batches inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

#: Lengths up to this are histogram bins of their own; above, a bin spans 1/EXACT of its
#: power of two, so that the histogram has at most EXACT * 60 bins whatever the lengths.
EXACT = 4096

#: Shards of a bucket: enough to deal any bucket evenly, few enough for the offsets to be broadcast.
SHARDS = 2048


def length_bin(n: Column, exact: int = EXACT) -> Column:
    """The largest length in the bin of ``n``: ``n`` itself up to ``exact``."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - F.log2(F.lit(float(exact)))).cast("long")
    step = F.greatest(step, F.lit(1).cast("long"))
    return F.when(n <= exact, n).otherwise(F.ceil(n / step) * step).cast("long")


def optimal_bounds(lengths, counts, buckets: int) -> list[int]:
    """Bucket boundaries (largest lengths, ascending; the last is the largest of all) that
    minimise the total padding ``sum(count * (boundary - length))`` with at most ``buckets``
    buckets. Among equal costs the smallest boundaries win.

    The cost has the quadrangle inequality, so each layer of the dynamic programme is solved
    by divide and conquer in O(n log n), vectorised over the midpoints of a level."""
    import numpy as np

    order = np.argsort(np.asarray(lengths))
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(x)
    if n == 0:
        return []
    cum, tok = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])

    def cost(i, j):  # bins i..j-1 padded to x[j-1]
        return x[j - 1] * (cum[j] - cum[i]) - (tok[j] - tok[i])

    best = cost(0, np.arange(1, n + 1))
    best = np.concatenate([[0.0], best])
    back = []
    for _ in range(min(buckets, n) - 1):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(left, min(mid - 1, right) + 1)
            v = best[i] + cost(i, mid)
            k = int(np.argmin(v))
            new[mid], arg[mid] = v[k], i[k]
            todo += [(lo, mid - 1, left, int(i[k])), (mid + 1, hi, int(i[k]), right)]
        back.append(arg)
        best = new
    bounds, j = [], n
    for arg in reversed(back):
        bounds.append(int(x[j - 1]))
        j = int(arg[j])
        if j == 0:
            break
    if j:
        bounds.append(int(x[j - 1]))
    return sorted(bounds)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 16384) -> DataFrame:
    """Each row's place in a batch: ``id_col, n_tokens, bucket, bucket_len, batch, slot, padding``.

    ``length`` is a column of tokens (words of ``text_col`` if not given; null counts as 0).
    Buckets are the optimal ones for the histogram of all rows (lengths above ``EXACT`` rounded
    up to bins of relative width 1/``EXACT``, so that boundaries lie on bins and no row is left
    out). Inside a bucket rows are numbered without gaps, by shard of a hash of the id, then id
    and length; ``budget // bucket_len`` consecutive rows (one at least, so that a text beyond
    the budget is a batch of its own, whole) make a batch, and every batch of a bucket but its
    last is full. Null ids and repeated rows are rows like any other and each gets a slot. An
    empty table gives an empty one; other columns are not passed on. Texts of any length count
    whole.

    Plan: texts are read once, for (id, length), which is written and read from there. The histogram's bins (bounded) go to the driver; one shuffle of
    (id, length) by bucket and shard, a window inside each shard, and a broadcast of shard
    offsets, at most ``buckets * SHARDS`` rows. A hot bucket is dealt over all its shards.
    """
    n = F.coalesce(length, F.lit(0)).cast("long") if length is not None else n_words(F.col(text_col))
    own = written(docs.select(F.col(id_col).alias("_id"), n.alias("n_tokens"))).withColumn("_bin", length_bin(F.col("n_tokens")))
    histogram = own.groupBy("_bin").count().collect()
    bounds = optimal_bounds([r["_bin"] for r in histogram], [r["count"] for r in histogram], buckets)
    bound_array = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    bucket = F.size(F.filter(bound_array, lambda b: b < F.col("_bin")))
    placed = own.select(
        "_id", "n_tokens", bucket.alias("bucket"),
        F.get(bound_array, bucket).alias("bucket_len"),
        F.pmod(F.xxhash64("_id", "n_tokens", F.lit(7)), F.lit(SHARDS)).cast("int").alias("_shard"),
    )
    shards = placed.groupBy("bucket", "_shard").count()
    from pyspark.sql import Window

    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("bucket", "_shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("bucket", "_shard").orderBy("_id", "n_tokens")
    ranked = placed.withColumn("_rank", F.row_number().over(inside) - 1)
    at = F.col("_offset") + F.col("_rank")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))))
    return ranked.join(F.broadcast(offsets), ["bucket", "_shard"]).select(
        F.col("_id").alias(id_col), "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bucket_len",
        F.floor(at / capacity).cast("long").alias("batch"), F.pmod(at, capacity).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
