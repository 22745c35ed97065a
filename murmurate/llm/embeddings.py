"""Embedding near-dedup: inverted lists, product-quantised residuals, exact cosine rerank."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, lean, release, written

#: The quantisers are fitted on at most SAMPLE rows, those of the smallest hash.
SAMPLE = 16_384
#: One inverted list for so many rows of the largest label, within these bounds: only rows of one
#: label are compared, so more lists would only be more probes.
ROWS_PER_LIST, MIN_LISTS, MAX_LISTS = 256, 8, 4096
#: Subspaces and codewords in each.
SUBSPACES, CODES = 8, 256
#: The most stored rows, and the most queries, that a task compares at a time.
BLOCK = 2048


def _nearest(x, c):
    import numpy as np

    norms = (c * c).sum(1)
    parts = [np.argmin(norms - 2.0 * (x[lo : lo + 1024] @ c.T), 1) for lo in range(0, len(x), 1024)]
    return np.concatenate([np.empty(0, np.int64), *parts])


def kmeans(x, k: int, rounds: int = 12, seed: int = 3):
    """Centroids of ``x``; k-means with empty cells moved to random rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


class Index:
    """Coarse centroids and residual codebooks over unit vectors of ``dim`` numbers."""

    def __init__(self, sample, lists: int):
        import numpy as np

        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, lists)
        residual = sample - self.coarse[_nearest(sample, self.coarse)]
        self.books = np.stack([kmeans(residual[:, s], CODES, 6) if len(residual) else residual[:, s] for s in self.slices()])

    def slices(self):
        w = self.dim // SUBSPACES
        return [slice(m * w, (m + 1) * w) for m in range(SUBSPACES)]

    def encode(self, x):
        """Lists, codes, and the distances that the codes are off by."""
        import numpy as np

        at = _nearest(x, self.coarse)
        r = x - self.coarse[at]
        codes = np.stack([_nearest(r[:, s], self.books[m]) for m, s in enumerate(self.slices())], 1).astype(np.uint8)
        back = np.concatenate([self.books[m][codes[:, m]] for m in range(SUBSPACES)], 1)
        return at, codes, np.sqrt(((r - back) ** 2).sum(1))

    def probes(self, x, at, radius: float):
        """For each row which lists can hold a vector within ``radius`` of it: those whose
        bisecting plane with the row's own list is no farther. No such vector is missed."""
        import numpy as np

        c = self.coarse
        d = (c * c).sum(1) - 2.0 * (x @ c.T)
        gap = np.sqrt(np.maximum((c * c).sum(1)[at][:, None] + (c * c).sum(1) - 2.0 * (c[at] @ c.T), 0.0))
        return d - d[np.arange(len(x)), at][:, None] <= 2.0 * radius * gap + 1e-9

    def asymmetric(self, queries, which: int, codes):
        """Squared distances of exact queries to coded rows of one list, by table lookup:
        |q - c - b|^2 = |q - c|^2 + (|b|^2 + 2 c b) - 2 q b, the middle the same for all queries."""
        import numpy as np

        c, q = self.coarse[which], queries.astype(np.float32)
        out = np.repeat(((queries - c) ** 2).sum(1).astype(np.float32)[:, None], len(codes), 1)
        for m, s in enumerate(self.slices()):
            book = self.books[m]
            out += ((book * book).sum(1) + 2.0 * (book @ c[s])).astype(np.float32)[codes[:, m]]
            out -= np.take(q[:, s] @ (2.0 * book.T).astype(np.float32), codes[:, m], 1)
        return out


def _forest(linked):
    """Smallest column-or-row label of each connected part of a boolean matrix of links; rows
    come first in the numbering. Unlinked rows and columns keep their own."""
    import numpy as np

    q, s = linked.shape
    rows, cols = np.arange(q), np.arange(q, q + s)
    ri, ci = np.nonzero(linked)
    while len(ri):
        before = rows.copy(), cols.copy()
        np.minimum.at(cols, ci, rows[ri])
        np.minimum.at(rows, ri, cols[ci])
        if (rows == before[0]).all() and (cols == before[1]).all():
            break
    return rows, cols


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """Every row's ``id_col, n_links, component_id, kept`` (longs and a boolean).

    Rows are linked when their labels are equal and the cosine of their vectors, in double
    precision, is at least ``threshold``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, itself included, ``kept`` is whether that
    is the row's own. Rows with a null label, id or vector, a null or non-finite component, or
    a vector of zeros link with nothing; equal vectors of one label link whatever the count;
    shorter vectors count as filled up with zeros. Other columns are not passed on; an empty
    table gives an empty one. Vectors of any length are compared whole.

    Equal vectors of a label become one class first, by a partial aggregation. Classes are
    indexed (all of them; quantisers fitted on SAMPLE): list by the nearest coarse centroid,
    product code of the residual. A query probes every list that can hold a link (see
    ``Index.probes``) and reranks every row whose table-lookup distance, less the row's own
    coding error, is within the threshold; neither step can lose a link. Lists of many rows
    are cut into blocks of about BLOCK, each compared with blocks of queries, so that no task
    holds more; what leaves a task are counts and a spanning forest, never pairs.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(F.coalesce(good, F.lit(False)), v).alias("_v"), F.col(label_col).alias("_label"))
    classes = written(rows.where("_v IS NOT NULL").groupBy("_label", "_v").agg(F.min("_id").alias("rep"), F.count("*").alias("mult")))
    largest, dim = classes.groupBy("_label").agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("d")).agg(F.max("n"), F.max("d")).first()
    found = _linked(spark, classes, largest, dim, threshold) if largest else None
    if found is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("tree").alias("b")).distinct())
    result = classes.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "_label", "_v", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.join(result, ["_label", "_v"], "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _linked(spark, classes: DataFrame, largest: int, dim: int, threshold: float) -> DataFrame:
    """``(rep, links, tree)``: per task, linked rows of other classes, and a node of the same part."""
    import numpy as np

    dim = math.ceil(dim / SUBSPACES) * SUBSPACES
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6
    lists = max(MIN_LISTS, min(MAX_LISTS, largest // ROWS_PER_LIST))

    def matrix(arrays):
        x = np.zeros((len(arrays), dim))
        for i, a in enumerate(arrays):
            x[i, : len(a)] = a
        return x

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    sample = classes.select("_v", F.xxhash64("_v").alias("_h")).orderBy("_h", "_v").limit(SAMPLE).select("_v").toArrow()
    index = spark.sparkContext.broadcast(Index(unit(matrix(sample.column(0).to_numpy())), lists))
    label_type = classes.schema["_label"].dataType
    schema = T.StructType([T.StructField("label", label_type), T.StructField("rep", T.LongType()), T.StructField("mult", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("err", T.DoubleType()), T.StructField("probes", T.ArrayType(T.IntegerType()))])
    kept_as = "<f4" if isinstance(classes.schema["_v"].dataType.elementType, T.FloatType) else "<f8"

    def assign(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                raw = matrix(part.column(1).to_numpy(zero_copy_only=False))
                x = unit(raw)
                at, codes, err = index.value.encode(x)
                near = index.value.probes(x, at, radius)
                probes = pa.array([np.flatnonzero(p) for p in near], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array([r.tobytes() for r in raw.astype(kept_as)], pa.binary()), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), probes],
                    names=schema.names,
                )

    indexed = written(classes.select("_label", "_v", F.col("rep").cast("long"), "mult").mapInArrow(lean(assign), schema))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = indexed.groupBy("label", "list").agg(F.count("*").alias("_s"))
    asks = indexed.select("label", "rep", "vec", F.explode("probes").alias("list"))
    asked = asks.groupBy("label", "list").agg(F.count("*").alias("_q"))
    plan = written(sizes.join(asked, ["label", "list"]).select("label", "list", blocks("_s").alias("ns"), blocks("_q").alias("nq")))
    deal = lambda by, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(by)).cast("int")
    each = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    stored = indexed.join(plan, ["label", "list"]).select("label", "list", deal("ns", 1).alias("sb"), each("nq").alias("qb"), "rep", "mult", "vec", "code", "err")
    queries = asks.join(plan, ["label", "list"]).select("label", "list", each("ns").alias("sb"), deal("nq", 2).alias("qb"), "rep", "vec")

    def compare(key, s, q):
        import pandas as pd

        if not len(s) or not len(q):
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "tree": pd.Series(dtype="int64")})
        table, which = index.value, int(key[1])
        sv, qv = (unit(np.frombuffer(b"".join(x), kept_as).astype(np.float64).reshape(len(x), dim)) for x in (s["vec"], q["q_vec"]))
        codes = np.frombuffer(b"".join(s["code"]), np.uint8).reshape(len(s), SUBSPACES)
        reach = ((radius + s["err"].to_numpy()) ** 2 + 1e-5).astype(np.float32)
        linked = np.zeros((len(q), len(s)), bool)
        for lo in range(0, len(q), 256):
            near = table.asymmetric(qv[lo : lo + 256], which, codes) <= reach
            qi, si = np.nonzero(near)
            for at in range(0, len(qi), 1 << 16):
                i, j = qi[at : at + (1 << 16)], si[at : at + (1 << 16)]
                linked[lo + i, j] = np.einsum("ij,ij->i", qv[lo + i], sv[j]) >= threshold
        qr, sr = q["q_rep"].to_numpy(), s["rep"].to_numpy()
        linked &= qr[:, None] != sr[None, :]
        rows, cols = _forest(linked)
        nodes = np.concatenate([qr, sr])
        hit = linked.any(1)
        own = linked.any(0)
        links = linked @ s["mult"].to_numpy()
        return pd.DataFrame({"rep": np.concatenate([qr[hit], sr[own]]), "links": np.concatenate([links[hit], np.zeros(int(own.sum()), np.int64)]), "tree": nodes[np.concatenate([rows[hit], cols[own]])]})

    keys = ["label", "list", "sb", "qb"]
    queries = queries.toDF(*(f"q_{c}" for c in queries.columns))
    found = written(stored.groupBy(*keys).cogroup(queries.groupBy(*(f"q_{c}" for c in keys))).applyInPandas(compare, "rep long, links long, tree long"))
    index.unpersist()
    release(indexed, plan)
    return found


#: The contract of ``link`` for DuckDB, by comparing all rows of a label.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(id, to_id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.to_id = l.a),
c AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
