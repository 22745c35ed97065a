"""Quality rules: an isolation forest on rule statistics, its threshold calibrated on labels."""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, private, release, written

#: Trees of a forest, rows a tree sees, and the most rows that forests are fitted on.
TREES, SUBSAMPLE, SAMPLE = 50, 256, 25_600
#: Share of the good labelled rows that all thresholds together may reject, the least by which a
#: threshold's share of bad rows must exceed its share of good ones, and bins of histograms.
MAX_FALSE_REJECTS, MIN_GAIN, BINS = 0.01, 0.02, 4096

_SPACES, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_M = 0x9E3779B97F4A7C15

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct"]
#: Rates and logarithms of the statistics, and the families of them that a forest each sees. Of
#: all at once a forest isolates what is merely rare, such as very long sound texts.
FEATURES = ["word_length", "symbols", "upper", "distinct", "dup_lines", "repeats", "length", "line_length"]
FAMILIES = {"words": ["word_length", "symbols"], "variety": ["word_length", "distinct"], "case": ["upper", "distinct"], "repetition": ["dup_lines", "repeats"], "shape": ["length", "line_length"]}


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first included."""
    import numpy as np

    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = ids[:n].copy()
    for k in range(1, width):
        h *= np.uint64(_M)
        h += ids[k : k + n]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STATS for one text; null has none of anything."""
    if not text:
        return (0,) * len(STATS)
    b = text.encode()
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip(_SPACES)]
    return (
        len(words),
        len(text) - (len(b) - len(b.translate(None, _SPACES))),
        len(b) - len(b.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(b) - len(b.translate(None, _UPPER)),
        len(set(words)),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and STATS of every row's whole text, row by row without a shuffle."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in STATS)])

    def run(batches):
        import numpy as np

        for b in batches:
            found = np.array([text_stats(x.as_py()) for x in b.column(1)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found.T)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def features(s):
    """FEATURES as a numpy array of the named statistics (anything indexable by name)."""
    import numpy as np

    v = {c: np.asarray(s[c], np.float64) for c in STATS}
    words, lines, chars = (np.maximum(v[c], 1) for c in ("n_words", "n_lines", "word_chars"))
    return np.stack(
        [
            v["word_chars"] / words, v["n_symbols"] / words, v["n_upper"] / chars, np.log(np.maximum(v["n_distinct"], 1)) / np.log(np.maximum(words, 2)),
            v["n_dup_lines"] / lines, v["n_repeat_words"] / words, np.log(words), np.log(words / lines),
        ], 1,
    )


def average_path(n: int) -> float:
    """The mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> list[tuple]:
    """Isolation trees over rows ``x``: arrays of (feature, split, left child, leaf path)."""
    import numpy as np

    rng, forest = np.random.default_rng(seed), []
    n = min(subsample, len(x))
    depth = max(1, math.ceil(math.log2(max(n, 2))))
    for _ in range(trees):
        rows = x[rng.choice(len(x), n, replace=False)]
        f, s, child, path = [0], [0.0], [-1], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            at, part, d = todo.pop()
            lo, hi = part.min(0), part.max(0)
            wide = np.flatnonzero(hi > lo)
            if d >= depth or len(part) <= 1 or not len(wide):
                path[at] = d + average_path(len(part))
                continue
            k = int(rng.choice(wide))
            cut = float(rng.uniform(lo[k], hi[k]))
            f[at], s[at], child[at] = k, cut, len(f)
            f += [0, 0]
            s += [0.0, 0.0]
            child += [-1, -1]
            path += [0.0, 0.0]
            left = part[:, k] < cut
            todo += [(child[at], part[left], d + 1), (child[at] + 1, part[~left], d + 1)]
        forest.append((np.array(f), np.array(s), np.array(child), np.array(path)))
    return forest


def anomaly(forest: list[tuple], x, subsample: int = SUBSAMPLE):
    """Scores in (0, 1]: 2 ** (-mean path / average path); larger is more anomalous."""
    import numpy as np

    if not len(x) or not forest:
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for f, s, child, path in forest:
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(child[at] >= 0)
        while len(live):
            a = at[live]
            at[live] = child[a] + (x[live, f[a]] >= s[a])
            live = live[child[at[live]] >= 0]
        total += path[at]
    return 2.0 ** (-total / len(forest) / max(average_path(subsample), 1e-9))


def _all(conditions):
    return functools.reduce(lambda a, b: a & b, conditions)


def best_bin(good, bad, most: float, all_good: float | None = None, all_bad: float | None = None) -> int:
    """The bin from which on rows are rejected: of those that reject at most the share ``most`` of
    the good rows, the one with the largest share of bad rows less share of good rows rejected
    (the highest on ties); past the last bin where that is under MIN_GAIN. Shares are of the
    rows in the bins, or of as many as given."""
    import numpy as np

    if not good.sum() or not bad.sum():
        return len(good)
    lost, caught = good[::-1].cumsum()[::-1] / (all_good or good.sum()), bad[::-1].cumsum()[::-1] / (all_bad or bad.sum())
    gain = np.where(lost <= most, caught - lost, -1.0)
    return len(gain) - 1 - int(np.argmax(gain[::-1])) if gain.max() >= MIN_GAIN else len(good)


def _sample(rows: DataFrame, n: int, most: int):
    """At most ``most`` of ``n`` rows, those of the smallest ``_h``: a bound on the hash lets few
    more through, so that what tasks and the driver sort does not grow with the table."""
    share = 1.25 * most / max(n, 1) + 1e-9
    while True:
        share = min(1.0, share)
        near = rows if share == 1.0 else rows.where(F.col("_h") < int((2 * share - 1) * (2**63 - 1)))
        found = near.orderBy(*rows.columns).limit(most).toPandas()
        if share == 1.0 or len(found) == most:
            return found
        share *= 4


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trees: int = TREES, subsample: int = SUBSAMPLE, max_false_rejects: float = MAX_FALSE_REJECTS) -> DataFrame:
    """Every row's ``id_col``, STATS, ``base_failed``, ``score`` and ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words inside 8-word windows
    found twice or more. The others pass an isolation forest for each of FAMILIES, over rates
    and logarithms of all statistics. Forests are fitted on at most SAMPLE rows, those of the
    smallest hash of id and statistics among the rows that pass the base rules; isolation
    trees need no more. Thresholds come from histograms of all labelled rows (1 good, 0 bad) that
    pass the base rules: the forest that separates them best (see ``best_bin``) gets one, then
    the best among the rows still kept, and so on, while all together reject at most
    ``max_false_rejects`` of the good ones. A forest that does not tell good from bad rejects
    nothing, nor does any without labelled rows. ``score`` is the largest
    anomaly score as a share of its threshold; a row that passed the base rules is kept if it is under 1.

    Null text has no words and fails; texts of any length are judged whole; null ids are kept as
    they are and match no label; repeated rows, and rows with equal statistics, get the same
    result each; several labels of an id count each. Other columns are not passed on; an empty
    table gives an empty one.

    Plan: texts are read once, and their statistics written; scores are written once and read
    for histograms and verdict. Labels join by id (bins of scores only). The driver gets the sample and,
    at most six times, histograms of ``BINS`` bins, whatever the size of the table.
    """
    import numpy as np

    spark = docs.sparkSession
    stats = written(statistics(docs, id_col, text_col))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passing = stats.where(~failed)
    rows = _sample(passing.select(F.xxhash64(id_col, *STATS).alias("_h"), *STATS), passing.count(), SAMPLE)
    x = features(rows)
    columns = {f: [FEATURES.index(c) for c in names] for f, names in FAMILIES.items()}
    forests = {f: grow(x[:, at], trees, subsample, 11 + i) if len(x) else [] for i, (f, at) in enumerate(columns.items())}
    shared, size = spark.sparkContext.broadcast(forests), min(subsample, len(x))
    names = private(stats.columns, *FAMILIES)
    schema = T.StructType([*stats.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches):
        for b in batches:
            x = features({c: b.column(b.schema.get_field_index(c)).to_numpy() for c in STATS})
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(anomaly(shared.value[f], x[:, at], size)) for f, at in columns.items())], names=schema.names)

    scored = written(stats.mapInArrow(lean(run), schema))
    shared.unpersist()
    release(stats)
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    bins = written(scored.where(~failed).join(known, F.col(id_col) == F.col("_id")).select("_label", *(F.floor(F.col(c) * BINS).cast("int").alias(c) for c in names)))
    cuts, budget = dict.fromkeys(names, BINS + 1), max_false_rejects
    all_good = None
    while True:  # at most once for each forest: the best one among the rows still kept
        still = bins.where(_all(F.col(c) < k for c, k in cuts.items()))
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).alias("bin")) for i, c in enumerate(names))))
        good, bad = np.zeros((len(names), BINS + 1)), np.zeros((len(names), BINS + 1))
        for r in still.select("_label", each.alias("_e")).groupBy("_e.f", "_e.bin").agg(F.sum("_label").alias("good"), F.count("*").alias("n")).collect():
            good[r["f"], r["bin"]] += r["good"]
            bad[r["f"], r["bin"]] += r["n"] - r["good"]
        if all_good is None:
            all_good, all_bad = max(1.0, good[0].sum()), max(1.0, bad[0].sum())
        best = None
        for i, c in enumerate(names):
            k = best_bin(good[i], bad[i], budget, all_good, all_bad) if cuts[c] > BINS else BINS + 1
            if k <= BINS and (best is None or bad[i][k:].sum() / all_bad - good[i][k:].sum() / all_good > best[0]):
                best = bad[i][k:].sum() / all_bad - good[i][k:].sum() / all_good, c, k, good[i][k:].sum() / all_good
        if best is None:
            break
        cuts[best[1]] = best[2]
        budget -= best[3]
    release(bins)
    thresholds = [cuts[c] / BINS for c in names]
    score = F.greatest(*(F.col(c) / F.lit(t) for c, t in zip(names, thresholds, strict=True)))
    return scored.withColumn("score", score).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") < 1)).drop(*names)
