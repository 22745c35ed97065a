"""LM scoring: a gated recurrent model over frequent words and classes of rare ones."""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, release, written
from .gru import GRU

#: The most words whose counts are broadcast, none longer than HEAD_BYTES; those of rarer or longer words are joined.
HEAD, HEAD_BYTES = 200_000, 64
#: Words that the softmax tells apart, and classes of all others.
WORDS, TAILS = 2048, 32
#: The recurrent model learns from every training text, by as many replicas as there are
#: REPLICA_TOKENS, once in each of ROUNDS. Replicas are averaged by FAN at a time.
REPLICA_TOKENS, ROUNDS, FAN = 4_000_000, 1, 64
#: Tokens learnt from at a time, and scored: so many that a long text leaves no lanes idle.
BATCH_TOKENS, SCORE_TOKENS = 800_000, 4_000_000
#: Tokens, or one text more, whose words are looked up at a time.
ENCODE_TOKENS = 65_536


def held_out(doc_id) -> bool:
    """Whether the remainder of crc32(id as text) by 10 is 0; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tail_class(word: bytes) -> int:
    """The class of a rare word: its last byte modulo TAILS, which tells scripts, endings and
    punctuation apart."""
    return word[-1] & (TAILS - 1)


class Vocabulary:
    """Frequent words with their counts, and the model's symbols: the first words are told
    apart, all others are classes."""

    def __init__(self, words: list[bytes], counts, n: int, v: int, ends: int, tail_tokens, tail_words):
        import numpy as np

        self.n, self.v, self.ends = n, v, ends
        self.index = {w: i for i, w in enumerate(words)}
        self.counts = np.asarray(counts, np.int64)
        self.weights = self.counts[:WORDS].tolist()
        k = len(self.weights)
        self.tail_tokens, self.tail_words = np.asarray(tail_tokens, np.float64), np.asarray(tail_words, np.float64)
        self.base_total = n + 0.1 * (v + 1)
        self.tail_total = self.tail_tokens + 0.1 * (self.tail_words + 1)
        cls = np.array([tail_class(w) for w in words], np.int64)
        told = np.arange(len(words)) < k
        # Of the words, then of the end, then (at -1) of any other word: the symbol, the base's log10
        # probability, and that of a frequent word inside its tail class, 0 for words told apart.
        self.index[None] = len(words)
        self.symbol = np.concatenate((np.where(told, np.arange(len(words)) + 1, k + 1 + cls), [0, 0])).astype(np.int16)
        self.base = np.concatenate((np.log10((self.counts + 0.1) / self.base_total), [math.log10((ends + 0.1) / self.base_total), 0]))
        self.inside = np.concatenate((np.where(told, 0.0, np.log10((self.counts + 0.1) / self.tail_total[cls])), [0, 0]))
        self.k = k

    def prior(self):
        import numpy as np

        c = np.concatenate(([self.ends], self.counts[: self.k], self.tail_tokens)) + 0.1
        return np.log(c / c.sum())

    def encode(self, words: list[bytes | None]):
        """Symbols and numbers of words, None being the end of a text; numbers of others than
        frequent ones are -1."""
        import numpy as np

        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        symbols = self.symbol[at]
        rare = np.flatnonzero(at < 0)
        if len(rare):
            symbols[rare] = [self.k + 1 + tail_class(words[i]) for i in rare.tolist()]
        return symbols, at


def _counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over training texts, each task's counts added up before they travel."""

    def run(batches):
        from collections import Counter

        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not held_out(doc_id) and text.is_valid:
                    seen.update(text.as_py().encode().lower().split())
                    if len(seen) > 300_000:
                        yield out()
                        seen.clear()
        yield out()

    return docs.mapInArrow(lean(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _head(least: int):
    """Whether a word's count is broadcast."""
    return (F.col("c") >= least) & (F.octet_length("word") <= HEAD_BYTES)


def _vocabulary(docs: DataFrame, counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of a frequent word."""
    import numpy as np

    # Bins of counts, at most 64 * 16: the least count with no more than HEAD words at or above.
    bins = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum("c").alias("tokens")).orderBy(F.desc("bin")).collect()
    least, kept = (bins[0]["least"] + bins[0]["n"] if bins else 1), 0
    for r in bins:
        kept += r["n"]
        if kept > HEAD:
            break
        least = r["least"]
    ids = docs.select(F.coalesce(F.col(docs.columns[0]).cast("string"), F.lit("")).alias("id"))
    ends = ids.where(F.crc32(F.col("id").cast("binary")) % 10 != 0).count()
    rows = counts.where(_head(least)).orderBy(F.desc("c"), "word").toArrow()
    words, c = [w.encode() for w in rows.column(0).to_pylist()], rows.column(1).to_numpy()
    tokens, kinds = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    last = F.conv(F.right(F.hex(F.col("word").cast("binary")), F.lit(2)), 16, 10).cast("int")
    for r in counts.groupBy((last % TAILS).alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[r["t"]], kinds[r["t"]] = r["c"], r["n"]
    for w, k in zip(words[:WORDS], c[:WORDS].tolist(), strict=True):
        tokens[tail_class(w)] -= k
        kinds[tail_class(w)] -= 1
    n, v = sum(r["tokens"] for r in bins) + ends, sum(r["n"] for r in bins) + (ends > 0)
    return Vocabulary(words, c, n, v, ends, tokens, kinds), least


def _batches(column, limit: int):
    """Slices of a column of symbols, of about ``limit`` tokens each: where it begins, its arrays."""
    import numpy as np

    lo, part, tokens = 0, [], 0
    for i, x in enumerate(column):
        part.append(np.frombuffer(x.as_buffer(), np.int16))
        tokens += len(part[-1]) + 1
        if tokens >= limit:
            yield lo, part
            lo, part, tokens = i + 1, [], 0
    if part:
        yield lo, part


def _trained(encoded: DataFrame, id_col: str, v: Vocabulary, rounds: int) -> GRU:
    """A model averaged over replicas, each of which learns from its share of all training
    texts; rounds begin with the average of the last one. Rounds deal and read the texts'
    symbols, of two bytes each."""
    import numpy as np

    spark = encoded.sparkSession
    model = GRU(v.weights, TAILS, v.prior())
    weights, names = v.weights, sorted(model.p)
    replicas = max(1, math.ceil(v.n / REPLICA_TOKENS))
    replica = F.pmod(F.shiftright(F.xxhash64(id_col, F.lit(9)), 20), F.lit(replicas)).cast("int")
    learnt = encoded.where(~F.col("held_out") & (F.col("n_tokens") > 1)).select(id_col, replica.alias("replica"), "symbols")
    dealt = learnt.repartitionById(replicas, F.col("replica")).sortWithinPartitions("replica", id_col).select("replica", "symbols")
    kind = "replica int, seen long, " + ", ".join(f"{k} binary" for k in names)

    def row(replica, seen, p):
        return pa.RecordBatch.from_arrays([pa.array([replica], pa.int32()), pa.array([seen], pa.int64()), *(pa.array([p[k].astype(np.float32).tobytes()], pa.binary()) for k in names)], names=["replica", "seen", *names])

    def average(key, group):
        total, weight = {k: 0.0 for k in names}, 0
        for r in group.to_batches(max_chunksize=1):
            seen = r.column(1)[0].as_py()
            weight += seen
            for i, k in enumerate(names):
                total[k] = total[k] + seen * np.frombuffer(r.column(2 + i)[0].as_buffer(), np.float32).astype(np.float64)
        return pa.Table.from_batches([row(key[0].as_py(), weight, {k: x / weight for k, x in total.items()})])

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model.p)

        def run(batches):
            net, squares, seen, at, held, tokens = GRU(weights, TAILS), None, 0, 0, [], 0
            net.p = {k: x.copy() for k, x in shared.value.items()}
            for b in batches:
                for _, part in _batches(b.column(1), BATCH_TOKENS):
                    at = b.column(0)[0].as_py()
                    held += part
                    tokens += sum(len(x) + 1 for x in part)
                    if tokens >= BATCH_TOKENS:
                        squares, seen, held, tokens = net.train(held, squares=squares), seen + tokens, [], 0
            if held:
                net.train(held, squares=squares)
            if seen + tokens:
                yield row(at, seen + tokens, net.p)

        found = written(dealt.mapInArrow(lean(run), kind))
        n = replicas
        while n > 1:  # a tree of averages on the executors
            n = math.ceil(n / FAN)
            merged = written(found.withColumn("replica", (F.col("replica") % n).cast("int")).groupBy("replica").applyInArrow(lean(average), kind))
            release(found)
            found = merged
        rows = found.collect()  # one at most
        release(found)
        shared.unpersist()
        if rows:
            model.p = {k: np.frombuffer(rows[0][k], np.float32).reshape(model.p[k].shape).copy() for k in names}
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Every row's ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words of the whole text (A-Z lowered; null is empty), then one end. Rows are
    held out when crc32(id as text) mod 10 is 0; the others are learnt from. ``n_known`` counts tokens with a
    count above 0 in training, ``train_tokens`` all training tokens. ``base_score`` sums
    log10((c + 0.1) / (N + 0.1 (V + 1))). ``score`` is the log10 probability of the whole text by
    the recurrent model: class, then word inside it. The WORDS most frequent words are told
    apart by the softmax; others belong to TAILS classes by their last byte, inside which a word
    has (c + 0.1) / (n + 0.1 (v + 1)), n and v being the class's tokens and words in training:
    counts of all training texts. Null ids count as empty text. Repeated rows are scored each.
    Without training rows the model is the initial one. Other columns are not passed on.

    Texts of any length are whole: the state is carried through all windows of a text. Ties among
    words of one count go by their bytes, so that results do not depend on the order of rows.

    Texts are read twice, for counts and for symbols; the model learns from and scores symbols.
    Replicas follow the number of training tokens, and are averaged in a tree on the executors;
    the driver gets one. Counts of at most HEAD words are broadcast; occurrences of rarer
    words meet their counts in a shuffle, by word.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col), F.col(text_col))
    counts = written(_counts(own))
    v, least = _vocabulary(own, counts)
    vocabulary = spark.sparkContext.broadcast(v)
    small = [T.StructField(id_col, own.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("_row", "n_tokens", "_known")] + [T.StructField("_base", T.DoubleType())]
    rare_words = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("t", T.IntegerType())]))
    schema = T.StructType([*small, T.StructField("_inside", T.DoubleType()), T.StructField("symbols", T.BinaryType()), T.StructField("_rare", rare_words)])

    def encode(batches):
        from collections import Counter

        import numpy as np
        from pyspark import TaskContext

        vocab = vocabulary.value
        row = TaskContext.get().partitionId() << 33
        rare_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32()), ("t", pa.int32())]))

        def group(ids, tokens, stops):
            symbols, at = vocab.encode(tokens)
            starts = np.array([0, *stops[:-1]])
            missing = at < 0
            offsets, words, times, classes = [0], [], [], []
            for a, z, n in zip(starts.tolist(), stops, np.add.reduceat(missing, starts, dtype=np.int64).tolist(), strict=True):
                if n:
                    for w, k in Counter([tokens[a + i] for i in np.flatnonzero(missing[a:z]).tolist()]).items():
                        words.append(w), times.append(k), classes.append(tail_class(w))
                offsets.append(len(words))
            known = np.add.reduceat(at >= 0, starts, dtype=np.int64) - (vocab.ends == 0)
            rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int32()), pa.array(classes, pa.int32())], names=["word", "n", "t"]))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([held_out(x) for x in ids.to_pylist()]), pa.array(np.arange(row, row + len(ids))), pa.array(np.diff(stops, prepend=0)), pa.array(known), pa.array(np.add.reduceat(vocab.base[at], starts)),
                 pa.array(np.add.reduceat(vocab.inside[at], starts)), pa.array([symbols[a : z - 1].tobytes() for a, z in zip(starts.tolist(), stops, strict=True)], pa.binary()), rare.cast(rare_type)],
                names=schema.names,
            )

        for b in batches:
            lo, tokens, stops = 0, [], []
            for i, x in enumerate(b.column(1)):
                tokens += (x.as_py() or "").encode().lower().split()
                tokens.append(None)
                stops.append(len(tokens))
                if len(tokens) >= ENCODE_TOKENS or i == b.num_rows - 1:
                    yield group(b.column(0).slice(lo, len(stops)), tokens, stops)
                    row += len(stops)
                    lo, tokens, stops = i + 1, [], []

    encoded = written(own.mapInArrow(lean(encode), schema))
    vocabulary.unpersist()
    model = spark.sparkContext.broadcast(_trained(encoded, id_col, v, rounds).p)
    weights, scored_schema = v.weights, T.StructType([*small, T.StructField("_score", T.DoubleType())])

    def run(batches):
        net = GRU(weights, TAILS)
        net.p = model.value
        for b in batches:
            for lo, part in _batches(b.column(len(small) + 1), SCORE_TOKENS):
                own_rows = b.slice(lo, len(part))
                scores = net.score(part) / math.log(10) + own_rows.column(len(small)).to_numpy()
                yield pa.RecordBatch.from_arrays([*own_rows.columns[: len(small)], pa.array(scores)], names=scored_schema.names)

    scored = written(encoded.drop("_rare").mapInArrow(lean(run), scored_schema))
    model.unpersist()
    tail_total = F.array(*(F.lit(float(x)) for x in v.tail_total))
    rare = encoded.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", "r.n", "r.t")
    c = F.coalesce("c", F.lit(0))
    sums = (
        rare.join(counts.where(~_head(least)), "word", "left")
        .groupBy("_row").agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("_rare_known"),
            F.sum(F.col("n") * F.log10((c + 0.1) / v.base_total)).alias("_rare_base"),
            F.sum(F.col("n") * F.log10((c + 0.1) / F.get(tail_total, F.col("t")))).alias("_rare_score"),
        )
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.join(sums, "_row", "left").select(
        id_col, "held_out", "n_tokens", (F.col("_known") + zero("_rare_known")).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("_base") + zero("_rare_base")).alias("base_score"), (F.col("_score") + zero("_rare_score")).alias("score"),
    )
