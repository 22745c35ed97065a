"""MinHash near-dedup with SetSketch registers: banded retrieval, a likelihood estimate, exact proof."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, private, release, written
from .shingles import shingle_set

#: Bands of ROWS registers: a pair of Jaccard similarity 0.75 is missed with probability
#: (1 - 0.75 ** ROWS) ** BANDS, 2.5e-7, and a more similar one less often.
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Base of the exponential spacing, rate of the elements' variables, largest register value.
BASE, RATE, TOP = 1.02, 20.0, 65535
#: Log-likelihood by which a pair's best similarity must beat all those that link before the
#: pair is given up without proof: four standard deviations. Pairs just above the least
#: similarity that links are given up with probability 3e-5, more similar ones hardly ever.
DOUBT = 8.0
#: Rounds of stars, and the most members and unsettled members of a bucket compared at a time.
STARS, BLOCK, ASKS = 2, 4096, 1024
#: The most members, and about the most shingles of their sets, that one group of the proof
#: holds, and words of the id bitmap.
SHARE, SHINGLES, BITMAP = 1024, 1 << 21, 1 << 18
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75


def _mixers():
    import numpy as np

    rng = np.random.default_rng(17)
    return (rng.integers(0, 1 << 32, (2, REGISTERS), np.uint64).astype(np.uint32) | np.uint32(1))


def sketch(hashes):
    """SetSketch registers of a set of 64-bit hashes (not empty), as uint16.

    Every element has an exponential variable of rate RATE for each register; a register keeps
    ``floor(1 - log_BASE(minimum))``, truncated to 0..TOP. As the value falls with the minimum,
    the sketch of a union is the greater of the registers: sketches merge."""
    import numpy as np

    a, b = _mixers()
    lo, hi = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(lo), 2048):
        x = lo[at : at + 2048, None] * a
        x += hi[at : at + 2048, None] * b
        np.minimum(least, x.min(0), out=least)
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1.0 - np.log(smallest) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(one, other):
    """The sketch of the union of two sketched sets."""
    import numpy as np

    return np.maximum(one, other)


def estimate(one, other, n_one, n_other):
    """Similarity estimates of rows of registers, and by how much log-likelihood the estimate
    beats the best similarity that links. Joint: numbers of registers greater, smaller and
    equal have probabilities p(u - vJ), p(v - uJ) and the rest, with u and v the shares of the
    set sizes and p(x) = -log_BASE(1 - x (BASE - 1) / BASE)."""
    import numpy as np

    more, less = (one > other).sum(1)[:, None], (one < other).sum(1)[:, None]
    same = one.shape[1] - more - less
    u = (n_one / (n_one + n_other))[:, None]
    v = 1.0 - u
    j = np.linspace(0.0, 1.0, 101)[None]
    possible = j <= np.minimum(u / v, v / u) + 1e-9
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    ll = np.where(possible, more * log(up) + less * log(down) + same * log(1.0 - up - down), -np.inf)
    best = np.argmax(ll, 1)
    linking = np.where(j >= PERCENT / 100.0 - 1e-9, ll, -np.inf).max(1)
    top = ll[np.arange(len(ll)), best]
    return best / 100.0, np.where(np.isfinite(linking), top - linking, np.inf)


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import xxhash

        for b in batches:
            n, keys, sketches = [], [], []
            for x in b.column(1):
                h = shingle_set(x.as_py())
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sketches.append(sketch(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(n, np.int64)), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "n", "key", "sketch"])

    return docs.mapInArrow(lean(run), "id long, n long, key binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np

        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, BANDS)
                h = (regs ^ salt) * np.uint64(0xC2B2AE3D27D4EB4F)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0x165667B19E3779F9)
                h ^= h >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)), pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["band", "key", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "band int, key long, rep long")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that may link, with their estimated similarity."""
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT

    def run(batches):
        import numpy as np

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                regs = [np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5)]
                sizes = [part.column(k).to_numpy().astype(np.float64) for k in (2, 3)]
                j, beaten = estimate(*regs, *sizes)
                keep = pa.array(beaten < DOUBT)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(j).filter(keep)], names=["a", "b", "j"])

    return pairs.join(one, "a").join(other, "b").where(near).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long, j double")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, text`` of the rows with some ids and, by chance, of others, which a join drops: a
    bitmap of fixed size of the ids goes to the scan, so that no other text is moved."""
    import numpy as np

    bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP * 64))
    words = ids.groupBy(F.floor(bit / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(BITMAP, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    bitmap = docs.sparkSession.sparkContext.broadcast(table)  # of a fixed size

    def some(batches):
        for b in batches:
            at = b.column(2).to_numpy()
            keep = pa.array((bitmap.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["id", "text"])

    return docs.select("id", "text", bit.alias("bit")).mapInArrow(some, "id long, text string")


def _proved(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Links ``(a, b)`` proved on full sets, as many as connect what is linked.

    ``groups``: ``g, id, c, asks``: inside a group each member that asks is compared exactly with
    all members of other components ``c``, and links that join nothing new are left out. A text
    goes to each of its groups once, and its set is made there once; pairs are never rows."""
    texts = _texts(docs, groups.select("id").distinct())
    rows = groups.join(texts, "id").select("g", "id", "c", "asks", "text")

    def prove(ids, parts, asks, sets):
        import numpy as np

        label = {x: x for x in parts}

        def root(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        sizes = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        mine = np.zeros(int(flat.max()) + 1, np.int32)
        parts = np.array(parts)
        found = []
        for q in np.flatnonzero(asks):
            own = flat[begins[q] : begins[q] + sizes[q]]
            mine[own] = 1
            both = np.add.reduceat(mine[flat], begins)
            mine[own] = 0
            for y in np.flatnonzero((100 * both >= PERCENT * (sizes + sizes[q] - both)) & (parts != parts[q])):
                a, b = root(parts[q]), root(parts[y])
                if a != b:
                    label[max(a, b)] = min(a, b)
                    found.append((ids[q], ids[y]))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        now, held = None, ([], [], [], [])
        for b in batches:
            for g, i, c, asks, text in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                if g != now and held[0]:
                    yield prove(*held)
                    held = ([], [], [], [])
                now = g
                for x, value in zip(held, (i, c, asks, shingle_set(text.as_py())), strict=True):
                    x.append(value)
        if held[0]:
            yield prove(*held)

    return rows.repartition("g").sortWithinPartitions("g", "id").mapInArrow(lean(run), "a long, b long")


class _Links:
    """Proven links and the components they make."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes
        self.edges = self.labels = None

    def stars(self, pairs: DataFrame) -> None:
        """Pair each ``b`` with its smallest ``a`` of another component, and prove it: a hub with
        some SHARE of its members is a group."""
        one = self.across(pairs).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        maybe = written(_estimated(one, self.classes).select("a", "b"))
        sized = maybe.join(self.classes.select(F.col("rep").alias("b"), "n"), "b")
        shares = sized.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / SHARE, F.sum("n") / SHINGLES)).cast("int").alias("ng"))
        dealt = maybe.join(shares, "a").withColumn("g", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("ng"))))
        hubs = dealt.select("g", F.col("a").alias("id"), F.lit(True).alias("asks")).distinct()
        self.prove(self.labelled(hubs.union(dealt.select("g", F.col("b").alias("id"), F.lit(False).alias("asks"))), "id", "c"))

    def prove(self, groups: DataFrame) -> None:
        groups = written(groups.select("g", "id", "c", "asks"))
        if groups.limit(1).count():
            found = written(_proved(self.docs, groups))
            self.edges = found if self.edges is None else self.edges.union(found)
            self.labels = components(self.edges)

    def labelled(self, df: DataFrame, node: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(node))
        own = self.labels.select(F.col("node").alias(node), F.col("component").alias(name))
        return df.join(own, node, "left").withColumn(name, F.coalesce(name, node))

    def across(self, pairs: DataFrame) -> DataFrame:
        return self.labelled(self.labelled(pairs, "a", "_ca"), "b", "_cb").where("_ca <> _cb").select("a", "b")


def _unsettled(still: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups of members that may link across components: ``g, id, c, asks``.

    ``still``: ``band, key, rep, c``, the members of buckets with several components ``c``. A
    bucket's largest component is settled; each other member is compared with all members.
    Large buckets are dealt over blocks of members times blocks of unsettled ones. Pairs stay
    inside the comparison: what leaves it are the members with a pair that their sketches do not
    exclude. A pair that shares several bands is looked at in the first alone."""
    parts = still.join(classes.select("rep", "n"), "rep").groupBy("key", "c").agg(F.count("*").alias("_n"), F.sum("n").alias("_w"))
    modes = parts.groupBy("key").agg(F.max_by(F.struct("c", "_n", "_w"), F.struct("_n", "c")).alias("_m"), F.sum("_n").alias("n"), F.sum("_w").alias("w"))
    blocks = lambda n, most, w: F.ceil(F.greatest(n / most, w / SHINGLES)).cast("int")
    sized = modes.select("key", F.col("_m.c").alias("mode"), blocks(F.col("n"), BLOCK, F.col("w")).alias("ns"), blocks(F.col("n") - F.col("_m._n"), ASKS, F.col("w") - F.col("_m._w")).alias("nq"))
    rows = still.join(sized, "key").join(classes, "rep")
    deal = lambda by, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(by)).cast("int")
    each = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    own = ["band", "rep", "c", "n", "sketch"]
    stored = rows.select("key", deal("ns", 1).alias("sb"), each("nq").alias("qb"), F.lit(0).alias("asks"), (F.col("c") != F.col("mode")).alias("open"), *own)
    asking = rows.where("c <> mode").select("key", each("ns").alias("sb"), deal("nq", 2).alias("qb"), F.lit(1).alias("asks"), F.lit(True).alias("open"), *own)

    def compare(group, held):
        import numpy as np

        band, rep, c, n, asks, unsettled = (np.concatenate([h[k] for h in held]) for k in range(6))
        regs = np.frombuffer(b"".join(x for h in held for x in h[6]), np.uint16).reshape(-1, REGISTERS)
        keys = regs.view(np.uint64)
        s, maybe = np.flatnonzero(asks == 0), np.zeros(len(rep), bool)
        for q in np.flatnonzero(asks == 1):
            y = s[(c[s] != c[q]) & (~unsettled[s] | (rep[s] > rep[q])) & (100 * np.minimum(n[s], n[q]) >= PERCENT * np.maximum(n[s], n[q]))]
            y = y[(keys[y] == keys[q]).argmax(1) == band[q]]
            if len(y):
                _, beaten = estimate(np.broadcast_to(regs[q], (len(y), REGISTERS)), regs[y], np.full(len(y), float(n[q])), n[y].astype(np.float64))
                maybe[y[beaten < DOUBT]] = True
                maybe[q] |= bool((beaten < DOUBT).any())
        asked = set(rep[maybe & (asks == 1)].tolist())
        keep = np.flatnonzero(maybe & ((asks == 1) | ~np.isin(rep, list(asked))))
        if not len(keep):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), group)), pa.array(rep[keep]), pa.array(c[keep]), pa.array(asks[keep] == 1)], names=["g", "id", "c", "asks"])

    def run(batches):
        import numpy as np

        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            group = b.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and group[lo] != now:
                    found = compare(now, held)
                    if found is not None:
                        yield found
                    held = []
                now = group[lo]
                part = b.slice(lo, hi - lo)
                held.append([part.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6, 1, 2)] + [part.column(7).to_pylist()])
        if held:
            found = compare(now, held)
            if found is not None:
                yield found

    dealt = stored.union(asking).select(F.xxhash64("key", "sb", "qb").alias("g"), "asks", "open", *own)
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(lean(run), "g long, id long, c long, asks boolean")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id_col, n_shingles, component_id, kept``.

    Rows are linked when their sets of five-word shingles (A-Z lowered; fewer words as one
    shingle) have 100 * intersection >= 75 * union. ``n_shingles`` is the set's size,
    ``component_id`` the smallest id reachable over links, itself included, ``kept`` whether
    that is the row's own. Null and empty texts, and texts without a word, link with nothing;
    so do null ids, whose component is null and which are kept. Rows with one id are one
    document: repeated rows share its result. Texts of any length are whole: the sets of a group
    that is proved at once have about SHINGLES shingles, or one text. Other columns are not passed on; an empty table
    gives an empty one.

    Rows with equal sets become one class by a partial aggregation. A class has BANDS band keys
    of SetSketch registers. In rounds of stars each class is paired with the smallest class of
    its buckets that is not in its component yet: the likelihood of the two sketches discards
    pairs, the rest is proved on full sets. Then only buckets that still hold several components
    matter; there each class outside the largest component is compared with all others, sketch
    by sketch inside the tasks, and those that may link on full sets. Nothing is capped. Sketches, candidates and
    links are written to the shared folder after each step and never collected.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(_sets(own))
    classes = written(sets.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    sketches = classes.select("rep", "n", "sketch")
    links = _Links(own, sketches)
    buckets = _bands(classes)
    shared = buckets.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("_most")).where("hub < _most").select("key", "hub")
    members = written(buckets.join(shared, "key").select("band", "key", "rep", "hub"))
    for _ in range(STARS):
        links.stars(members.select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    now = links.labelled(members.select("band", "key", "rep"), "rep", "c")
    split = now.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo < _hi").select("key")
    links.prove(_unsettled(written(now.join(split, "key")), sketches))
    result = links.labelled(classes.select("key", "rep"), "rep", "component")
    out = sets.select("id", "n", "key").join(result.select("key", "component"), "key", "left")
    component = F.coalesce("component", "id")
    release(members)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), (F.col("id").isNull() | F.col("id").eqNullSafe(component)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document ``link`` keeps, and of rows alike in id and text one.
    Rows with null ids stay; so do all columns.

    Plan: what to leave out is decided on ids. A bitmap of fixed size of the ids that are left out or
    repeated is joined by broadcast; rows outside it, nearly all, go on from where they lie, the
    others meet the ids in a shuffle."""
    found = link(docs, id_col, text_col).where(F.col(id_col).isNotNull())
    marked = written(found.groupBy(F.col(id_col).alias("id")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"))
    _id, _word, _bits, _text, _kept = private(docs.columns, "id", "word", "bits", "text", "kept")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP * 64))
    word, place = lambda c: F.floor(bit(c) / 64).cast("int"), lambda c: F.pmod(bit(c), F.lit(64)).cast("int")
    words = marked.groupBy(word("id").alias(_word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place("id"))).alias(_bits))
    own = docs.withColumn(_id, F.col(id_col).cast("long"))
    tagged = own.join(F.broadcast(words), word(_id) == F.col(_word), "left").withColumn(_bits, F.coalesce(F.getbit(_bits, place(_id)) == 1, F.lit(False)) & F.col(_id).isNotNull())
    clean = tagged.where(~F.col(_bits)).select(*docs.columns)
    doubtful = tagged.where(_bits).join(marked.select(F.col("id").alias(_id), F.col("kept").alias(_kept)), _id, "left").where(F.coalesce(F.col(_kept), F.lit(True)))
    return clean.union(doubtful.withColumn(_text, F.xxhash64(text_col)).dropDuplicates([_id, _text]).select(*docs.columns))


#: The contract of ``link`` for DuckDB, by comparing all texts that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, coalesce(len(s), 0) AS n FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b FROM r JOIN both_ways ON r.to_id = a),
k AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k ON k.id = doc_id
"""
