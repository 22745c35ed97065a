"""Language identification by Bayesian fusion of text, declared language and host priors."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, private, written

#: Hash buckets of byte trigrams; the model has this many counts for each language.
BUCKETS = 1 << 14
#: The most languages a model tells apart: its table of BUCKETS * languages is broadcast. Of
#: more, those with the least labelled text are one, OTHER, with the sum of their counts.
MAX_LANGUAGES, OTHER = 128, "other"
#: Trigrams looked up at a time.
_STEP = 1 << 14
#: Neighbouring trigrams are no independent evidence: a text counts as this many at most.
MAX_EVIDENCE = 60.0
#: Pseudo-counts: a level of the hierarchy against its parent, and a declaration.
ALPHA, BETA = 8.0, 2.0
#: A text is rejected below this posterior, or when the mean log-likelihood of its trigrams lies
#: under the mean of the language's own by this many standard deviations of a trigram: texts of
#: another script do, texts with names, numbers or phrases of another language do not.
MIN_POSTERIOR, MAX_SDS = 0.5, 5.5
#: It is also rejected where no language competes better: each bucket alike, with NONE as its
#: prior, against the language's trigrams of which UNIFORM are mixed with such buckets. An
#: unseen trigram costs log(UNIFORM) against it, however large the corpus.
NONE, UNIFORM = 0.01, 0.05

_TAG = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")
_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b"
_MULTI_SUFFIXES = r"\.(?:co|com|org|net|ac|gov|edu)\.[a-z]{2}$"


def host_levels(url: Column) -> list[Column]:
    """Host, registered domain and address suffix of a URL, lower case; null without a host.

    The domain is the suffix and one label more; the suffix is the last label, or two where
    the last but one is a customary second-level label under a country."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    suffix = F.when(host.rlike(_MULTI_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(host.rlike(_MULTI_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return [host, domain, suffix]


def declared_language(html: Column) -> Column:
    """The primary subtag of the lang attribute of the html element, or null."""
    return F.lower(F.nullif(F.regexp_extract(html, _DECLARED, 1), F.lit("")))


def plain_text(html: str) -> str:
    """Markup without scripts, styles, comments, tags and entities."""
    return _TAG.sub(" ", html)


def trigram_steps(text: str):
    """Bucket numbers of the byte trigrams of the letters of a text, lower case, words apart, in
    order, _STEP at a time: a long text costs no more memory than its bytes."""
    import numpy as np

    b = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letter, b, np.uint8(32))
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
    for lo in range(0, len(b) - 2, _STEP):
        x = b[lo : lo + _STEP + 2].astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield (h >> np.uint32(18)).astype(np.int64)


def trigrams(text: str):
    """All bucket numbers of ``trigram_steps``."""
    import numpy as np

    return np.concatenate([np.empty(0, np.int64), *trigram_steps(text)])


class Model:
    """Log-probabilities of trigram buckets, with the mean and spread of labelled texts, and
    log-odds of buckets against no language."""

    def __init__(self, languages, counts):
        import numpy as np

        self.languages = languages
        c = np.asarray(counts, np.float64) + 0.05
        self.logp = np.log(c / c.sum(1, keepdims=True)).T.copy() if len(languages) else np.zeros((BUCKETS, 0))
        found = np.asarray(counts, np.float64)
        share = found / np.maximum(found.sum(1, keepdims=True), 1) if len(languages) else np.zeros((0, BUCKETS))
        self.odds = np.log((1 - UNIFORM) * share * BUCKETS + UNIFORM).T.copy()
        p = np.exp(self.logp)
        self.mean = (p * self.logp).sum(0)
        self.sd = np.sqrt(np.maximum((p * self.logp**2).sum(0) - self.mean**2, 1e-12))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MAX_LANGUAGES) -> Model:
    """A model from all rows with a language and a text, whole texts of any length, counted where
    they lie: tasks emit a row for each language and bucket they saw, which are added up by a
    partial aggregation. Texts without letters add nothing; repeated rows count each. The driver
    gets at most ``most`` * BUCKETS counts; of more languages, those with the least trigrams (on
    ties the later in order) are OTHER together. Without rows the model has no language."""
    import numpy as np

    def run(batches):
        seen: dict[str, np.ndarray] = {}

        def out():
            for lang, found in seen.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(found[at])], names=["lang", "bucket", "n"])
            seen.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                found = seen.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                for at in trigram_steps(text.as_py()):
                    found += np.bincount(at, minlength=BUCKETS)
                if len(seen) > MAX_LANGUAGES:
                    yield from out()
        yield from out()

    counts = written(
        labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
        .mapInArrow(lean(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most + 1).collect()
    if len(totals) > most:
        apart = [r["lang"] for r in totals[: most - 1]]
        counts = counts.withColumn("lang", F.when(F.col("lang").isin(apart), F.col("lang")).otherwise(OTHER)).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    found = np.zeros((len(rows), BUCKETS))
    for k, r in enumerate(rows):
        found[k, r["at"]] = r["n"]
    return Model([r["lang"] for r in rows], found)


def fuse(rows: DataFrame, model: Model, text: Column, declared: Column, levels: list[Column], keep: list[Column], markup: bool = False, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """The columns ``keep`` of each row, and ``text_lang, declared, language, posterior, kept``.

    Evidence: trigram likelihoods of the whole text (weighed as at most MAX_EVIDENCE trigrams);
    the declared language, by how often rows with such a declaration are of each language by
    their text; and a prior for the row's place, from its ``levels`` (finest first, the last the
    address suffix or whatever is coarsest): each level's counts are smoothed by ``alpha`` rows
    of its parent's distribution, the coarsest by the distribution of all rows. Counts are sums of text
    posteriors from grouped aggregations; a row's own share is taken out of them first.

    ``language`` is the one of the greatest product (the first in order on ties), ``posterior``
    its share, 6 decimals. ``kept`` is false, and the row rejected, if the text is null or has no letters
    (``language`` null then), if the posterior is below MIN_POSTERIOR, or if the text is unlike
    any text of the language or more like no language than like any. Null or odd declarations count as none; a null level is a place
    of its own. Null ids and repeated rows are rows like any other. Without languages all rows
    are rejected. Columns of ``keep`` with one of the names above are replaced; other names cannot
    clash. Long texts count whole, in bounded memory.

    Plan: texts are read once, beside the training pass; what follows moves one small row for
    each row. Every level's counts are partial aggregations; the join of places splits under
    AQE where one host has many rows.
    """
    spark = rows.sparkSession
    languages, shared = model.languages, spark.sparkContext.broadcast(model)
    k = len(languages)
    passed = rows.select(*keep)
    own = [c for c in passed.columns if c not in ("text_lang", "declared", "language", "posterior", "kept")]
    level_names = private(own, *(f"level{i}" for i in range(len(levels)))) if levels else []
    _text, _ll, _post, _odd, _some, _s = private(own, "text", "ll", "post", "odd", "some", "s")
    _cd, _nd = private(own, "cd", "nd")
    _c, _n, *_ = private(own, "c", "n", *(f"{x}{i}" for i in range(len(levels)) for x in "cn"))
    subtag = F.when(declared.rlike("^[a-z]{2,3}$"), declared).otherwise("")
    source = rows.select(*(c for c, n in zip(keep, passed.columns, strict=True) if n in own), text.alias(_text), subtag.alias("declared"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in zip(levels, level_names, strict=True)))
    slim = [c for c in source.columns if c != _text]
    schema = T.StructType([*(source.schema[c] for c in slim), T.StructField(_ll, T.ArrayType(T.DoubleType())), T.StructField(_post, T.ArrayType(T.DoubleType())), T.StructField(_odd, T.DoubleType()), T.StructField(_some, T.DoubleType())])

    def run(batches):
        import numpy as np

        m = shared.value
        for b in batches:
            lls, posts, odd, some = [], [], [], []
            for x in b.column(b.schema.get_field_index(_text)):
                value = x.as_py()
                n, mean, odds = 0, np.zeros(k), np.zeros(k)
                for at in trigram_steps(plain_text(value) if markup else value) if value and k else ():
                    n += len(at)
                    mean += m.logp[at].sum(0)
                    odds += m.odds[at].sum(0)
                if not n:
                    lls.append(None), posts.append(None), odd.append(None), some.append(None)
                    continue
                mean, odds = mean / n, odds / n
                ll = mean * min(n, MAX_EVIDENCE)
                p = np.exp(ll - ll.max())
                best = int(np.argmax(mean))
                odd.append(float((m.mean[best] - mean[best]) / m.sd[best]))
                some.append(float(odds.max() * min(n, MAX_EVIDENCE) - np.log(NONE)))
                lls.append(ll), posts.append(p / p.sum())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in slim), pa.array(lls, pa.list_(pa.float64())), pa.array(posts, pa.list_(pa.float64())), pa.array(odd, pa.float64()), pa.array(some, pa.float64())], names=schema.names)

    evidence = written(source.mapInArrow(lean(run), schema))
    shared.unpersist()
    totals = lambda *by: evidence.where(F.col(_post).isNotNull()).groupBy(*by).agg(F.array(*(F.sum(F.get(_post, i)) for i in range(k))).alias(_c), F.count("*").alias(_n))
    everything = totals().first() if k else None
    if not k or everything[_n] == 0:
        return evidence.select(*own, F.lit(None).cast("string").alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("kept"))
    n_all, share = everything[_n], [float(c) / everything[_n] for c in everything[_c]]

    # Counts of a place and of all its parents on one row, the coarsest level first.
    places = None
    for i in range(len(levels) - 1, -1, -1):
        by = level_names[i:]
        level = totals(*by).withColumnsRenamed({_c: f"{_c}{i}", _n: f"{_n}{i}"})
        places = level if places is None else level.join(places, level_names[i + 1 :])
    # Declarations are two or three letters: at most 26 ** 2 + 26 ** 3 + 1 rows.
    said = totals("declared").withColumnsRenamed({_c: _cd, _n: _nd})
    joined = evidence.join(F.broadcast(said), "declared", "left")
    if places is not None:
        joined = joined.join(places, level_names, "left")

    def score(i: int) -> Column:
        own_share, p = F.get(_post, i), F.lit(share[i])
        for j in range(len(levels) - 1, -1, -1):
            p = (F.greatest(F.get(f"{_c}{j}", i) - own_share, F.lit(0.0)) + alpha * p) / (F.col(f"{_n}{j}") - 1 + alpha)
        said_given = (F.greatest(F.get(_cd, i) - own_share, F.lit(0.0)) + beta * F.col(_nd) / n_all) / (share[i] * n_all + beta)
        return F.get(_ll, i) + F.log(F.greatest(p, F.lit(1e-12))) + F.log(F.greatest(said_given, F.lit(1e-12)))

    scored = joined.withColumn(_s, F.when(F.col(_post).isNotNull(), F.array(*(score(i) for i in range(k)))))
    names = F.array(*map(F.lit, languages))
    top = F.array_max(_s)
    best = F.get(names, F.array_position(_s, top).cast("int") - 1)
    posterior = F.round(1 / F.aggregate(_s, F.lit(0.0), lambda a, x: a + F.exp(x - top)), 6)
    text_lang = F.get(names, F.array_position(_post, F.array_max(_post)).cast("int") - 1)
    return scored.select(
        *own, text_lang.alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), best.alias("language"), posterior.alias("posterior"),
        F.coalesce((posterior >= MIN_POSTERIOR) & (F.col(_odd) <= MAX_SDS) & (F.col(_some) >= 0), F.lit(False)).alias("kept"),
    )


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``fuse`` for web pages: text and declaration from the markup, levels from the address.

    Returns ``id_col, host, text_lang, declared, language, posterior, kept``."""
    levels = host_levels(F.col(url_col))
    return fuse(pages, model, F.col(html_col), declared_language(F.col(html_col)), levels, [F.col(id_col), levels[0].alias("host")], markup=True)
