"""Operators on single texts and lines against brute force on small fixtures."""

import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from murmurate.llm import bpe, langid, licenses, line_dedup, packing, quality, queries

ODD = ["", " ", "\n\n", "a", "one two\nthree\n", "x" * 3000, "é漢字 😀\x00\x85  end", "the same line\nthe same line\n\nthe same line", "word " * 500, None]


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", 0 if t is None else len(t), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


# --- quality rules


def brute_stats(text):
    words = (text or "").encode().split()
    lines = (text or "").split("\n")
    seen, dup = set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_text_stats():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c\n", "#x ", "|"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    for t in texts:
        assert quality.text_stats(t)[:5] == brute_stats(t), t


def test_quality_rejects_odd_texts_and_keeps_sound_ones(spark):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(x + "#" * (2 + i) for x in t.split()) for i, t in enumerate(good[:20:3] * 3)][:20]
    df = docs(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 150), "x") for i in range(0, 170, 2)], "doc_id long, quality int, text string")
    got = {r["doc_id"]: r for r in quality.judge(df, labels, max_false_rejects=0.05).collect()}
    assert len(got) == df.count()
    assert sum(got[i]["kept"] for i in range(150)) >= 135 and sum(got[i]["kept"] for i in range(150, 170)) <= 4
    assert not any(got[i]["kept"] for i in range(170, 178)) and all(got[i]["base_failed"] for i in (170, 171, 178, 179))
    assert quality.judge(df.limit(0), labels).count() == 0
    assert sum(r["kept"] for r in quality.judge(df, labels.limit(0)).collect()) == 170  # no label, no verdict
    twice = quality.judge(docs(spark, [good[0]] * 3, [None, 1, 1]), labels).collect()
    assert len(twice) == 3 and len({r["score"] for r in twice}) == 1


def test_isolation_paths():
    import numpy as np

    x = np.concatenate([np.random.default_rng(0).normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    s = quality.anomaly(quality.grow(x), x)
    assert s.argmax() == 500 and 0 < s.min() and s.max() <= 1
    assert quality.average_path(1) == 0 and quality.average_path(2) == 1
    same = np.ones((10, 2))
    assert np.isfinite(quality.anomaly(quality.grow(same), same, 10)).all()


def path_length(tree, row):
    """Steps to the row's leaf and the mean path of what the leaf holds, a node at a time."""
    f, cut, child, path = tree
    at = 0
    while child[at] >= 0:
        at = child[at] + (row[f[at]] >= cut[at])
    return path[at]


def test_forest_equals_brute_force():
    import math

    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 2))
    forest = quality.grow(x, 20, 64)
    mean = [sum(path_length(t, r) for t in forest) / 20 for r in x]
    c = 2 * (sum(1 / k for k in range(1, 64))) - 2 * 63 / 64  # by harmonic numbers
    assert np.allclose(quality.anomaly(forest, x, 64), [2 ** (-m / c) for m in mean], atol=2e-3)
    for f, cut, child, path in forest:  # a leaf's path is its depth and the mean of what it holds
        depth, held = {0: 0}, {0: 64}
        for at in range(len(f)):
            if child[at] >= 0:
                depth[child[at]] = depth[child[at] + 1] = depth[at] + 1
            else:
                assert path[at] >= depth[at] and (depth[at] == math.ceil(math.log2(64)) or path[at] == depth[at])


def test_thresholds_are_the_best():
    import numpy as np

    rng = np.random.default_rng(2)
    for most in (0.0, 0.01, 0.2, 1.0):
        good, bad = rng.integers(0, 9, 40).astype(float), rng.integers(0, 3, 40).astype(float) * (np.arange(40) > 20)
        gains = {k: bad[k:].sum() / bad.sum() - good[k:].sum() / good.sum() for k in range(40) if good[k:].sum() / good.sum() <= most}
        best = max(gains.values(), default=-1)
        want = max(k for k, g in gains.items() if g == best) if best >= quality.MIN_GAIN else 40
        assert quality.best_bin(good, bad, most) == want
    assert quality.best_bin(np.ones(5), np.zeros(5), 1.0) == 5


def test_quality_samples_without_sorting_all(spark, monkeypatch):
    df = spark.range(5000).selectExpr("xxhash64(id) AS _h", "id")
    want = [r["id"] for r in df.orderBy("_h").limit(100).collect()]
    assert quality._sample(df, 5000, 100)["id"].tolist() == want
    assert quality._sample(df, 50_000_000, 100)["id"].tolist() == want  # far too small a share is widened
    assert len(quality._sample(df.limit(0), 0, 100)) == 0


def test_quality_of_a_text_of_a_million_words():
    t = " ".join(f"w{i}" for i in range(1_000_000)) + " a b c d e f g h a b c d e f g h"
    assert quality.text_stats(t)[0] == 1_000_016 and quality.text_stats(t)[4] == 16


# --- byte-level BPE


@pytest.fixture(scope="module")
def enc():
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe._encoding(f.read(), p.PATTERN)


def test_pieces_encode_as_the_whole(enc):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "1", "'s", "é", "漢", "!!", " " * 600, "\n" * 700, " ", "<|endoftext|>", "\u00a0", "\u00a0" * 600, "\u3000", "\x85", "\x1c", "\u2003" * 520]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert bpe.encode_text(enc, t, size=10).tolist() == enc.encode_ordinary(t)


def test_very_long_texts(enc):
    spaces = ["\u00a0" * 2_000_000, "\u3000" + " " * 1_000_000, "\x85" * 1_000_000 + "\u2009"]
    for t in ("a" * 300_000, "b" + " " * 2_000_000 + "x", "word " * 100_000, *("a" + x + "b" for x in spaces), *(x + "b" for x in spaces), *("a" + x for x in spaces)):
        assert enc.decode_bytes(bpe.encode_text(enc, t).tolist()) == t.encode()


def test_bpe_columns(spark, enc):
    import public_tokenizers as p

    ranks = p.path("byte_bpe_50k.tiktoken")
    df = docs(spark, ODD).withColumnRenamed("n_words", "ids")
    out = bpe.decode(bpe.encode(df, ranks, p.PATTERN), ranks, p.PATTERN).orderBy("doc_id").collect()
    assert [r["ids"] for r in out] == [enc.encode_ordinary(t or "") for t in ODD]
    assert [bytes(r["decoded"]) for r in out] == [(t or "").encode() for t in ODD]
    assert bpe.encode(df.limit(0), ranks, p.PATTERN).count() == 0
    assert bpe.decode(spark.createDataFrame([([240, 159],), (None,)], "ids array<int>"), ranks, p.PATTERN).count() == 2


def test_bpe_digests(spark, enc, tmp_path):
    docs(spark, ODD).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op2_bpe(spark, str(tmp_path)).collect():
        ids = enc.encode_ordinary(ODD[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((ODD[r["doc_id"]] or "").encode()).hexdigest()


# --- packing


def brute_cost(lengths, buckets):
    import itertools

    values = sorted(set(lengths))
    best = None
    for k in range(min(buckets, len(values))):
        for cuts in itertools.combinations(values[:-1], k):
            bounds = [*cuts, values[-1]]
            cost = sum(min(b for b in bounds if b >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_bounds_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 25))]
        k = rng.randint(1, 4)
        values = sorted(set(lengths))
        bounds = packing.optimal_bounds(values, [lengths.count(v) for v in values], k)
        assert len(bounds) <= k and bounds[-1] == max(lengths)
        assert sum(min(b for b in bounds if b >= x) - x for x in lengths) == brute_cost(lengths, k)
    assert packing.optimal_bounds([], [], 3) == []


def test_batches(spark):
    rng = random.Random(5)
    texts = ["w " * rng.choice([0, 1, 3, 40, 41, 100, 5000]) for _ in range(300)] + ODD
    rows = packing.pack(docs(spark, texts, [None, 1, 1, *range(3, len(texts))]), buckets=4, budget=500).collect()
    assert len(rows) == len(texts) and sorted(r["n_tokens"] for r in rows) == sorted(len((t or "").encode().split()) for t in texts)
    places = {(r["bucket"], r["batch"], r["slot"]) for r in rows}
    assert len(places) == len(rows)
    for b in {r["bucket"] for r in rows}:
        own = [r for r in rows if r["bucket"] == b]
        size = max(1, 500 // max(1, own[0]["bucket_len"]))
        counts = {}
        for r in own:
            assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
            counts[r["batch"]] = counts.get(r["batch"], 0) + 1
        assert sorted(counts) == list(range(len(counts))) and all(counts[k] == size for k in list(sorted(counts))[:-1])
    assert packing.pack(docs(spark, texts).limit(0)).count() == 0


def test_bins_hold_their_lengths(spark):
    n = [0, 1, 4095, 4096, 4097, 9000, 123_456_789]
    for r in spark.createDataFrame([(x,) for x in n], "n long").select("n", packing.length_bin(F.col("n")).alias("b")).collect():
        assert r["n"] <= r["b"] <= r["n"] * (1 + 2 / packing.EXACT) and (r["b"] == r["n"] or r["n"] > packing.EXACT)


# --- language


def language_rows():
    rng = random.Random(6)
    sounds = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "wen", "tz"], "cc": ["éau", "ouè", "ç"]}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    return text, [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]


def test_language_of_pages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_SDS", 1.5)  # a model of 90 texts spreads wide
    text, rows = language_rows()
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    page = lambda lang, said: f'<html lang="{said}"><style>p{{}}</style><p>{text(lang)}</p><script>sch wen tz</script></html>'
    pages = [(i, f"https://www.h{i % 2}.example.co.uk/x", page("aa" if i % 2 else "bb", "aa" if i % 2 else "bb-DE")) for i in range(40)]
    pages += [(100, None, page("cc", "aa")), (101, "https://www.h1.example.co.uk", "<html lang=aa><p>123 !!</p>"), (102, "x", None), (None, "http://h1.example.co.uk", ""), (103, "http://a.example.com:8/", page("cc", "??")), (103, "http://a.example.com:8/", "<p>世界世界世界世界世界世界世界世界</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, language string")
    got = langid.identify_pages(df, model).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got if r["page_id"] is not None and r["page_id"] != 103}
    for i in range(40):
        assert by[i]["kept"] and by[i]["language"] == ("aa" if i % 2 else "bb") and by[i]["host"] == f"www.h{i % 2}.example.co.uk"
    assert by[1]["declared"] == "aa" and by[0]["declared"] == "bb"
    assert by[100]["language"] == "cc" and not by[101]["kept"] and by[101]["language"] is None and not by[102]["kept"]
    assert {r["kept"] for r in got if r["page_id"] == 103} == {True, False}
    assert langid.identify_pages(df.limit(0), model).count() == 0
    assert not any(r["kept"] for r in langid.identify_pages(df, langid.train(spark.createDataFrame([], "text string, lang string"))).collect())


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_texts_of_no_language_are_rejected(spark, size):
    """With the production values, whatever the size of the corpus."""
    own = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet").select("text", "lang")
    rng = random.Random(8)
    odd = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar", "人人生而自由在尊严和权利上一律平等", "Все люди рождаются свободными и равными", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι"]
    odd += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40))]
    sound = ["All human beings are born free and equal in dignity and rights"]
    df = spark.createDataFrame([(t, "") for t in odd + sound], "text string, lang string")
    got = {r["text"]: r["kept"] for r in langid.fuse(df, langid.train(own), F.col("text"), F.col("lang"), [], [F.col("text")]).collect()}
    assert not any(got[t] for t in odd) and all(got[t] for t in sound)


def test_priors_decide_doubtful_texts(spark):
    """A text that two languages share goes with its host, and without a host with its declaration."""
    rows = [(0, "xo ne ti " * 30, "aa"), (1, "xo ne ti " * 30, "bb"), (2, "ka ro mi " * 30, "aa"), (3, "sch wen tz " * 30, "bb")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mine = [(i, "ka ro mi " * 20 if i < 10 else "sch wen tz " * 20, "a" if i < 10 else "b", "") for i in range(20)]
    df = spark.createDataFrame([*mine, (50, "xo ne", "a", ""), (51, "xo ne", "b", "")], "id long, text string, host string, said string")
    got = {r["id"]: r["language"] for r in langid.fuse(df, model, F.col("text"), F.col("said"), [F.col("host")], [F.col("id")]).collect()}
    assert got[50] == "aa" and got[51] == "bb"


def brute_fused(rows, model, k, alpha=langid.ALPHA, beta=langid.BETA):
    """Posterior, language and verdict of rows (text, declared, host, suffix), by the formulas alone."""
    import numpy as np

    evidence = []
    for text, *_ in rows:
        at = langid.trigrams(text) if text else np.empty(0, np.int64)
        if not len(at):
            evidence.append(None)
            continue
        mean, odds = model.logp[at].mean(0), model.odds[at].mean(0)
        ll = mean * min(len(at), langid.MAX_EVIDENCE)
        p = np.exp(ll - ll.max())
        best = mean.argmax()
        evidence.append((ll, p / p.sum(), (model.mean[best] - mean[best]) / model.sd[best] <= langid.MAX_SDS and odds.max() * min(len(at), langid.MAX_EVIDENCE) >= np.log(langid.NONE)))
    sound = [i for i, e in enumerate(evidence) if e]
    total = sum(evidence[i][1] for i in sound)
    share = total / len(sound)
    out = []
    for i, (_, said, *levels) in enumerate(rows):
        if not evidence[i]:
            out.append((None, None, False))
            continue
        ll, own, usual = evidence[i]
        prior = share
        for j in reversed(range(len(levels))):  # the coarsest first
            same = [x for x in sound if rows[x][2 + j :] == rows[i][2 + j :]]
            prior = (sum(evidence[x][1] for x in same) - own + alpha * prior) / (len(same) - 1 + alpha)
        same = [x for x in sound if rows[x][1] == said]
        given = (sum(evidence[x][1] for x in same) - own + beta * len(same) / len(sound)) / (total + beta)
        s = ll + np.log(np.maximum(prior, 1e-12)) + np.log(np.maximum(given, 1e-12))
        p = np.exp(s - s.max())
        p /= p.sum()
        out.append((model.languages[int(s.argmax())], float(p.max()), bool(p.max() >= langid.MIN_POSTERIOR and usual)))
    return out


def test_fusion_equals_brute_force(spark):
    text, labelled = language_rows()
    model = langid.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    rng = random.Random(12)
    texts = [text(rng.choice(["aa", "bb", "cc"]))[: rng.choice([3, 8, 20, 400])] for _ in range(80)] + ["xo ne", "123", "", None, "ka " * 400_000, text("aa") * 300]
    rows = [(t, rng.choice(["", "aa", "bb", "zz"]), f"h{rng.randrange(4)}.com", "com") for t in texts]
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "id long, t string, said string, host string, suffix string, _text string").withColumn("_ll", F.lit(1)).withColumn("_c0", F.lit(1))
    found = langid.fuse(df, model, F.col("t"), F.col("said"), [F.col("host"), F.col("suffix")], [F.col("id"), F.col("_text"), F.col("_ll"), F.col("_c0")]).collect()
    want = brute_fused(rows, model, 3)
    for r in found:
        lang, posterior, kept = want[r["id"]]
        assert (r["language"], r["kept"], r["_text"], r["_ll"], r["_c0"]) == (lang, kept, "clash", 1, 1)
        assert posterior is None and r["posterior"] is None or abs(r["posterior"] - posterior) < 2e-6
    assert len(found) == len(rows)


def test_languages_beyond_the_most_are_one(spark):
    _, labelled = language_rows()
    rows = labelled + [(100 + i, f"zu zu lo{i} " * 5, f"x{i:03d}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, most=4)
    assert model.languages == ["aa", "bb", "cc", langid.OTHER]
    found = langid.fuse(df, model, F.col("text"), F.lit(""), [], [F.col("doc_id")]).collect()
    assert len(found) == len(rows) and all(r["language"] == langid.OTHER for r in found if r["doc_id"] >= 100)
    assert len(langid.train(df).languages) == langid.MAX_LANGUAGES


def test_host_levels(spark):
    urls = {"http://u@WWW.a.co.uk:80/x": ("www.a.co.uk", "a.co.uk", "co.uk"), "https://b.example.org": ("b.example.org", "example.org", "org"), "nonsense": (None, None, None)}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.select("u", *(c.alias(n) for c, n in zip(langid.host_levels(F.col("u")), "abc", strict=True))).collect():
        assert tuple(r)[1:] == urls[r["u"]]


# --- licences


def test_licences(spark):
    long = licenses.TEMPLATES["mit-permission"]
    words = long.split()
    edited = " ".join(w if i % 40 else "changed" for i, w in enumerate(words))
    texts = ["intro text here\n" + long + " more", edited.upper(), "Released under the MIT License.", "Released under the MIT", " ".join(words[: len(words) // 2]), *ODD, "x " * 20_000 + licenses.TEMPLATES["bsd-redistribution"]]
    found = {(r["doc_id"], r["license"]): (r["n_matched"], r["n_shingles"]) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    of = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    shingles = functools.cache(lambda t: of((t or "").lower().split()))
    want = {}
    for i, t in enumerate(texts):
        for name, body in licenses.TEMPLATES.items():
            need = shingles(body)
            both = need & shingles(t)
            if len(both) >= 0.75 * len(need):
                want[i, name] = (len(both), len(need))
    assert found == want and (1, "mit-permission") in found
    assert licenses.scan_licenses(docs(spark, texts).limit(0)).count() == 0
    twice = licenses.scan_licenses(docs(spark, [texts[2]] * 3, [None, 1, 1])).collect()
    assert sorted(str(r["doc_id"]) for r in twice) == ["1", "None"]
    assert licenses.scan_licenses(docs(spark, ["a b"]), {"t": "A b", "none": " "}).first()["n_matched"] == 1


def test_licences_in_texts_of_few_words(spark):
    """Texts without a window find templates of eight and nine shingles."""
    texts = ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0", "This work is licensed under the GNU General Public License, version", "this work is licensed under the GNU"]
    found = sorted((r["doc_id"], r["license"], r["n_shingles"], r["n_matched"]) for r in licenses.scan_licenses(docs(spark, texts)).collect())
    assert found == [(0, "cc-by-sa-4.0", 8, 6), (1, "gpl-3.0-line", 8, 7)]
    nine = " ".join(f"w{k}" for k in range(13))
    assert [r["n_matched"] for r in licenses.scan_licenses(docs(spark, [nine[: nine.index(" w11")]]), {"nine": nine}).collect()] == [7]


def cut_templates(n):
    """Templates of thirteen words, and texts in whose middle they stand without both ends: 7 of 9 shingles."""
    made = {f"t{i}": " ".join(f"a{i}b{k}" for k in range(13)) for i in range(n)}
    return made, [" ".join(f"x{i}y{k}" for k in range(i % 7 + 3)) + " " + " ".join(t.split()[1:-1]) + f" end{i} of it all" for i, t in enumerate(made.values())]


@pytest.mark.parametrize("literal", [100_000, 10])
def test_licences_are_found_by_three_quarters_of_them(spark, monkeypatch, literal):
    """All of 300, by look-ups and by joins."""
    monkeypatch.setattr(licenses, "LITERAL_KEYS", literal)
    made, texts = cut_templates(300)
    found = {(r["doc_id"], r["license"]): r["n_matched"] for r in licenses.scan_licenses(docs(spark, texts + [None, ""]), made).collect()}
    assert found == {(i, f"t{i}"): 7 for i in range(300)}


def test_bands_are_independent(spark):
    """Windows of eight shingles that share five are missed about as often as the bound says."""
    from pyspark.sql import functions as F

    n = 3000
    rows = spark.range(n).select(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.xxhash64("id", k)).alias("x"))
    key = lambda part: [F.array_min(p) for p in licenses._permuted(part)]
    same = [a == b for a, b in zip(key(F.slice("x", 1, 8)), key(F.slice("x", 4, 8)), strict=True)]
    one = rows.select(*(s.cast("int").alias(f"b{i}") for i, s in enumerate(same))).toPandas()
    assert abs(one.to_numpy().mean() - 5 / 11) < 0.02
    missed = (one.iloc[:, :4].sum(axis=1) == 0).mean()
    assert abs(missed - (1 - 5 / 11) ** 4) < 0.02


def test_licences_stay_in_the_jvm(spark):
    plan = licenses.scan_licenses(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.encode().split()]
        gone, mine = set(), []
        for k in range(len(at) - 2):
            w = tuple(lines[j] for j in at[k : k + 3])
            if w in seen or w in mine:
                gone.update(at[k : k + 3])
            mine.append(w)
        seen.update(mine)
        out[i] = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(["a", "b", "c d", "", " ", "e"]) for _ in range(rng.randint(0, 14))) for _ in range(60)] + ODD
    df = docs(spark, texts, [None, *range(1, len(texts))]).withColumnRenamed("n_words", "n_removed")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines([(None if i == 0 else i, t) for i, t in enumerate(texts)])
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "doc_id AS _id", "1 AS _t", "2 AS _w", "3 AS _lines", "4 AS _starts", "5 AS _gone", "6 AS _id2", "7 AS __t2", "8 AS _T2")
    rows = line_dedup.dedup_lines(clash).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == got and all((r["_id"], r["_t"], r["_w"], r["_lines"], r["_starts"], r["_gone"], r["_id2"], r["__t2"], r["_T2"]) == (r["doc_id"], 1, 2, 3, 4, 5, 6, 7, 8) for r in rows)
    long = "\n".join(f"line {i} of many" for i in range(300_000))
    rows = line_dedup.dedup_lines(docs(spark, [long, "x\n" + long, None])).orderBy("doc_id").collect()
    assert rows[0]["text"] == long and rows[1]["text"] == "x" and rows[1]["n_removed"] == 300_000 and rows[2]["text"] is None
    twin = line_dedup.dedup_lines(docs(spark, ["a\nb\nc"] * 3, [1, 1, 2])).orderBy("doc_id").collect()
    assert [r["text"] for r in twin] == ["a\nb\nc", "a\nb\nc", ""] and twin[0]["n_lines"] == 3
