"""Operators across texts and vectors against brute force on small fixtures."""

import random

import pytest

from murmurate.llm import common, embeddings, near_dedup, runindex, substring_dedup
from murmurate.llm.shingles import shingle_set

ODD = ["", " \n", None, "a", "one two three", "x" * 5000, "é漢字 😀\x00 end of it all now", "w " * 3000]


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_shingles string")


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def edit(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def grouped(rng):
    """Texts in groups of near copies of all degrees, with chains, and unrelated ones."""
    out = []
    for _ in range(12):
        base = words(rng, rng.choice([12, 60, 150]))
        out += [" ".join(edit(rng, base, rng.randint(0, max(1, len(base) // 25)))) for _ in range(rng.randint(1, 25))]
    chain = words(rng, 120)
    for _ in range(15):
        chain = edit(rng, chain, 2)
        out.append(" ".join(chain))
    passage = words(rng, 40)
    out += [" ".join(words(rng, 100) + passage) for _ in range(30)]
    rng.shuffle(out)
    return out


def components(nodes, linked):
    label = {x: x for x in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {x: find(x) for x in nodes}


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rng = random.Random(seed)
    texts = grouped(rng) + ODD + ["A", "ONE two three", ODD[-1]]
    s = sets(texts)
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    want = components(range(len(s)), pairs)
    got = {r["doc_id"]: r for r in near_dedup.link(docs(spark, texts)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(s[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_dedup_odd_tables(spark):
    assert near_dedup.link(docs(spark, ["a"]).limit(0)).count() == 0
    got = near_dedup.link(docs(spark, ["a b c d e f"] * 4 + [None], [None, 5, 5, 7, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "None", True), ("None", "None", True)]


def test_large_buckets_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "ASKS", 3)
    rng = random.Random(3)
    base = words(rng, 60)
    texts = [" ".join(edit(rng, base, rng.randint(0, 5))) for _ in range(60)]
    s = sets(texts)
    want = components(range(60), [(i, j) for i in range(60) for j in range(i) if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])])
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.link(docs(spark, texts)).collect()} == want


def test_sketches_merge_and_estimate():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 3000, np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:])
    sa, sb = near_dedup.sketch(a), near_dedup.sketch(b)
    assert (near_dedup.merge(sa, sb) == near_dedup.sketch(np.unique(x))).all()
    j, beaten = near_dedup.estimate(np.stack([sa, sa]), np.stack([sb, sa]), np.array([2000.0, 2000.0]), np.array([2500.0, 2000.0]))
    assert abs(j[0] - 0.5) < 0.12 and j[1] == 1.0 and beaten[1] <= 0 and beaten[0] > 0
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("A b")) == 1 and shingle_set("A b") == shingle_set("a B") and len(shingle_set(None)) == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(900, 600 + i) for i in range(50)]
    want = components({x for p in pairs for x in p}, pairs)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: want[k] for k in got} and all(k in got for k in want if any(k in p and p[0] != p[1] for p in pairs))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings


def brute_links(rows, threshold=0.98):
    import numpy as np

    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v + [0.0] * (16 - len(v)))
            ok[i] = (v / np.linalg.norm(v), label)
    pairs = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] >= threshold]
    label = components([r[0] for r in rows], pairs)
    return {i: (sum(i in p for p in pairs), label[i]) for i, _, _ in rows}


def vectors(rng):
    import numpy as np

    rows, g = [], np.random.default_rng(rng.randrange(1000))
    for label in (0, 1, None):
        for _ in range(6):
            c = g.normal(size=16)
            rows += [((c + g.normal(size=16) * s).astype(np.float32).tolist(), label) for s in g.choice([0.0, 0.05, 0.1, 0.3], rng.randint(1, 25))]
    rows += [([0.0] * 16, 0), ([float("nan")] * 16, 0), ([float("inf")] + [1.0] * 15, 0), (None, 0), ([1.0, None] + [0.0] * 14, 0), ([1.0] * 4, 0), ([2.0] * 4, 0), ([1.0] * 4 + [0.0] * 12, 0), ([], 1)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 7)])
def test_embedding_links(spark, monkeypatch, seed, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors(random.Random(seed))
    want = brute_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found >= 0.9 * there  # recall; and in fact no link is lost
    assert got == want


def test_embedding_odd_tables(spark):
    assert embeddings.link(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embeddings.link(spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (9, None, 1)], SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [("2", 1, "2", True), ("3", 1, "2", False), ("9", 0, "9", True), ("None", 0, "None", True)]


# --- substrings


def brute_substrings(rows, length=50):
    first = {}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, b in raw.items():
        if i is not None:
            for k in range(len(b) - length + 1):
                first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = {}
    for i, b in raw.items():
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                cover[k : k + length] = b"\1" * length
        out[i] = (len(b), sum(cover), bytes(x for x, c in zip(b, cover, strict=True) if not c), bytes(cover))
    return out


def repeats(rng):
    base = "".join(rng.choice("abc é\n\0") for _ in range(600))
    texts = list(ODD) + ["a" * 200, "a" * 300, "ab" * 100, base]
    for _ in range(60):
        parts = [base[(k := rng.randrange(500)) : k + rng.randrange(30, 100)] for _ in range(rng.randint(1, 4))]
        texts.append("".join(x + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 20))) for x in parts))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block", [(1, 4 << 20), (2, 700)])
def test_substrings(spark, monkeypatch, seed, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    texts = repeats(random.Random(seed))
    rows = list(enumerate(texts))
    want = brute_substrings(rows)
    got = substring_dedup.dedup_substrings(docs(spark, texts).repartition(3), carry=["n_shingles"]).collect()
    assert len(got) == len(texts)
    for r in got:
        n, removed, kept, cover = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], bytes(r["kept"]), r["n_shingles"]) == (n, removed, kept, "clash")
        mine = bytearray(n)
        for s in r["spans"]:
            assert s["start"] < s["end"] and not any(mine[max(0, s["start"] - 1) : s["end"]])
            mine[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
        assert bytes(mine) == cover


def test_substrings_odd_tables(spark):
    assert substring_dedup.dedup_substrings(docs(spark, ["a"]).limit(0)).count() == 0
    t = "0123456789" * 6
    got = substring_dedup.dedup_substrings(docs(spark, [t] * 5, [None, 3, 3, 4, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], len(r["spans"])) for r in got) == [("3", 0, 0), ("3", 0, 0), ("4", 60, 1), ("None", 0, 0), ("None", 0, 0)]


def strings(rng, least):
    alphabet = rng.choice([b"a", b"ab", b"abc\0\xff"])
    base = bytes(rng.choice(alphabet) for _ in range(60))
    return [base[(k := rng.randrange(60 - least)) : k + rng.randint(least, 60)] for _ in range(rng.randint(2, 14))]


def arrays(parts):
    import numpy as np

    return b"".join(parts), np.array([len(x) for x in parts])


def test_matching_statistics():
    """Lengths and places of the longest matches, as brute force finds them."""
    rng = random.Random(6)
    for _ in range(60):
        cap = rng.choice([8, 15, 50])
        parts = strings(rng, 1)
        own, others = parts[: len(parts) // 2], parts[len(parts) // 2 :]
        index = runindex.RunIndex(*arrays(own))
        lengths, places = index.statistics(*arrays(others), cap)
        text = [c - 1 for c in runindex.symbols(*arrays(own), 0)[0].tolist()]
        at = 0
        for x in others:
            for i in range(len(x)):
                most = max(k for k in range(min(cap, len(x) - i) + 1) if k == 0 or any(x[i : i + k] in y for y in own))
                assert lengths[at] == most
                assert text[places[at] : places[at] + most] == list(x[i : i + most])
                at += 1


def repeated(parts, owners, keys, window):
    import numpy as np

    body, sizes = arrays(parts)
    return runindex.repeats(body, np.cumsum(sizes) - sizes, sizes, np.array(owners), np.array(keys), window).tolist()


def test_repeats_of_smaller_owners():
    rng = random.Random(7)
    for _ in range(60):
        window = rng.choice([8, 15])
        parts = strings(rng, window)
        owners = [rng.randint(0, 5) for _ in parts]
        want = [any(x[i : i + window] in y and p < o for y, p in zip(parts, owners, strict=True)) for x, o in zip(parts, owners, strict=True) for i in range(len(x) - window + 1)]
        assert repeated(parts, owners, [0] * len(parts), window) == want


def test_samples_at_run_ends_decide(monkeypatch):
    """Wrong samples make wrong matches: nothing else tells where a match stands."""
    rng = random.Random(8)
    base = bytes(rng.choice(b"abcdef") for _ in range(200))
    parts = [base[(k := rng.randrange(150)) : k + 40] for _ in range(12)]
    owners = list(range(12))
    right = repeated(parts, owners, [0] * len(parts), 15)
    build = runindex.RunIndex.__init__

    def wrong(self, body, sizes):
        build(self, body, sizes)
        self.run_first, self.run_last = self.run_first * 0, self.run_last * 0

    monkeypatch.setattr(runindex.RunIndex, "__init__", wrong)
    assert any(right) and repeated(parts, owners, [0] * len(parts), 15) != right


def test_hot_fingerprints_are_divided(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 4)
    monkeypatch.setattr(substring_dedup, "MANY", 3)
    monkeypatch.setattr(substring_dedup, "WINDOWS", 5)
    texts = repeats(random.Random(9))
    want = brute_substrings(list(enumerate(texts)))
    got = substring_dedup.dedup_substrings(docs(spark, texts).repartition(3)).collect()
    assert {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in got} == {i: (w[1], w[2]) for i, w in want.items()}


def test_substrings_of_long_and_of_many_short_texts(spark):
    """A text of some million words, a periodic one, and so many short ones that rows end a block."""
    rng = random.Random(10)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1_000_000))
    texts = [long, "ab" * 500_000, *("short" for _ in range(70_000)), long[1000:1200] + "!", "ab" * 100, None]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in substring_dedup.dedup_substrings(docs(spark, texts)).select("doc_id", "n_bytes", "n_removed").collect()}
    n = len(texts)
    assert got[0] == (len(long), 0) and got[1] == (1_000_000, 0) and got[n - 3] == (201, 200) and got[n - 2] == (200, 200) and got[n - 1] == (0, 0)
    assert all(got[i] == (5, 0) for i in range(2, n - 3))


def test_scratch_needs_a_shared_folder(monkeypatch):
    """Folders of one machine only where everything runs on it."""
    from types import SimpleNamespace

    session = lambda master, shared=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: shared), sparkContext=SimpleNamespace(master=master, applicationId=master))
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.scratch_dir(session(master))
        assert common.scratch_dir(session(master, "hdfs://b/c")) == "hdfs://b/c"
    assert common.scratch_dir(session("local[4]")).startswith("file://")


def test_scratch_is_released(spark):
    import os

    df = common.written(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.exists(path)
    common.release(df)
    assert not os.path.exists(path)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, " ")]])
def test_long_texts_of_near_dedup(spark, rows):
    """Texts of a million words, beside rows that have nothing to link."""
    rng = random.Random(11)
    long = words(rng, 1_000_000, 10**6)
    texts = [(10, " ".join(long)), (11, " ".join(edit(rng, long, 1000))), (12, " ".join(words(rng, 1_000_000, 10**6))), *rows]
    if rows:
        texts = texts[:1] + rows
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.link(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[10] == (10, True) and (not rows) == (got.get(11) == (10, False)) and all(got[i] == (i, True) for i, _ in rows)


def test_one_of_each_group_is_kept(spark):
    rng = random.Random(12)
    texts = grouped(rng)[:60]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(3, texts[3], "b"), (3, "another text of that id", "c"), (None, texts[0], "d"), (None, texts[0], "d"), (70, None, "e")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, extra string, _id int, _bits int, _kept int")
    linked = near_dedup.link(df).collect()
    gone = {r["doc_id"] for r in linked if not r["kept"]}
    want = {(i, t) for i, t, _ in rows if i not in gone}
    got = near_dedup.keep_one(df).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == want and len(got) == len(want) + 1  # two rows without an id
    assert got[0].asDict().keys() == {"doc_id", "text", "extra", "_id", "_bits", "_kept"} and all((r["_id"], r["_bits"], r["_kept"]) == (1, 2, 3) for r in got)
