"""The language model and the pipeline."""

import math
import random
import subprocess
import sys
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from murmurate.llm import lm, queries
from murmurate.llm.gru import GRU

from .test_dedup_operators import brute_substrings, components, sets
from .test_text_operators import brute_lines


def sentences(rng, n):
    """Texts of a language with an order: each word mostly calls for its next."""
    names = [f"w{k}" for k in range(30)]
    out = []
    for _ in range(n):
        k, t = rng.randrange(30), []
        for _ in range(rng.randint(5, 60)):
            t.append(names[k])
            k = (k * 7 + 3) % 30 if rng.random() < 0.9 else rng.randrange(30)
        out.append(" ".join(t) + f" rare{rng.randrange(200)}.")
    return out


@pytest.mark.parametrize("head", [200_000, 12])
def test_lm_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    texts = sentences(random.Random(1), 600) + ["", None, "  \n ", "W1 w1 NEVERSEEN", "w2 " * 4000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in lm.score(df).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i, r in got.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and math.isfinite(r["score"]) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # held-out likelihood


def test_lm_learns_from_every_training_text(spark, monkeypatch):
    """Whatever the number of tokens, a round learns from all of them."""
    monkeypatch.setattr(lm, "REPLICA_TOKENS", 1000)
    monkeypatch.setattr(lm, "FAN", 3)
    kept, write = [], lm.written
    monkeypatch.setattr(lm, "release", lambda *frames: None)
    monkeypatch.setattr(lm, "written", lambda df: kept.append(write(df)) or kept[-1])
    df = spark.createDataFrame(list(enumerate(sentences(random.Random(2), 300))), "doc_id long, text string")
    tokens = lm.score(df).first()["train_tokens"]
    levels = [[r["seen"] for r in x.select("seen").collect()] for x in kept if "seen" in x.columns]
    assert tokens > 4000 and len(levels[0]) > 4 and len(levels[-1]) == 1
    assert all(sum(seen) == tokens for seen in levels)


def plain_score(net, symbols):
    """Log-probability of symbols and their end, by the formulas alone, a symbol at a time."""
    import numpy as np

    p, k, h, total, before = net.p, net.hidden, np.zeros(net.hidden), 0.0, 0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for s in [*symbols, 0]:
        x, y = p["in"][before], h @ p["u"]
        z, r = sigmoid(x[:k] + y[:k]), sigmoid(x[k : 2 * k] + y[k : 2 * k])
        c = np.tanh(x[2 * k :] + r * y[2 * k :])
        h = (1 - z) * c + z * h
        e = np.exp(h @ p["c"] + p["cb"])
        kind = net.class_of[s]
        total += math.log(e[kind] / e.sum())
        if 1 <= kind <= net.n_word_classes:
            a, b = net.bounds[kind - 1], net.bounds[kind]
            e = np.exp(p["o"][a:b] @ h + p["ob"][a:b])
            total += math.log(e[s - 1 - a] / e.sum())
        before = s
    return total


def test_scores_equal_a_plain_forward_pass():
    import numpy as np

    net, rng = GRU([9, 7, 5, 3, 2, 1, 1], 4, classes=3), np.random.default_rng(2)
    texts = [rng.integers(1, 12, n) for n in (0, 1, 30, 200)]
    net.train(texts * 5)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=1e-3)


def test_lm_scores_a_text_of_a_million_words(spark):
    """Whole, and the counts of words too long to be broadcast are joined."""
    long = " ".join(["w1 w2 " + "y" * 100] * 350_000)
    rows = [(1, long), (2, "w1 w2 w3"), (3, "w1 " + "x" * 1_000_000), (4, "x" * 1_000_000)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_tokens"] == 1_050_001 and all(r["n_known"] == r["n_tokens"] for r in got.values())
    assert all(math.isfinite(r["score"]) for r in got.values())


def test_lm_odd_tables(spark):
    schema = "doc_id long, text string"
    assert lm.score(spark.createDataFrame([], schema)).count() == 0
    got = lm.score(spark.createDataFrame([(None, "a b"), (1, None), (1, "a"), (1, "a")], schema)).collect()
    assert len(got) == 4 and all(math.isfinite(r["score"]) for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [True]


def test_gradient_and_distribution():
    import numpy as np

    net = GRU([5, 4, 3, 2, 1, 1], 2, classes=3, hidden=4)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    rng = np.random.default_rng(0)
    inputs, targets, w = rng.integers(0, 9, (3, 5)), rng.integers(0, 9, (3, 5)), np.ones((3, 5))
    loss = lambda: -net.window_gradient(np.zeros((3, 4)), inputs, targets, w)[0].sum()
    _, g, (rows, dx), _ = net.window_gradient(np.zeros((3, 4)), inputs, targets, w)
    g["in"] = np.zeros_like(net.p["in"])
    np.add.at(g["in"], rows, dx)
    for name, x in net.p.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in x.shape)
            old, e = x[at], 1e-4
            x[at] = old + e
            up = loss()
            x[at] = old - e
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * e) - g[name][at]) < 1e-3
    h = np.repeat(rng.normal(size=(1, 4)), 9, 0)
    assert abs(np.exp(net.log_probs(h, np.arange(9))).sum() - 1) < 1e-5  # the probabilities of all symbols


def test_windows_take_no_fresh_memory():
    """Learning and scoring use the memory of the first window again: fresh memory cost a fifth of the time."""
    import tracemalloc

    import numpy as np

    net, rng = GRU(np.arange(300, 0, -1), 4), np.random.default_rng(3)
    texts = [rng.integers(1, 300, 400).astype(np.int16) for _ in range(1500)]
    squares = net.train(texts)
    net.score(texts)
    state = 512 * 24 * 24 * 4  # bytes of the states of a window
    tracemalloc.start()
    for run in (lambda: net.train(texts, squares=squares), lambda: net.score(texts)):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        run()
        laid = 8 * sum(len(x) + 1 for x in texts)  # inputs, targets and what is real
        assert tracemalloc.get_traced_memory()[1] - before < laid + 5 * state
    tracemalloc.stop()


@pytest.mark.parametrize("shift", [-200, -50, 0, 50, 200])
def test_probabilities_with_biases_of_any_size(shift):
    """All biases of a softmax may be very small or large: only their differences count."""
    import numpy as np

    net, rng = GRU([9, 7, 5, 3, 2, 1, 1], 4, classes=3), np.random.default_rng(4)
    h, targets = rng.uniform(-1, 1, (60, 24)).astype(np.float32), np.repeat(np.arange(12), 5)
    grads = {}
    want, dh = (x.copy() for x in net.log_probs(h, targets, grads))
    net.p["cb"] += np.float32(shift)
    net.p["ob"] += np.float32(shift)
    shifted = {}
    got, dg = net.log_probs(h, targets, shifted)
    assert np.allclose(got, want, atol=1e-3) and np.allclose(dg, dh, atol=1e-3)
    assert all(np.allclose(shifted[k], grads[k], atol=1e-2) for k in grads)


def test_lm_looks_words_up_in_groups_of_any_size(spark, monkeypatch):
    texts = [*sentences(random.Random(5), 200), "", None, "w3 " * 300, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = []
    for tokens in (1, 90, 65_536):
        monkeypatch.setattr(lm, "ENCODE_TOKENS", tokens)
        found.append({r["doc_id"]: r for r in lm.score(df).collect()})
    for i, r in found[0].items():
        for other in found[1:]:
            assert r[:4] == other[i][:4] and all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(r[4:], other[i][4:], strict=True))
    assert len(found[0]) == len(texts)


def test_windows_and_lanes_do_not_change_scores():
    import numpy as np

    net, rng = GRU([3, 2, 1], 2), np.random.default_rng(1)
    texts = [rng.integers(1, 6, rng.integers(0, 90)) for _ in range(25)]
    alone = np.array([net.score([t], window=1000)[0] for t in texts])
    assert np.allclose(net.score(texts, lanes=4, window=7), alone, atol=1e-3)


# --- pipeline


def corpus():
    rng = random.Random(8)
    sounds = {"aa": ["ka", "ro", "mi", "lu", "te"], "bb": ["sch", "wen", "tz", "gru", "pf"]}
    line = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(12))
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, "\n".join(line(lang) for _ in range(8)), lang, f"s{i % 3}"))
    rows.append((60, rows[3][1], "aa", "s0"))
    rows.append((61, rows[4][1] + " tz", "bb", "s0"))
    passage = line("aa")
    rows += [(70 + i, line("aa") + "\n" + passage + "\n" + line("aa"), "aa", None) for i in range(3)]
    words = rows[5][1].replace("\n", " ").split()
    rows += [(80, " ".join(words), "aa", "s1"), (81, " ".join(words[:-1] + ["kamilu"]), "aa", "s1")]
    rows += [(90, None, "aa", "s0"), (91, "", None, "s0"), (92, "12345 !!!", "aa", "s0"), (None, line("bb"), "bb", None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def test_pipeline(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    by = dict(corpus_pipeline.STAGES)
    after = {}
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        after[name] = {r["doc_id"]: r for r in df.collect()}
        if name != "packing":
            assert df.columns == docs.columns
    text = {r[0]: r[1] for r in rows}
    # Language: the texts without letters go, all others stay as they are.
    assert set(after["language"]) == set(text) - {90, 91, 92}
    assert all(r["text"] == text[i] for i, r in after["language"].items())
    # Lines: brute force over what language kept.
    want = brute_lines([(i, r["text"]) for i, r in after["language"].items()])
    assert {i: r["text"] for i, r in after["lines"].items()} == want
    # Near duplicates: brute force over what lines left.
    ids = [i for i in want if i is not None]
    s = dict(zip(ids, sets([want[i] for i in ids]), strict=True))
    label = components(ids, [(a, b) for a in ids for b in ids if a < b and s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])])
    kept = {i for i in ids if label[i] == i} | {None}
    assert set(after["near_duplicates"]) == kept and 81 not in kept
    # Substrings: brute force over what near dedup kept.
    cut = brute_substrings([(i, want[i]) for i in kept])
    assert {i: r["text"] for i, r in after["substrings"].items()} == {i: cut[i][2].decode(errors="ignore") for i in kept}
    assert after["substrings"][72]["n_chars"] == len(after["substrings"][72]["text"]) < after["lines"][72]["n_chars"]
    assert len(after["packing"]) == len(kept)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert list(by) == ["language", "lines", "near_duplicates", "substrings", "packing"]


def test_stages_take_long_texts_and_other_columns(spark, tmp_path):
    """A text of some hundred thousand lines in every stage, and columns with the names stages use."""
    rng = random.Random(9)
    sounds = ["ka", "ro", "mi", "lu", "te"]
    line = lambda: " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 6))) for _ in range(8))
    long = "\n".join(line() for _ in range(130_000))
    docs = [(1, long, "aa", "s"), (2, long, "aa", "s"), (3, line(), "aa", "s"), (4, "", "aa", "s"), (5, None, "aa", "s"), (3, None, None, None)]
    names = ["_id", "_t", "_text", "_ll", "_post", "kept", "n_removed", "_bits", "posterior"]
    df = spark.createDataFrame([(i, t, a, b, None if t is None else len(t), *range(len(names))) for i, t, a, b in docs], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert df.columns == corpus_pipeline.COLUMNS
            texts = {r["doc_id"]: r["text"] for r in df.collect()}
            assert texts[1] == long and set(texts) == {1, 2, 3}
    sizes = {r["doc_id"]: r["n_tokens"] for r in df.collect()}
    assert sizes[1] == 8 * 130_000 and sizes[2] == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_one_of_repeated_rows(spark):
    row = (7, "some words that are the same in both rows", "aa", "s", 3)
    docs = spark.createDataFrame([row, row, (None, "a", "aa", "s", 1), (None, "a", "aa", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == ["7", "None", "None"]


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 11))


def test_the_rest_does_not_need_this_subpackage():
    code = "import sys; sys.modules['murmurate.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
