"""Records, logs, folds and streams against simulations and literals."""

import random

import pytest
from pyspark.sql import functions as F

from murmurate.functions import classify_line, default_value, envelope, error_envelope, is_ready, line_port, nth_word, severity_colour, status_message, status_title, strip_prefix, text_after_last
from murmurate.operators import folds, records
from murmurate.sources import read_env
from murmurate.streaming import burst_stream, classify_logs, log_stream, write_logs


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_expressions(spark):
    lit = F.lit
    r = one(
        spark, a=nth_word(lit("  node v18  "), 1), b=nth_word(lit("node"), 1), c=default_value(lit(""), lit("x")), d=default_value(lit("y"), lit("x")), e=text_after_last(lit("u@h@i"), "@"), f=text_after_last(lit("none"), "@"),
        g=is_ready(lit("Error: no")), h=is_ready(lit(None).cast("string")), i=severity_colour(lit("update")), j=severity_colour(lit("other")),
        k=status_title(lit(404)), m=status_message(lit(200)), n=status_title(lit(0)),
        o=envelope(lit("ok"), F.array(lit("a"), lit(None))), p=envelope(lit("ok"), lit(None).cast("string")), q=error_envelope(lit("no"), lit("why")),
    )
    assert r.asDict() == {
        "a": "v18", "b": None, "c": "x", "d": "y", "e": "i", "f": "none", "g": False, "h": True, "i": "blue", "j": None, "k": "Something went wrong", "m": "", "n": None,
        "o": '{"message":"ok","data":["a",null]}', "p": '{"message":"ok"}', "q": '{"message":"no","error":"why"}',
    }


LINES = {
    "[12]Error Warning": ("Error Warning", "error"), "Warning Server is listening on port 1": ("Warning Server is listening on port 1", "warning"), "[nodemon] x [webpack]": ("[nodemon] x [webpack]", "nodemon"),
    "[1][2]x": ("[2]x", "success"), "error": ("error", "success"), "[HTTP Request] a": ("[HTTP Request] a", "http"), "[Starting] b": ("[Starting] b", "starting"), "": ("", "success"),
}


def test_log_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = df.select("value", strip_prefix(F.col("value")).alias("line")).select("value", "line", classify_line(F.col("line")).alias("c")).collect()
    assert {r["value"]: (r["line"], r["c"]) for r in got} == LINES
    assert one(spark, p=line_port(F.lit("port 1 and port 3000 up")), q=line_port(F.lit("none")))[:] == ("3000", "")


def test_log_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join([*(x for x in LINES if x), "Server is listening on port 3000"]) + "\n")
    write_logs(classify_logs(log_stream(spark, str(folder))), str(tmp_path / "ck"), path=str(tmp_path / "out"), available_now=True).awaitTermination(60)
    stream = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("line", "class").collect()))
    batch = classify_logs(spark.read.text(str(folder)))
    assert stream == sorted(map(tuple, batch.select("line", "class").collect())) and not [x for x in stream if x[1] == "port"]
    ports = classify_logs(spark.read.text(str(folder)), keep_ports=True).where("class = 'port'").collect()
    assert [r["port"] for r in ports] == ["3000"]


def test_env_file(spark, tmp_path):
    (tmp_path / ".env").write_text("# note A=1\nDB_HOST=localhost DB_PORT=3306\nDB_PASS=a=b\nnothing\n")
    assert {r["key"]: r["value"] for r in read_env(spark, str(tmp_path / ".env")).collect()} == {"DB_HOST": "localhost", "DB_PORT": "3306", "DB_PASS": "a=b"}


def test_records(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, None, 3)], "seq int, name string, state int")
    assert records.column_to_list(df.select("name"), "name").first()["values"] == ["a", "b"]
    assert [r["state"] for r in records.update_where(df, F.col("name") == "b", "state", F.lit(9)).orderBy("seq").collect()] == [1, 9, 3]
    assert [tuple(r) for r in records.append(df, df.limit(1), "seq").orderBy("seq").collect()][-1] == (3, "a", 1)
    assert [tuple(r) for r in records.append(df.limit(0), df.where("seq = 0"), "seq").collect()] == [(0, "a", 1)]
    assert records.first_match(df, F.col("state") > 5, "seq").count() == 0
    assert [r["offset"] for r in records.characters(df.where("seq = 0").withColumn("t", F.lit("a😀b")), "t", delay=5).orderBy("place").collect()] == [5, 105, 205]
    assert records.nest(df.where("seq = 0"), "info").first()["info"]["name"] == "a"
    body = spark.createDataFrame([('{"host":"h","port":1}',), ("broken",)], "body string")
    assert [tuple(r) for r in records.decode_json(body, "body", "host string, port int").collect()] == [("h", 1), (None, None)]
    assert records.count_matching(df, "name", "b").first()["n"] == 1


def simulate_selection(events):
    state, is_open = {}, {}
    for _, name, kind in sorted(events):
        new = name not in state
        if kind == "row" or new:
            for other in state:
                if state[other] == 2:
                    state[other] = 1
        if kind == "row":
            state[name], is_open[name] = 2, True
        else:
            state[name] = 0 if is_open.get(name) else 1
            is_open[name] = not is_open.get(name)
    return state


@pytest.mark.parametrize("seed,n", [(1, 50), (2, 120), (3, 300), (4, 1)])
def test_selection_state(spark, seed, n):
    rng = random.Random(seed)
    events = [(i, f"d{rng.randint(0, 8)}", rng.choice(["row", "arrow"])) for i in range(n)]
    got = folds.selection_state(spark.createDataFrame(events, "seq int, name string, kind string")).collect()
    assert {r["name"]: r["state"] for r in got} == simulate_selection(events)


def test_opening_a_new_name_by_its_arrow_leaves_nothing_current(spark):
    df = spark.createDataFrame([(0, "a", "row"), (1, "b", "arrow")], "seq int, name string, kind string")
    assert {r["name"]: r["state"] for r in folds.selection_state(df).collect()} == {"a": 1, "b": 1}


CLICKS = [("x", 0), ("x", 100), ("x", 200), ("y", 0), ("z", 0), ("z", 250), ("w", 0), ("w", 249)]


def test_click_pairs(spark):
    df = spark.createDataFrame(CLICKS, "k string, ms int").select("k", F.timestamp_millis("ms").alias("ts"))
    got = {r["k"]: (r["singles"], r["doubles"]) for r in folds.click_pairs(df, "k", "ts", "0.25 SECONDS").collect()}
    assert got == {"x": (1, 1), "y": (1, 0), "z": (2, 0), "w": (0, 1)}


def test_click_stream(spark, tmp_path):
    df = spark.createDataFrame([*CLICKS, ("late", 10_000_000)], "k string, ms int").select("k", F.timestamp_millis("ms").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = burst_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts", "250 milliseconds", "1 second")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["k"]: (r["singles"], r["doubles"]) for r in spark.table("bursts").collect()} == {"x": (1, 1), "y": (1, 0), "z": (0, 1), "w": (0, 1)}  # the end of a session belongs to it


def test_clamped_sum(spark):
    rng = random.Random(5)
    moves = [(k, i, rng.randint(-300, 250)) for k in "ab" for i in range(200)]
    want = {}
    for k in "ab":
        width = 400
        for kk, i, d in moves:
            if kk == k:
                width = want[k, i] = max(width + d, 0)
    got = folds.clamped_sum(spark.createDataFrame(moves, "k string, seq int, dx int"), "k", "seq", "dx").collect()
    assert {(r["k"], r["seq"]): r["width"] for r in got} == want


def test_last_action_state(spark):
    rows = [(0, "connect", "pending", None, None), (1, "connect", "rejected", None, None), (2, "retrieveAllDatabase", "fulfilled", "[1]", None), (3, "useDatabase", "fulfilled", "[t]", "db"), (4, "getTablesFromDatabase", "pending", None, None)]
    schema = "seq int, action string, phase string, payload string, name string"
    assert folds.last_action_state(spark.createDataFrame(rows, schema)).first()[:] == ("[1]", "db", "[]", False, False, True)
    assert folds.last_action_state(spark.createDataFrame([], schema)).first()[:] == (None, None, None, False, False, False)


def test_memo_retry_and_fan_out():
    calls = []
    memo = folds.TableMemo(lambda d: calls.append(d) or ([] if len(calls) == 1 else [d]))
    assert memo["a"] == [] and memo["a"] == ["a"] and memo["a"] == ["a"] and calls == ["a", "a"]
    replies = iter([ValueError(), "Error", "fine"])

    def action():
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    assert folds.retry(action, lambda x: "Error" not in x, delay=0) == "fine"
    with pytest.raises(TimeoutError):
        folds.retry(lambda: "Error", lambda x: False, delay=0, most=2)
    assert folds.fan_out([lambda: 1, lambda: 2]) == [1, 2]
