"""The replayed log: how much of it the driver gets, and what it makes of no events."""

from collections import Counter

from murmurate import queries

from .conftest import ORACLE


def test_lines_do_not_pass_through_the_driver(spark):
    want = Counter(r["class"] for r in queries.log_classify(spark, ORACLE).select("class").collect())
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "64k")  # what the tasks of a stage may send; the lines are more
    try:
        found = {r["class"]: r["n"] for r in queries.log_replay(spark, ORACLE).collect()}
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert found == want


def test_no_events(spark, tmp_path):
    spark.read.parquet(f"{ORACLE}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert queries.log_replay(spark, str(tmp_path)).collect() == []
