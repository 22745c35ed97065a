"""Folds over ordered events, in closed form: aggregations and window functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Actions and phases of a client, as its events name them.
CONNECT, LIST_DATABASES, USE_DATABASE, LIST_TABLES = "connect", "retrieveAllDatabase", "useDatabase", "getTablesFromDatabase"
PENDING, FULFILLED, REJECTED = "pending", "fulfilled", "rejected"

NOT_SELECTED, SELECTED, SELECTED_AND_CURRENT = 0, 1, 2
STATE_NAMES = {NOT_SELECTED: "NOT_SELECTED", SELECTED: "SELECTED", SELECTED_AND_CURRENT: "SELECTED_AND_CURRENT"}


def selection_state(events: DataFrame) -> DataFrame:
    """``name, state`` after events ``seq, name, kind``, handled in order of ``seq``.

    A ``row`` event makes its name current (2) and opens it; an ``arrow`` event shuts an open
    name (0) or opens a shut one (1). A name that was current becomes 1 at any ``row`` event,
    and at the first event of a new name of either kind. At most one name is current.

    For a name, with r its last row event, a its arrows after it, and d the last demoting event
    of all: after a row the state is 1 if d is later, else 2; otherwise the parity of
    a + (1 if there is an r)."""
    row = F.col("kind") == "row"
    names = events.groupBy("name").agg(F.max(F.when(row, F.col("seq"))).alias("r"), F.min("seq").alias("first"), F.max_by("kind", "seq").alias("last"), F.max("seq").alias("end"))
    arrows = events.where(~row).join(names.select("name", "r"), "name").where(F.col("r").isNull() | (F.col("seq") > F.col("r"))).groupBy("name").agg(F.count("*").alias("a"))
    demoted = names.agg(F.max(F.greatest("r", "first")).alias("d"))
    joined = names.join(arrows, "name", "left").crossJoin(F.broadcast(demoted))  # one row
    parity = (F.coalesce("a", F.lit(0)) + F.when(F.col("r").isNotNull(), 1).otherwise(0)) % 2
    state = F.when(F.col("last") == "row", F.when(F.col("d") > F.col("end"), SELECTED).otherwise(SELECTED_AND_CURRENT)).otherwise(parity)
    return joined.select("name", state.cast("int").alias("state"))


def state_name(state: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in STATE_NAMES.items() for x in kv)), state)


def click_pairs(clicks: DataFrame, key: str, ts: str, limit: str) -> DataFrame:
    """``key, singles, doubles``: clicks less than ``limit`` (an interval) apart form a burst; a
    burst of n clicks is n // 2 doubles and n % 2 singles. A gap of exactly ``limit`` parts."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.col(ts) < F.lag(ts).over(w) + F.expr(f"INTERVAL {limit}")
    marked = clicks.withColumn("_new", F.when(F.coalesce(gap, F.lit(False)), 0).otherwise(1))
    bursts = marked.withColumn("_burst", F.sum("_new").over(w)).groupBy(key, "_burst").agg(F.count("*").alias("n"))
    return bursts.groupBy(key).agg(F.sum(F.col("n") % 2).alias("singles"), F.sum(F.floor(F.col("n") / 2)).alias("doubles"))


def clamped_sum(moves: DataFrame, key: str, seq: str, delta: str, start: int = 400) -> DataFrame:
    """The moves with ``width`` = max(width before + delta, 0), from ``start``, for each key.

    With S the running sum, it is S + max(start, max(-S so far))."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = moves.withColumn("_s", F.sum(delta).over(w))
    return summed.withColumn("width", F.col("_s") + F.greatest(F.lit(start), F.max(-F.col("_s")).over(w))).drop("_s")


def last_action_state(actions: DataFrame, key: str | None = None) -> DataFrame:
    """The client state after actions ``seq, action, phase, payload, name`` in order of ``seq``,
    for each ``key``. Actions are connect, retrieveAllDatabase, useDatabase and
    getTablesFromDatabase; phases pending, fulfilled and rejected; ``payload`` is what a
    fulfilled action brought and ``name`` the database it used. Each field of the state is
    the effect of the last event that touches it."""
    a, p = F.col("action"), F.col("phase")
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    pending = lambda when: F.coalesce(last(p, when) == PENDING, F.lit(False))
    use, tables, done = a == USE_DATABASE, a == LIST_TABLES, p == FULFILLED
    group = actions.groupBy(*([key] if key else []))
    return group.agg(
        last(F.col("payload"), (a == LIST_DATABASES) & done).alias("databases"),
        last(F.col("name"), use & done).alias("currentDatabase"),
        last(F.when(p == PENDING, "[]").otherwise(F.col("payload")), (use & done) | (tables & p.isin(PENDING, FULFILLED))).alias("tables"),
        pending(a == CONNECT).alias("loadingDatabaseConnection"),
        pending(a == LIST_DATABASES).alias("loadingDatabases"),
        pending(use | tables).alias("loadingSingleDatabase"),
    )


class TableMemo:
    """Table lists by database, fetched when first wanted; empty lists are fetched again."""

    def __init__(self, fetch: Callable[[str], list[str]]):
        self._fetch, self._known = fetch, {}

    def __getitem__(self, database: str) -> list[str]:
        if not self._known.get(database):
            self._known[database] = self._fetch(database)
        return self._known[database]


def retry(action: Callable, ready: Callable[[object], bool], delay: float = 0.5, most: int | None = None):
    """Repeat ``action`` after a fixed delay until its reply is ready; an exception counts as not
    ready. ``most`` bounds the attempts, after which the last exception or TimeoutError is raised."""
    n = 0
    while True:
        n += 1
        error = None
        try:
            reply = action()
            if ready(reply):
                return reply
        except Exception as e:  # noqa: BLE001 - any failure is retried
            error = e
        if most is not None and n >= most:
            raise error or TimeoutError(f"not ready after {n} attempts")
        time.sleep(delay)


def fan_out(actions: Iterable[Callable], workers: int = 8) -> list:
    """Results of independent actions in order, run side by side; all end before it returns."""
    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(a) for a in actions]]
