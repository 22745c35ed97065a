"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify_line, default_value, envelope, error_envelope, is_ready, line_port, nth_word, severity_colour, status_message, status_title, strip_prefix, text_after_last
from .operators import catalog, folds, records, serverinfo, sql
from .plans import delegated
from .session import Engine, NotConnectedError
from .sources import parse_env, register_database
from .streaming import classify_logs, log_stream, write_logs

DATABASE = "lake"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_IN = ", ".join(f"'{t}'" for t in TABLES)


def _lake(spark: SparkSession, sf_dir: str) -> str:
    register_database(spark, sf_dir, DATABASE)
    return DATABASE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_tables(spark, sf_dir):
    return catalog.list_tables(spark, _lake(spark, sf_dir)).where(F.col("table_name").isin(TABLES))


def list_databases(spark, sf_dir):
    database = _lake(spark, sf_dir)  # before the listing, which is made at once
    return catalog.list_databases(spark).where(F.col("Database") == database)


def use_database(spark, sf_dir):
    before = spark.catalog.currentDatabase()
    try:
        return catalog.use_database(spark, _lake(spark, sf_dir)).select("DBName", F.array_join("DBTable", ",").alias("DBTable"))
    finally:
        spark.catalog.setCurrentDatabase(before)


def current_database(spark, sf_dir):
    before = spark.catalog.currentDatabase()
    try:
        catalog.use_database(spark, _lake(spark, sf_dir))
        return spark.createDataFrame([(catalog.current_database(spark),)], "current_database string")
    finally:
        spark.catalog.setCurrentDatabase(before)


def server_info(spark, sf_dir):
    return serverinfo.server_information(spark)


def server_fields(spark, sf_dir):
    """What of the server's information is the same wherever it runs."""
    server, software = F.col("ServerInformation"), F.col("SoftwareInformation")
    return serverinfo.server_information(spark).select(
        server["character_set_server"].alias("character_set"), server["default_storage_engine"].alias("engine"), (F.length(server["user"]) > 0).alias("has_user"), F.contains(server["ip"], F.lit("@")).alias("ip_has_at"),
        (server["ip"] == spark.sparkContext.getConf().get("spark.driver.host")).alias("ip_is_host"), (server["port"] >= 0).alias("has_port"), (software["sparkVersion"] == spark.version).alias("version"),
    )


def connection(spark, sf_dir):
    """Connect, list, use, query and disconnect, one row for each step."""
    name, before, steps = "lake_connection", spark.catalog.currentDatabase(), []
    try:
        engine = Engine(spark).connect(sf_dir, name)
        steps.append(("connected", str(engine.connected).lower()))
        steps.append(("current", engine.current_database()))
        steps.append(("tables", str(engine.tables().where(F.col("table_name").isin(TABLES)).count())))
        steps.append(("used", engine.use(name).first()["DBName"]))
        steps.append(("regions", str(engine.query("SELECT count(*) FROM region WHERE r_regionkey < ?", [3]).first()[0])))
        steps.append(("healthy", str(engine.health()).lower()))
        engine.disconnect()
        steps.append(("after", str(engine.connected).lower()))
        try:
            engine.tables()
        except NotConnectedError:
            steps.append(("refused", "true"))
        steps.append(("gone", str(not spark.catalog.databaseExists(name)).lower()))
    finally:
        spark.catalog.setCurrentDatabase(before)
    return spark.createDataFrame(steps, "step string, result string")


def quoted_literal(spark, sf_dir):
    return sql.run_query(spark, f'SELECT n_nationkey, concat("?", n_name, "\'") AS marked FROM {_lake(spark, sf_dir)}.nation WHERE n_name <> "?" AND n_nationkey < ?', [7])


def error_envelopes(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", error_envelope(F.lit("Not connected"), F.col("n_name")).alias("body"))


def env_pairs(spark, sf_dir):
    """Pairs of a small file that is made of the regions: a comment, a line of one pair, one of two, one without."""
    lines = []
    for r in _table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        lines += [f"# REGION={r['r_name']}", f"R{r['r_regionkey']}={r['r_name'].replace(' ', '')}", f"A{r['r_regionkey']}=x=y B{r['r_regionkey']}=", "no pair"]
    return parse_env(spark, "\n".join(lines))


def log_replay(spark, sf_dir):
    """The log lines by way of a stream that reads all there is and ends. What it makes of them goes
    to Parquet files, for the driver could not hold it; the folder is deleted when the session ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="murmurate-logs-")
    folder = f"{shared}/log_replay_{uuid.uuid4().hex}"
    _log_lines(spark, sf_dir).select("value").write.text(f"{folder}/lines")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # a folder must be there
    classified = classify_logs(log_stream(spark, f"{folder}/lines"))
    write_logs(classified, f"{folder}/checkpoint", path=f"{folder}/classified", available_now=True).awaitTermination()
    return spark.read.schema(classified.schema).parquet(f"{folder}/classified").groupBy("class").agg(F.count("*").alias("n"))


def param_query(spark, sf_dir):
    text = f"SELECT o_orderkey, o_totalprice FROM {_lake(spark, sf_dir)}.orders WHERE o_orderpriority = ? AND o_totalprice > ?"
    return sql.run_query(spark, text, ["1-URGENT", 50000.0])


def multi_query(spark, sf_dir):
    db = _lake(spark, sf_dir)
    found = sql.run_queries(spark, [f"SELECT count(*) AS n FROM {db}.{t};" for t in ("region", "nation", "orders")])
    out = None
    for i, df in enumerate(found):
        tagged = df.select(F.lit(i).alias("position"), "n")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def scalar_subqueries(spark, sf_dir):
    db = _lake(spark, sf_dir)
    return sql.run_query(spark, f"SELECT (SELECT count(*) FROM {db}.customer) AS customers, (SELECT max(o_orderkey) FROM {db}.orders) AS last_order, (SELECT min(n_name) FROM {db}.nation) AS first_nation")


def substring_index(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", text_after_last(F.col("c_name"), "#").alias("number"))


def nth_words(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", nth_word(F.col("p_type"), 1).alias("second"), nth_word(F.col("p_type"), 9).alias("tenth"))


def default_values(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", default_value(F.when(F.col("n_nationkey") % 3 == 0, F.lit("")).when(F.col("n_nationkey") % 3 == 1, F.col("n_name")), F.lit("localhost")).alias("host"))


def status_messages(spark, sf_dir):
    status = F.element_at(F.array(*(F.lit(x) for x in (200, 400, 500, 404, 0))), (F.col("event_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", status_title(status).alias("title"), status_message(status).alias("message"))


def severity_colours(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", severity_colour(F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "loading").when(F.col("event_type") == "signup", "update")).alias("colour"))


def envelope_json(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", envelope(F.lit("Retrieved"), F.struct(F.col("n_name").alias("DBName"), F.array("n_name").alias("DBTable"))).alias("body"))


def decode_json(spark, sf_dir):
    bodies = _table(spark, sf_dir, "events").select(F.concat(F.lit('{"id": '), F.col("event_id"), F.lit(', "props": '), F.col("props"), F.lit("}")).alias("body"))
    return records.decode_json(bodies, "body", "id BIGINT, props STRUCT<k: INT>").select(F.col("id").alias("event_id"), "props.k")


def ready_replies(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", is_ready(F.when(F.col("event_type") != "view", F.concat(F.initcap("event_type"), F.lit(" reply")))).alias("ready"))


def column_list(spark, sf_dir):
    return records.column_to_list(_table(spark, sf_dir, "region"), "r_name").select(F.array_join("values", ",").alias("names"))


def nested_record(spark, sf_dir):
    nested = records.nest(_table(spark, sf_dir, "region"), "info", extra=F.struct(F.lit("").alias("version")))
    return records.set_field(nested, "extra", "version", F.lit("1")).select(F.to_json("info").alias("info"), "extra.version")


def first_match(spark, sf_dir):
    return records.first_match(_table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", "o_orderkey").select("o_orderkey", "o_custkey")


def update_where(spark, sf_dir):
    return records.update_where(_table(spark, sf_dir, "nation"), F.col("n_name").startswith("A"), "n_regionkey", F.lit(99))


def append_rows(spark, sf_dir):
    region = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("name"))
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    return records.append(region, nation, "place")


def view_nodes(spark, sf_dir):
    return records.view_nodes(_table(spark, sf_dir, "region"), key=F.col("r_regionkey"), label=F.col("r_name"))


def count_matching(spark, sf_dir):
    return records.count_matching(_table(spark, sf_dir, "events"), "event_type", "i")


def characters(spark, sf_dir):
    return records.characters(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", delay=50)


def _log_lines(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_type")
    body = (
        F.when(kind == "error", F.concat(F.lit("Error Warning at "), n)).when(kind == "signup", F.concat(F.lit("Warning slow "), n)).when(n % 7 == 0, F.concat(F.lit("Server is listening on port "), 3000 + n % 10))
        .when(n % 7 == 1, F.lit("[nodemon] restarting")).when(n % 7 == 2, F.lit("[webpack] compiled")).when(n % 7 == 3, F.lit("[HTTP Request] GET /")).when(n % 7 == 4, F.lit("[Starting] up")).otherwise(F.concat(F.lit("done "), n))
    )
    return _table(spark, sf_dir, "events").select("event_id", F.concat(F.when(n % 2 == 0, F.concat(F.lit("["), n % 100, F.lit("]"))).otherwise(F.lit("")), body).alias("value"))


def log_classify(spark, sf_dir):
    lines = _log_lines(spark, sf_dir).select("event_id", strip_prefix(F.col("value")).alias("line"))
    out = lines.select("event_id", "line", classify_line(F.col("line")).alias("class"))
    return out.where("class <> 'port'")


def log_ports(spark, sf_dir):
    lines = _log_lines(spark, sf_dir).select("event_id", strip_prefix(F.col("value")).alias("line"))
    return lines.where(classify_line(F.col("line")) == "port").select("event_id", line_port(F.col("line")).alias("port"))


def selection_state(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("db"), F.col("user_id") % 20).alias("name"), F.when(F.col("event_type").isin("click", "purchase"), "row").otherwise("arrow").alias("kind"))
    return folds.selection_state(events)


def click_pairs(spark, sf_dir):
    return folds.click_pairs(_table(spark, sf_dir, "events"), "user_id", "ts", "30 MINUTES").select("user_id", F.col("singles").cast("long").alias("singles"), F.col("doubles").cast("long").alias("doubles"))


def clamped_sum(spark, sf_dir):
    moves = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.floor("value").cast("long") % 200 - 60).alias("dx"))
    return folds.clamped_sum(moves, "user_id", "event_id", "dx").select("event_id", "width")


def last_action_state(spark, sf_dir):
    n = F.col("event_id")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    actions = _table(spark, sf_dir, "events").select(n.alias("seq"), "user_id", pick([folds.CONNECT, folds.LIST_DATABASES, folds.USE_DATABASE, folds.LIST_TABLES], (n * 7 + F.col("user_id")) % 4).alias("action"), pick([folds.PENDING, folds.FULFILLED, folds.REJECTED], (n * 5 + F.col("user_id")) % 3).alias("phase"), F.col("props").alias("payload"), F.concat(F.lit("db"), n).alias("name"))
    return folds.last_action_state(actions, "user_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        list_tables, list_databases, use_database, current_database, server_info, server_fields, connection, quoted_literal, error_envelopes, env_pairs, log_replay, param_query, multi_query, scalar_subqueries, substring_index, nth_words, default_values,
        status_messages, severity_colours, envelope_json, decode_json, ready_replies, column_list, nested_record, first_match, update_where, append_rows, view_nodes, count_matching,
        characters, log_classify, log_ports, selection_state, click_pairs, clamped_sum, last_action_state,
    )
}


def _delegated(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: delegated.run(spark, _lake(spark, sf_dir), name)


QUERIES |= {f"delegated_{name}": _delegated(name) for name in delegated.STATEMENTS}

_LINES = """
SELECT event_id, regexp_replace(CASE WHEN event_id % 2 = 0 THEN '[' || (event_id % 100) || ']' ELSE '' END ||
  CASE WHEN event_type = 'error' THEN 'Error Warning at ' || event_id WHEN event_type = 'signup' THEN 'Warning slow ' || event_id
       WHEN event_id % 7 = 0 THEN 'Server is listening on port ' || (3000 + event_id % 10) WHEN event_id % 7 = 1 THEN '[nodemon] restarting'
       WHEN event_id % 7 = 2 THEN '[webpack] compiled' WHEN event_id % 7 = 3 THEN '[HTTP Request] GET /' WHEN event_id % 7 = 4 THEN '[Starting] up'
       ELSE 'done ' || event_id END, '^\\[[0-9]+\\]', '') AS line FROM events
"""
_CLASSES = """
SELECT event_id, line, CASE WHEN contains(line, 'Error') THEN 'error' WHEN contains(line, 'Warning') THEN 'warning'
  WHEN contains(line, 'Server is listening on port') THEN 'port' WHEN contains(line, '[nodemon]') THEN 'nodemon'
  WHEN contains(line, '[webpack]') THEN 'webpack' WHEN contains(line, '[HTTP Request]') THEN 'http'
  WHEN contains(line, '[Starting]') THEN 'starting' ELSE 'success' END AS class FROM l
"""

ORACLES: dict[str, str] = {
    "list_tables": f"SELECT table_name FROM information_schema.tables WHERE table_schema = 'main' AND table_name IN ({_IN})",
    "list_databases": f"SELECT '{DATABASE}' AS \"Database\"",
    "use_database": f"SELECT '{DATABASE}' AS \"DBName\", string_agg(table_name, ',' ORDER BY table_name) AS \"DBTable\" FROM information_schema.tables WHERE table_schema = 'main' AND table_name IN ({_IN})",
    "current_database": f"SELECT '{DATABASE}' AS current_database",
    "server_fields": "SELECT 'UTF-8' AS character_set, 'parquet' AS engine, true AS has_user, false AS ip_has_at, true AS ip_is_host, true AS has_port, true AS version",
    "connection": f"SELECT * FROM (VALUES ('connected', 'true'), ('current', 'lake_connection'), ('tables', (SELECT CAST(count(*) AS VARCHAR) FROM information_schema.tables WHERE table_schema = 'main' AND table_name IN ({_IN}))), ('used', 'lake_connection'), ('regions', (SELECT CAST(count(*) AS VARCHAR) FROM region WHERE r_regionkey < 3)), ('healthy', 'true'), ('after', 'false'), ('refused', 'true'), ('gone', 'true')) AS t(step, result)",
    "quoted_literal": "SELECT n_nationkey, '?' || n_name || chr(39) AS marked FROM nation WHERE n_name <> '?' AND n_nationkey < 7",
    "error_envelopes": "SELECT n_nationkey, CAST(json_object('message', 'Not connected', 'error', n_name) AS VARCHAR) AS body FROM nation",
    "env_pairs": "SELECT 'R' || r_regionkey AS key, replace(r_name, ' ', '') AS value FROM region UNION ALL SELECT 'A' || r_regionkey, 'x=y' FROM region UNION ALL SELECT 'B' || r_regionkey, '' FROM region",
    "log_replay": f"WITH l AS ({_LINES}), c AS ({_CLASSES}) SELECT class, count(*) AS n FROM c WHERE class <> 'port' GROUP BY class",
    "param_query": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 50000.0",
    "multi_query": "SELECT 0 AS position, count(*) AS n FROM region UNION ALL SELECT 1, count(*) FROM nation UNION ALL SELECT 2, count(*) FROM orders",
    "scalar_subqueries": "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT max(o_orderkey) FROM orders) AS last_order, (SELECT min(n_name) FROM nation) AS first_nation",
    "substring_index": "SELECT c_custkey, split_part(c_name, '#', -1) AS number FROM customer",
    "nth_words": "SELECT p_partkey, string_split(trim(p_type), ' ')[2] AS second, string_split(trim(p_type), ' ')[10] AS tenth FROM part",
    "default_values": "SELECT n_nationkey, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN n_name END, ''), 'localhost') AS host FROM nation",
    "status_messages": """SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN 'Action completed successfully' WHEN 1 THEN 'Action returned a bad request' WHEN 2 THEN 'Internal server error' WHEN 3 THEN 'Something went wrong' END AS title,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 4 THEN NULL ELSE 'please check the console for more details' END AS message FROM events""",
    "severity_colours": "SELECT event_id, CASE event_type WHEN 'error' THEN 'red' WHEN 'purchase' THEN 'green' WHEN 'view' THEN 'yellow' WHEN 'signup' THEN 'blue' END AS colour FROM events",
    "envelope_json": "SELECT n_nationkey, CAST(json_object('message', 'Retrieved', 'data', json_object('DBName', n_name, 'DBTable', json_array(n_name))) AS VARCHAR) AS body FROM nation",
    "decode_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "ready_replies": "SELECT event_id, event_type <> 'error' AS ready FROM events",
    "column_list": "SELECT string_agg(r_name, ',' ORDER BY r_name) AS names FROM region",
    "nested_record": "SELECT CAST(json_object('r_regionkey', r_regionkey, 'r_name', r_name) AS VARCHAR) AS info, '1' AS version FROM region",
    "first_match": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1",
    "update_where": "SELECT n_nationkey, n_name, CASE WHEN n_name LIKE 'A%' THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation",
    "append_rows": "SELECT r_regionkey AS place, r_name AS name FROM region UNION ALL SELECT CAST(n_nationkey + 1 + (SELECT max(r_regionkey) FROM region) AS INTEGER), n_name FROM nation",
    "view_nodes": "SELECT r_regionkey AS key, r_name AS label FROM region",
    "count_matching": "SELECT count(*) AS n FROM events WHERE contains(event_type, 'i')",
    "characters": "SELECT n_nationkey, n_name, CAST(p AS INTEGER) AS place, n_name[p + 1] AS character, CAST(p * 100 + 50 AS INTEGER) AS \"offset\" FROM (SELECT n_nationkey, n_name, unnest(range(length(n_name))) AS p FROM nation)",
    "log_classify": f"WITH l AS ({_LINES}), c AS ({_CLASSES}) SELECT * FROM c WHERE class <> 'port'",
    "log_ports": f"WITH l AS ({_LINES}), c AS ({_CLASSES}) SELECT event_id, regexp_extract(line, '.*port ([0-9]*).*', 1) AS port FROM c WHERE class = 'port'",
    "selection_state": """
WITH e AS (SELECT event_id AS seq, 'db' || (user_id % 20) AS name, CASE WHEN event_type IN ('click', 'purchase') THEN 'row' ELSE 'arrow' END AS kind FROM events),
n AS (SELECT name, max(seq) FILTER (WHERE kind = 'row') AS r, min(seq) AS f, arg_max(kind, seq) AS last, max(seq) AS e FROM e GROUP BY name),
a AS (SELECT e.name, count(*) AS a FROM e JOIN n USING (name) WHERE kind = 'arrow' AND (r IS NULL OR seq > r) GROUP BY e.name),
d AS (SELECT max(greatest(coalesce(r, f), f)) AS d FROM n)
SELECT n.name, CAST(CASE WHEN last = 'row' THEN CASE WHEN d > e THEN 1 ELSE 2 END ELSE (coalesce(a, 0) + CASE WHEN r IS NULL THEN 0 ELSE 1 END) % 2 END AS INTEGER) AS state
FROM n LEFT JOIN a USING (name), d""",
    "click_pairs": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g),
c AS (SELECT user_id, burst, count(*) AS n FROM b GROUP BY user_id, burst)
SELECT user_id, CAST(sum(n % 2) AS BIGINT) AS singles, CAST(sum(n // 2) AS BIGINT) AS doubles FROM c GROUP BY user_id""",
    "clamped_sum": """
WITH m AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) % 200 - 60 AS dx FROM events),
s AS (SELECT event_id, user_id, sum(dx) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM m)
SELECT event_id, CAST(s + greatest(400, max(-s) OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS width FROM s""",
    "last_action_state": """
WITH a AS (SELECT event_id AS seq, user_id, ['connect', 'retrieveAllDatabase', 'useDatabase', 'getTablesFromDatabase'][(event_id * 7 + user_id) % 4 + 1] AS action,
  ['pending', 'fulfilled', 'rejected'][(event_id * 5 + user_id) % 3 + 1] AS phase, props AS payload, 'db' || event_id AS name FROM events)
SELECT user_id, arg_max(payload, seq) FILTER (WHERE action = 'retrieveAllDatabase' AND phase = 'fulfilled') AS databases,
  arg_max(name, seq) FILTER (WHERE action = 'useDatabase' AND phase = 'fulfilled') AS "currentDatabase",
  arg_max(CASE WHEN phase = 'pending' THEN '[]' ELSE payload END, seq) FILTER (WHERE (action = 'useDatabase' AND phase = 'fulfilled') OR (action = 'getTablesFromDatabase' AND phase IN ('pending', 'fulfilled'))) AS tables,
  coalesce(arg_max(phase, seq) FILTER (WHERE action = 'connect') = 'pending', false) AS "loadingDatabaseConnection",
  coalesce(arg_max(phase, seq) FILTER (WHERE action = 'retrieveAllDatabase') = 'pending', false) AS "loadingDatabases",
  coalesce(arg_max(phase, seq) FILTER (WHERE action IN ('useDatabase', 'getTablesFromDatabase')) = 'pending', false) AS "loadingSingleDatabase"
FROM a GROUP BY user_id""",
}
ORACLES |= {f"delegated_{name}": delegated.oracle(name) for name in delegated.STATEMENTS}


def entry(spark: SparkSession) -> DataFrame:
    """The tables of the smallest data directory, by way of the catalog."""
    return list_tables(spark, "/root/testdata/sf0.001")
