"""SQL that the engine hands to Spark as it is: one statement for each kind of query.

Tables stand in braces; ``run`` fills in the database, the oracle the bare name. Sums of money
go through decimals, so that they do not depend on the order of additions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.sql import run_query

_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"
REVENUE = _MONEY.format("l_extendedprice * (1 - l_discount)")

#: Name -> (Spark SQL, what differs in the oracle's dialect as (from, to) pairs).
STATEMENTS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "projection": ("SELECT o_orderkey, upper(o_orderpriority) AS priority, o_totalprice * 0.5 AS half FROM {orders}", []),
    "filter": ("SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'", []),
    "inner_join": ("SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name", []),
    "left_join": ("SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey", []),
    "full_join": ("SELECT coalesce(c_custkey, -1) AS c_custkey, coalesce(s_suppkey, -1) AS s_suppkey FROM {customer} FULL JOIN {supplier} ON c_custkey = s_suppkey", []),
    "semi_join": ("SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)", []),
    "anti_join": ("SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)", []),
    "theta_join": ("SELECT r_name, n_name FROM {region} JOIN {nation} ON n_regionkey < r_regionkey", []),
    "cross_join": ("SELECT a.r_name AS r1, b.r_name AS r2 FROM {region} a CROSS JOIN {region} b", []),
    "group_having": ("SELECT l_suppkey, count(*) AS n, " + REVENUE + " AS revenue FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 5", []),
    "distinct": ("SELECT DISTINCT p_brand, p_size FROM {part}", []),
    "count_distinct": ("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag", []),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", []),
    "cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", []),
    "grouping_sets": ("SELECT coalesce(n_regionkey, -1) AS region, c_mktsegment, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey), (c_mktsegment), ())", []),
    "window_rank": ("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM {orders}", []),
    "window_frame": ("SELECT event_id, sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM {events}", [("SELECT event_id, sum(CAST(value * 100 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s", "SELECT event_id, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s")]),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", []),
    "offset": ("SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 5", []),
    "union": ("SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", []),
    "union_all": ("SELECT r_name AS name FROM {region} UNION ALL SELECT n_name FROM {nation}", []),
    "intersect": ("SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", []),
    "except": ("SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45", []),
    "cte": ("WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT n, count(*) AS customers FROM big GROUP BY n", []),
    "recursive_cte": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t", []),
    "scalar_subquery": ("SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})", []),
    "in_subquery": ("SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)", []),
    "case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM {part}", []),
    "string_functions": ("SELECT c_custkey, lower(c_name) AS l, CAST(length(c_name) AS BIGINT) AS n, substring(c_name, 1, 4) AS head, replace(c_mktsegment, 'A', 'a') AS r, concat(c_mktsegment, '-', c_name) AS joined, trim(concat(' ', c_name, ' ')) AS t FROM {customer}", []),
    "date_functions": ("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month_start FROM {orders}", []),
    "math_functions": ("SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, floor(l_extendedprice) AS f, sqrt(l_quantity) AS s, CAST(l_orderkey % 7 AS BIGINT) AS m FROM {lineitem}", [("floor(l_extendedprice)", "CAST(floor(l_extendedprice) AS BIGINT)")]),
    "json_functions": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", [("CAST(get_json_object(props, '$.k') AS INT)", "CAST(json_extract_string(props, '$.k') AS INTEGER)")]),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, " + _MONEY.format("l_quantity") + " AS sum_qty, " + _MONEY.format("l_extendedprice") + " AS sum_base, " + REVENUE + " AS sum_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", []),
    "regional_volume": ("SELECT n_name, " + REVENUE + " AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name", []),
}


def run(spark: SparkSession, database: str, name: str) -> DataFrame:
    return run_query(spark, re.sub(r"\{(\w+)\}", rf"{database}.\1", STATEMENTS[name][0]))


def oracle(name: str) -> str:
    text, changes = STATEMENTS[name]
    for old, new in changes:
        text = text.replace(old, new)
    return re.sub(r"\{(\w+)\}", r"\1", text)
