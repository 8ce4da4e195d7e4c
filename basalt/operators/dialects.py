"""Queries in the MySQL flavour, through the dialect shim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basalt.dialect import query
from basalt.plans.registry import OPERATORS, Operator
from basalt.session import register_views


def _flavoured(name: str, section: str, sql: str, oracle: str, *tables: str, **args) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, *tables)
        return query(spark, sql, **args)

    OPERATORS[name] = Operator(run, oracle, section)


_flavoured("dialect_limit", "2.6", "SELECT `o_orderkey` FROM orders ORDER BY o_orderkey DESC LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5", "orders")
_flavoured("dialect_straight_join", "2.3", "SELECT n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
_flavoured("dialect_regexp", "2.8", "SELECT n_name FROM nation WHERE n_name REGEXP '_[0-4]$' AND n_name NOT REGEXP '3'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '_[0-4]$') AND NOT regexp_matches(n_name, '3')", "nation")
_flavoured("dialect_group_concat", "2.8.1", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "nation")
_flavoured("dialect_quantified", "2.2", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3) OR c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey < 3)", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3) OR c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey < 3)", "customer", "supplier")
_flavoured("dialect_date_functions", "2.8.4", "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y/%m') AS ym, DATE_ADD(CAST(o_orderdate AS DATE), INTERVAL 1 MONTH) AS later, WEEK(o_orderdate) AS w FROM orders",
           "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') AS ym, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS later, (dayofyear(o_orderdate) + 6 - dayofweek(o_orderdate)) // 7 AS w FROM orders", "orders")
_flavoured("dialect_strings", "2.8.1", "SELECT n_nationkey, LENGTH(n_name) AS n, POSITION('_' IN n_name) AS p, SUBSTRING(n_name FROM 2 FOR 3) AS s, TRIM(LEADING 'NAT' FROM n_name) AS t, FIELD(n_name, 'NATION_1', 'NATION_2') AS f, IFNULL(NULLIF(n_regionkey, 1), -1) AS i FROM nation",
           "SELECT n_nationkey, octet_length(encode(n_name)) AS n, position('_' IN n_name) AS p, substring(n_name, 2, 3) AS s, regexp_replace(n_name, '^(NAT)+', '') AS t, CASE n_name WHEN 'NATION_1' THEN 1 WHEN 'NATION_2' THEN 2 ELSE 0 END AS f, coalesce(nullif(n_regionkey, 1), -1) AS i FROM nation", "nation")
_flavoured("dialect_json_arrows", "2.8.5", "SELECT event_id, props->>'$.k' AS k, props->'$.k' AS raw FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS raw FROM events", "events")
_flavoured("dialect_sounds_like", "2.8", "SELECT n_nationkey FROM nation WHERE n_name SOUNDS LIKE 'NATION'", "SELECT n_nationkey FROM nation", "nation")
_flavoured("dialect_parameters", "2.13", "SELECT o_orderkey FROM orders WHERE o_custkey = :cust AND o_totalprice > :low", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 100", "orders", cust=7, low=100)
