"""TPC-H shaped queries on the tables at hand; constants and columns that are absent are adapted."""

from __future__ import annotations

from basalt.plans.registry import sql_operator as q

#: Money is summed as decimals, so a sum does not depend on the order of its rows.
_NET = "(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(3, 2))))"

q("tpch_q3", "7.3", f"SELECT l_orderkey, CAST(sum({_NET}) AS DOUBLE) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10", tables=("customer", "orders", "lineitem"))
q("tpch_q4", "7.3", "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1997-07-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority", tables=("orders", "lineitem"))
q("tpch_q5", "7.3", f"SELECT n_name, CAST(sum({_NET}) AS DOUBLE) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name", tables=("customer", "orders", "lineitem", "supplier", "nation", "region"))
q("tpch_q6", "7.3", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(3, 2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24", tables=("lineitem",))
q("tpch_q7", "7.3", f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, CAST(sum({_NET}) AS DOUBLE) AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) GROUP BY 1, 2, 3", tables=("supplier", "lineitem", "orders", "customer", "nation"))
q("tpch_q8", "7.3", f"SELECT o_year, CAST(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE) AS mkt_share FROM (SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {_NET} AS volume, n2.n_name AS nation FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') GROUP BY o_year", tables=("part", "supplier", "lineitem", "orders", "customer", "nation", "region"))
q("tpch_q10", "7.3", f"SELECT c_custkey, c_name, CAST(sum({_NET}) AS DOUBLE) AS revenue, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20", tables=("customer", "orders", "lineitem", "nation"))
q("tpch_q12", "7.3", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus", tables=("orders", "lineitem"))
q("tpch_q13", "7.3", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) GROUP BY c_count", tables=("customer", "orders"))
q("tpch_q14", "7.3", f"SELECT CAST(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_NET} ELSE 0 END) AS DOUBLE) / CAST(sum({_NET}) AS DOUBLE) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1998-09-01'", tables=("lineitem", "part"))
q("tpch_q15", "7.3", f"WITH revenue AS (SELECT l_suppkey AS s, CAST(sum({_NET}) AS DOUBLE) AS total FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = s WHERE total = (SELECT max(total) FROM revenue)", tables=("lineitem", "supplier"))
q("tpch_q17", "7.3", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DOUBLE) / 7 AS avg_yearly FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p.p_partkey)", tables=("lineitem", "part"))
q("tpch_q18", "7.3", "SELECT c_custkey, o_orderkey, o_totalprice, CAST(sum(CAST(l_quantity AS DECIMAL(8, 2))) AS DOUBLE) AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", tables=("customer", "orders", "lineitem"))
q("tpch_q19", "7.3", f"SELECT CAST(sum({_NET}) AS DOUBLE) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size <= 15) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size <= 30)", tables=("lineitem", "part"))
q("tpch_q21", "7.3", "SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name", tables=("supplier", "lineitem", "orders"))
q("tpch_q22", "7.3", "SELECT c_nationkey, count(*) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(12, 2))) AS DOUBLE) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000) GROUP BY c_nationkey", tables=("customer", "orders"))

#: The tables have no partsupp: who has supplied what, with a quantity and a cost that follow from the line items and the part's price.
_PARTSUPP = """partsupp AS (
 SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(8, 2))) AS BIGINT) AS ps_availqty,
        max(CAST(p_retailprice AS DECIMAL(12, 2))) * CAST(50 + l_suppkey % 10 AS DECIMAL(3, 0)) * CAST(0.01 AS DECIMAL(3, 2)) AS ps_supplycost
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_suppkey)"""
q("tpch_q2", "7.3", f"WITH {_PARTSUPP}, offers AS (SELECT s_acctbal, s_name, n_name, ps_partkey, ps_supplycost FROM partsupp, supplier, nation, region WHERE s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE') SELECT s_acctbal, s_name, n_name, p_partkey FROM part, offers WHERE p_partkey = ps_partkey AND p_size <= 15 AND p_type = 'ECONOMY' AND ps_supplycost = (SELECT min(o.ps_supplycost) FROM offers o WHERE o.ps_partkey = p_partkey) ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100", tables=("part", "supplier", "lineitem", "nation", "region"))
q("tpch_q9", "7.3", f"WITH {_PARTSUPP} SELECT n_name, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, CAST(sum({_NET} - ps_supplycost * CAST(l_quantity AS DECIMAL(8, 2))) AS DOUBLE) AS amount FROM part, supplier, lineitem, partsupp, orders, nation WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%blue%' GROUP BY 1, 2", tables=("part", "supplier", "lineitem", "orders", "nation"))
q("tpch_q11", "7.3", f"WITH {_PARTSUPP}, held AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS worth FROM partsupp, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7') SELECT ps_partkey, CAST(sum(worth) AS DOUBLE) AS part_value FROM held GROUP BY ps_partkey HAVING sum(worth) * 1000 > (SELECT sum(worth) FROM held)", tables=("part", "supplier", "lineitem", "nation"))
q("tpch_q16", "7.3", f"WITH {_PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size", tables=("part", "supplier", "lineitem"))
q("tpch_q20", "7.3", f"WITH {_PARTSUPP} SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 2 AND s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND ps_availqty > (SELECT 0.5 * sum(CAST(l_quantity AS DECIMAL(8, 2))) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1999-01-01'))", tables=("part", "supplier", "lineitem", "nation"))
