"""Relational operators as declarative queries: scans, predicates, joins, aggregates, windows, ordering, sets, CTEs.

Every entry is plain SQL that Catalyst plans; where the text that an independent engine needs differs
(null placement, integer width), it is given as the second text.
"""

from __future__ import annotations

from basalt.plans.registry import sql_operator as q

# Scans and projections.
q("scan_all", "2.1", "SELECT r_regionkey, r_name FROM region", tables=("region",))
q("scan_pruned", "2.1", "SELECT o_orderkey, o_totalprice FROM orders", tables=("orders",))
q("index_scan_point", "2.1", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42", tables=("orders",))
q("index_scan_range", "2.1", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 199", tables=("orders",))
q("zone_map_skipping", "2.1", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey < 50 AND l_quantity > 30", tables=("lineitem",))
q("values_rows", "2.1", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
q("empty_relation", "2.1", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 0", tables=("nation",))
q("project_expressions", "2.2", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) AS flag FROM lineitem", tables=("lineitem",))
q("distinct_rows", "2.4", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", tables=("lineitem",))

# Predicates and expressions.
q("filter_comparisons", "2.2", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11' AND NOT (p_retailprice > 1500)", tables=("part",))
q("filter_in_list", "2.2", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)", tables=("customer",))
q("filter_like", "2.2", r"SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%O%' AND p_name NOT LIKE '%9_' ", tables=("part",))
q("filter_like_escape", "2.2", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'", tables=("nation",))
q("filter_regexp", "2.2", "SELECT n_name FROM nation WHERE n_name RLIKE '_[0-4]$'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '_[0-4]$')", ("nation",))
q("filter_between", "2.2", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 AND o_orderkey NOT BETWEEN 500 AND 700", tables=("orders",))
q("filter_null_logic", "2.2", "SELECT a, b, a = b AS eq, a IS NULL AS an, b IS NOT NULL AS bn, (a > 1) OR (b > 1) AS either FROM (VALUES (1, 2), (NULL, 2), (3, NULL), (CAST(NULL AS INT), CAST(NULL AS INT))) AS t(a, b)")
q("case_searched", "2.2", "SELECT o_orderpriority, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS band, count(*) AS n FROM orders GROUP BY 1, 2", tables=("orders",))
q("case_simple", "2.2", "SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS s, count(*) AS n FROM orders GROUP BY 1", tables=("orders",))
q("if_function", "2.2", "SELECT if(p_size > 25, 'large', 'small') AS sz, count(*) AS n FROM part GROUP BY 1", "SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS sz, count(*) AS n FROM part GROUP BY 1", ("part",))
q("safe_arithmetic", "2.2", "SELECT p_partkey, try_divide(p_retailprice, p_size - 10) AS ratio, try_mod(p_partkey, p_size - 10) AS rest, -p_size AS neg FROM part",
  "SELECT p_partkey, p_retailprice / nullif(p_size - 10, 0) AS ratio, p_partkey % nullif(p_size - 10, 0) AS rest, -p_size AS neg FROM part", ("part",))
q("concat_operator", "2.2", "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS STRING) AS label FROM nation", "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR) AS label FROM nation", ("nation",))
q("bit_shifts", "2.2", "SELECT n_nationkey, CAST(n_nationkey << 3 AS BIGINT) AS l, CAST(n_nationkey >> 1 AS BIGINT) AS r, CAST(n_nationkey & 6 AS BIGINT) AS a, CAST(n_nationkey | 8 AS BIGINT) AS o FROM nation", tables=("nation",))
q("extract_parts", "2.2", "SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1, 2", tables=("orders",))
q("match_against", "2.2", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(source), 'src1')", tables=("documents",))
q("constant_folding", "4", "SELECT count(*) AS n FROM orders WHERE 1 = 1 AND (2 > 3 OR o_orderkey > 10 - 5)", tables=("orders",))

# Joins.
q("join_inner", "2.3", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000", tables=("orders", "customer"))
q("join_left", "2.3", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 50000 GROUP BY c.c_custkey", tables=("orders", "customer"))
q("join_right", "2.3", "SELECT r.r_name, n.n_name FROM (SELECT * FROM nation WHERE n_nationkey < 7) n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey", tables=("nation", "region"))
q("join_full", "2.3", "SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey >= 10) b ON a.k = b.k", tables=("nation",))
q("join_cross", "2.3", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", tables=("nation", "region"))
q("join_comma", "2.3", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", tables=("nation", "region"))
q("join_natural", "2.3", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT c_custkey AS k, c_name AS b FROM customer) y", tables=("nation", "customer"))
q("join_using", "2.3", "SELECT k, count(*) AS n FROM (SELECT n_nationkey AS k FROM nation) x JOIN (SELECT c_nationkey AS k FROM customer) y USING (k) GROUP BY k", tables=("nation", "customer"))
q("join_theta", "2.3", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", tables=("nation",))
q("join_range", "2.3", "SELECT b.lo, count(*) AS n FROM (VALUES (0, 10), (10, 20), (20, 51)) AS b(lo, hi) JOIN part p ON p.p_size >= b.lo AND p.p_size < b.hi GROUP BY b.lo", tables=("part",))
q("join_multiway", "2.3", "SELECT r.r_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name", tables=("region", "nation", "customer", "orders"))
q("join_null_keys", "2.3", "SELECT a.k AS ak, b.k AS bk, a.v AS av, b.v AS bv FROM (VALUES (1, 'a'), (NULL, 'b')) AS a(k, v) FULL OUTER JOIN (VALUES (1, 'c'), (NULL, 'd')) AS b(k, v) ON a.k = b.k")
q("join_semi", "2.3", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 100000)", ("customer", "orders"))
q("join_anti", "2.3", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)", ("customer", "orders"))
q("join_broadcast_hint", "2.3", "SELECT /*+ BROADCAST(n) */ n.n_name, count(*) AS n_cust FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n.n_name, count(*) AS n_cust FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", ("customer", "nation"))
q("join_merge_hint", "2.3", "SELECT /*+ MERGE(o) */ c.c_mktsegment, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment", "SELECT c.c_mktsegment, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment", ("customer", "orders"))
q("join_shuffle_hash_hint", "2.3", "SELECT /*+ SHUFFLE_HASH(o) */ c.c_nationkey, round(avg(o.o_totalprice) + 0.0000001, 4) AS mean FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey", "SELECT c.c_nationkey, round(avg(o.o_totalprice) + 0.0000001, 4) AS mean FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey", ("customer", "orders"))

# Aggregates.
q("aggregate_global", "2.4", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS custs, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice) + 0.0000001, 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders", tables=("orders",))
q("aggregate_empty", "2.4", "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS top FROM orders WHERE o_orderkey < 0", tables=("orders",))
q("aggregate_having", "2.4", "SELECT o_custkey, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15", tables=("orders",))
q("aggregate_distinct", "2.4", "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS np, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS sc, round(avg(DISTINCT o_custkey) + 0.0000001, 4) AS ac FROM orders GROUP BY o_orderstatus", tables=("orders",))
q("aggregate_null_keys", "2.4", "SELECT k, count(*) AS n, count(v) AS nv, CAST(sum(v) AS BIGINT) AS s FROM (VALUES ('NULL', 1), (NULL, 2), (NULL, NULL), ('a', 3)) AS t(k, v) GROUP BY k")
q("aggregate_filter", "2.4", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS tax FROM lineitem GROUP BY l_returnflag", tables=("lineitem",))
q("rollup", "2.4", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", tables=("lineitem",))
q("cube", "2.4", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", tables=("lineitem",))
q("grouping_sets", "2.4", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", tables=("orders",))
q("with_rollup", "2.4", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment WITH ROLLUP", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP(c_mktsegment)", ("customer",))
q("stddev_variance", "2.8.7", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs FROM lineitem GROUP BY l_returnflag", tables=("lineitem",))
q("bit_aggregates", "2.8.7", "SELECT c_mktsegment, bit_and(c_custkey) AS ba, bit_or(c_custkey) AS bo, bit_xor(c_custkey) AS bx FROM customer GROUP BY c_mktsegment", tables=("customer",))
q("group_concat", "2.8.1", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", ("nation",))
q("approx_is_bounded", "2.4", "SELECT count(*) AS groups FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)", tables=("orders",))

# Window functions: explicit frames, total orders.
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"
_ROWS = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
q("window_ranking", "2.5", f"SELECT o_orderkey, CAST(row_number() {_W} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr FROM orders", tables=("orders",))
q("window_ntile", "2.5", f"SELECT o_orderkey, CAST(ntile(4) {_W} AS BIGINT) AS nt FROM orders", tables=("orders",))
q("window_lead_lag", "2.5", f"SELECT o_orderkey, lead(o_orderkey) {_W} AS nx, lag(o_orderkey, 2, CAST(-1 AS BIGINT)) {_W} AS pv FROM orders", tables=("orders",))
q("window_values", "2.5", f"SELECT o_orderkey, first_value(o_orderkey) {_ROWS} AS f, last_value(o_orderkey) {_ROWS} AS l, nth_value(o_orderkey, 2) {_ROWS} AS s FROM orders", tables=("orders",))
q("window_aggregates", "2.5", f"SELECT o_orderkey, round(sum(o_totalprice) {_ROWS}, 2) AS rs, count(*) {_ROWS} AS rc, min(o_totalprice) {_ROWS} AS mn, max(o_totalprice) {_ROWS} AS mx, round(avg(o_totalprice) {_ROWS} + 0.0000001, 4) AS av FROM orders", tables=("orders",))
q("window_sliding", "2.5", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS c FROM orders", tables=("orders",))
q("window_distribution", "2.5", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), 9) AS cd FROM part", tables=("part",))
q("window_whole_partition", "2.5", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS diff FROM customer", tables=("customer",))
q("top_k_per_group", "2.6", "SELECT * FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer) WHERE rn <= 3", tables=("customer",))

# Sort and limit.
q("sort_nulls", "2.6", "SELECT v, CAST(row_number() OVER (ORDER BY v ASC NULLS LAST) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY v DESC NULLS LAST) AS BIGINT) AS down FROM (VALUES (3), (NULL), (1)) AS t(v)")
q("limit_offset", "2.6", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10", tables=("orders",))
q("top_k", "2.6", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25", tables=("part",))

# Set operations, CTEs, subqueries.
q("union_distinct", "2.7", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", tables=("customer", "supplier"))
q("union_all", "2.7", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k", tables=("customer", "supplier"))
q("intersect_distinct", "2.7", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier", tables=("customer", "supplier"))
q("intersect_all", "2.7", "SELECT v FROM (VALUES (1), (1), (2), (NULL), (NULL)) AS a(v) INTERSECT ALL SELECT v FROM (VALUES (1), (1), (1), (NULL)) AS b(v)")
q("except_distinct", "2.7", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", tables=("customer", "orders"))
q("except_all", "2.7", "SELECT v FROM (VALUES (1), (1), (2), (NULL), (NULL)) AS a(v) EXCEPT ALL SELECT v FROM (VALUES (1), (NULL)) AS b(v)")
q("set_chain", "2.7", "(SELECT 1 AS v UNION SELECT 2) UNION ALL (SELECT 2 EXCEPT SELECT 3)")
q("cte_multiple", "2.7", "WITH big AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY 1), top AS (SELECT k FROM big WHERE t > 500000) SELECT c.c_mktsegment, count(*) AS n FROM customer c JOIN top ON c.c_custkey = top.k GROUP BY 1", tables=("orders", "customer"))
q("cte_column_list", "2.7", "WITH t(a, b) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT a, b FROM t WHERE b > 1", tables=("nation",))
q("cte_recursive", "2.7", "WITH RECURSIVE c(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM c WHERE n < 12) SELECT n, f FROM c")
q("derived_table", "2.7", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE n > 10", tables=("customer",))
q("subquery_in", "2.7", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)", tables=("nation", "supplier"))
q("subquery_not_in_null", "2.7", "SELECT v FROM (VALUES (1), (2), (NULL)) AS a(v) WHERE v NOT IN (SELECT w FROM (VALUES (1), (NULL)) AS b(w))")
q("subquery_exists", "2.7", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", tables=("customer", "orders"))
q("subquery_scalar", "2.7", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM part)", tables=("part",))
q("subquery_correlated", "2.7", "SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c", tables=("customer", "orders"))
q("view_query", "2.7", "WITH rich AS (SELECT * FROM customer WHERE c_acctbal > 8000) SELECT c_nationkey, count(*) AS n FROM rich GROUP BY c_nationkey", tables=("customer",))
