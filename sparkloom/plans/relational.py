"""Relational queries: scans, expressions, joins, aggregates, order. Spark SQL text, and DuckDB's where it differs."""

from __future__ import annotations

#: name: (tables, Spark SQL, DuckDB SQL or None where the same text serves)
QUERIES: dict[str, tuple[str, str, str | None]] = {
    "flagship": ("customer nation", """SELECT n_name, COUNT(*) AS cnt, ROUND(AVG(c_acctbal), 2) AS avg_bal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        WHERE c_acctbal > 0 GROUP BY n_name HAVING COUNT(*) > 5 ORDER BY cnt DESC, n_name LIMIT 10""", None),
    "scan_star": ("orders", "SELECT * FROM orders", None),
    "project_alias": ("customer", "SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM customer", None),
    "filter_cmp": ("lineitem", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 40 AND l_discount < 0.05 AND l_returnflag <> 'R'", None),
    "index_lookup": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 250", None),
    "filter_bool_3vl": ("customer", "SELECT c_custkey FROM (SELECT c_custkey, c_acctbal, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE NOT (seg = 'MACHINERY' OR c_acctbal < 0) AND (seg IS NULL OR c_acctbal > 100)", None),
    "is_null": ("customer", "SELECT COUNT(*) AS n, COUNT(seg) AS known FROM (SELECT NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) t WHERE seg IS NULL OR seg IS NOT NULL AND seg <> 'MACHINERY'", None),
    "in_list": ("customer", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_mktsegment IN ('BUILDING', 'MACHINERY')", None),
    "not_in": ("customer", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 3, 5, 7) AND (c_custkey IN (2, 4, NULL) OR c_custkey > 50)", None),
    "between": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 10 AND 5000", None),
    "like": ("part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_brand LIKE 'Brand#_%'", None),
    "not_like": ("part", "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%E%'", None),
    "arith": ("lineitem", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) + l_tax - -l_quantity, 4) AS v FROM lineitem", None),
    "div_zero_null": ("lineitem", "SELECT l_orderkey, l_linenumber, ROUND(try_divide(l_extendedprice, l_linenumber - 1), 4) AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice / NULLIF(l_linenumber - 1, 0), 4) AS q FROM lineitem"),
    "str_concat": ("nation", "SELECT n_name || '/' || CAST(n_regionkey AS STRING) AS tag FROM nation", "SELECT n_name || '/' || CAST(n_regionkey AS VARCHAR) AS tag FROM nation"),
    "select_no_from": ("", "SELECT CAST(1 + 1 AS BIGINT) AS two, 'it''s' AS s", None),
    "coalesce": ("customer", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), c_name, 'none') AS v FROM customer", None),
    "upper_lower": ("customer", "SELECT c_custkey, UPPER(c_name) AS up, LOWER(c_mktsegment) AS low, UPPER(CAST(c_nationkey AS STRING)) AS num FROM customer", "SELECT c_custkey, UPPER(c_name) AS up, LOWER(c_mktsegment) AS low, UPPER(CAST(c_nationkey AS VARCHAR)) AS num FROM customer"),
    "length": ("customer", "SELECT c_custkey, CAST(LENGTH(c_name) AS BIGINT) AS n, CAST(LENGTH(CAST(c_custkey AS STRING)) AS BIGINT) AS digits FROM customer", "SELECT c_custkey, CAST(LENGTH(c_name) AS BIGINT) AS n, CAST(LENGTH(CAST(c_custkey AS VARCHAR)) AS BIGINT) AS digits FROM customer"),
    "join_inner": ("orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000", None),
    "join_theta": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey", None),
    "join_cross": ("nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "join_left": ("customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", None),
    "join_right": ("customer orders", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 10) c RIGHT JOIN orders ON c_custkey = o_custkey", None),
    "join_full": ("supplier customer", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_suppkey < 60) s FULL JOIN (SELECT * FROM customer WHERE c_custkey > 30) c ON s_suppkey = c_custkey", None),
    "join_chain": ("customer nation region orders", "SELECT r_name, n_name, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name", None),
    "join_self": ("nation", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "agg_global": ("orders", "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders", None),
    "agg_empty": ("orders", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderpriority) AS lo FROM orders WHERE o_orderkey < 0", None),
    "group_by": ("lineitem", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_expr": ("customer", "SELECT c_nationkey * 10 AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey * 10", None),
    "group_null": ("customer", "SELECT seg, COUNT(*) AS n FROM (SELECT NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) t GROUP BY seg", None),
    "having": ("orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND MAX(o_totalprice) > 1000", None),
    "count_col": ("customer", "SELECT c_nationkey, COUNT(NULLIF(c_mktsegment, 'BUILDING')) AS n FROM customer GROUP BY c_nationkey", None),
    "count_distinct": ("lineitem", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", None),
    "sum_distinct": ("lineitem", "SELECT l_returnflag, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag", None),
    "distinct": ("lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_limit": ("orders", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderpriority, o_orderstatus LIMIT 4", None),
    "order_limit": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25", None),
    "topk_desc": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25", None),
    "order_unprojected": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "order_nulls": ("customer", "SELECT c_custkey, seg FROM (SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer) t ORDER BY seg ASC NULLS FIRST, c_custkey LIMIT 30", None),
    "any_of_group": ("customer nation", "SELECT c_nationkey, any_value(n_name) AS n_name, COUNT(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey", None),
    "now": ("orders", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) < CAST(NOW() AS DATE) GROUP BY o_orderstatus", None),
}
