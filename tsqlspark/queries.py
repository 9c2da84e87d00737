"""One query for each operator and function group of the dialect: T-SQL text, the tables it reads, DuckDB SQL with the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

PRICING = """
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       ROUND(AVG(l_quantity), 2) AS avg_qty, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""

#: name -> (T-SQL, DuckDB SQL); the last result set of the T-SQL batch is the query's result.
PAIRS: dict[str, tuple[str, str | None]] = {
    "pricing_summary": (PRICING, PRICING.replace("COUNT(*)", "COUNT(*)::int")),
    "project_arith": ("SELECT o_orderkey, o_custkey * 2 + 1 AS a, -o_custkey AS b, (o_custkey - 3) * 4 AS c FROM orders", "SELECT o_orderkey, o_custkey * 2 + 1 AS a, -o_custkey AS b, (o_custkey - 3) * 4 AS c FROM orders"),
    "filter_3vl": (
        "SELECT o_orderkey FROM orders WHERE NOT (NULLIF(o_orderstatus, 'F') = 'O' AND o_custkey > 50) OR o_orderpriority = '1-URGENT'",
        "SELECT o_orderkey FROM orders WHERE NOT (NULLIF(o_orderstatus, 'F') = 'O' AND o_custkey > 50) OR o_orderpriority = '1-URGENT'",
    ),
    "int_division": ("SELECT o_orderkey, o_custkey / 7 AS q, -o_custkey / 7 AS n, o_custkey % 7 AS r, -o_custkey % 7 AS m FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, -o_custkey // 7 AS n, o_custkey % 7 AS r, -o_custkey % 7 AS m FROM orders"),
    "decimal_division_trunc": (
        "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS decimal(4,1)) / CAST(7 AS decimal(2,1)) AS q FROM lineitem",
        "SELECT l_orderkey, l_linenumber, (((l_linenumber * 1000000) // 7)::decimal(12,0) * 0.000001::decimal(6,6))::decimal(11,6) AS q FROM lineitem",
    ),
    "decimal_types": ("SELECT p_partkey, CAST(p_size AS decimal(5,2)) + CAST(1 AS decimal(3,1)) AS a, CAST(p_size AS decimal(5,2)) * CAST(2 AS decimal(3,1)) AS b FROM part", "SELECT p_partkey, p_size::decimal(5,2) + 1::decimal(3,1) AS a, p_size::decimal(5,2) * 2::decimal(3,1) AS b FROM part"),
    "avg_int_trunc": ("SELECT p_brand, AVG(p_size) AS a, SUM(p_size) AS s, COUNT(p_size) AS n FROM part GROUP BY p_brand", "SELECT p_brand, (sum(p_size) // count(p_size))::int AS a, sum(p_size)::int AS s, count(p_size)::int AS n FROM part GROUP BY p_brand"),
    "sum_decimal": ("SELECT o_orderstatus, SUM(CAST(o_custkey AS decimal(12,2))) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(o_custkey::decimal(12,2))::decimal(38,2) AS s FROM orders GROUP BY o_orderstatus"),
    "count_big_distinct": ("SELECT COUNT_BIG(*) AS n, COUNT(DISTINCT o_custkey) AS d, SUM(DISTINCT o_custkey) AS s FROM orders", "SELECT count(*) AS n, count(DISTINCT o_custkey)::int AS d, sum(DISTINCT o_custkey)::bigint AS s FROM orders"),
    "having_groups": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000", "SELECT o_custkey, count(*)::int AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000"),
    "having_no_group": ("SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10", "SELECT count(*)::int AS n FROM orders HAVING count(*) > 10"),
    "scalar_agg_empty": ("SELECT COUNT(*) AS n, MAX(o_orderkey) AS m FROM orders WHERE 1 = 0", "SELECT count(*)::int AS n, max(o_orderkey) AS m FROM orders WHERE 1 = 0"),
    "group_by_expr": ("SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) / 4 AS q, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), MONTH(o_orderdate) / 4", "SELECT year(o_orderdate)::int AS y, (month(o_orderdate) // 4)::int AS q, count(*)::int AS n FROM orders GROUP BY 1, 2"),
    "group_by_constant": ("SELECT COUNT(*) AS n FROM orders GROUP BY o_orderstatus, 1", "SELECT count(*)::int AS n FROM orders GROUP BY o_orderstatus"),
    "group_null_keys": ("SELECT NULLIF(o_orderstatus, 'O') AS k, COUNT(*) AS n FROM orders GROUP BY NULLIF(o_orderstatus, 'O')", "SELECT nullif(o_orderstatus, 'O') AS k, count(*)::int AS n FROM orders GROUP BY 1"),
    "min_max": ("SELECT p_brand, MIN(p_name) AS lo, MAX(p_size) AS hi FROM part GROUP BY p_brand", "SELECT p_brand, min(p_name) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand"),
    "inner_join": ("SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "left_join": ("SELECT n.n_name, s.s_name FROM nation n LEFT OUTER JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", "SELECT n_name, s_name FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000"),
    "right_join": ("SELECT s.s_name, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey", "SELECT s_name, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "full_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a FULL OUTER JOIN nation b ON a.n_nationkey = b.n_nationkey + 20", "SELECT a.n_name AS x, b.n_name AS y FROM nation a FULL JOIN nation b ON a.n_nationkey = b.n_nationkey + 20"),
    "cross_join": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "theta_join": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey"),
    "comma_join": ("SELECT c.c_name, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000", "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 9000"),
    "self_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey"),
    "join_chain": (
        "SELECT r.r_name, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS s FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
        "SELECT r_name, count(*)::int AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name",
    ),
    "star_expansion": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", "SELECT nation.*, r_name FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "aliases": ("SELECT k = n_nationkey, n_name nm, n_regionkey 'rk', n_regionkey * 2 AS [dbl] FROM nation", "SELECT n_nationkey AS k, n_name AS nm, n_regionkey AS rk, n_regionkey * 2 AS dbl FROM nation"),
    "semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT * FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 AS one FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)"),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "not_in_null": (
        "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(s_nationkey, 3) FROM supplier) OR n_nationkey NOT IN (SELECT r_regionkey FROM region)",
        "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier) OR n_nationkey NOT IN (SELECT r_regionkey FROM region)",
    ),
    "in_list": ("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#22')", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#22')"),
    "between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1000", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 1000"),
    "scalar_subquery_correlated": (
        "SELECT c_custkey, (SELECT MAX(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS last_order FROM customer c",
        "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer",
    ),
    "scalar_subquery": ("SELECT p_partkey FROM part WHERE p_size > (SELECT AVG(p_size) FROM part)", "SELECT p_partkey FROM part WHERE p_size > (SELECT sum(p_size) // count(p_size) FROM part)"),
    "subquery_in_on": ("SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey > (SELECT MIN(r_regionkey) FROM region)", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > (SELECT min(r_regionkey) FROM region)"),
    "quantified_all": ("SELECT p_partkey FROM part WHERE p_size > ALL (SELECT p_size FROM part WHERE p_partkey < 5)", "SELECT p_partkey FROM part WHERE p_size > ALL (SELECT p_size FROM part WHERE p_partkey < 5)"),
    "quantified_any": ("SELECT p_partkey FROM part WHERE p_size < ANY (SELECT p_size FROM part WHERE p_partkey < 5) AND p_size = SOME (SELECT p_size FROM part WHERE p_partkey > 100)", "SELECT p_partkey FROM part WHERE p_size < ANY (SELECT p_size FROM part WHERE p_partkey < 5) AND p_size IN (SELECT p_size FROM part WHERE p_partkey > 100)"),
    "derived_table": ("SELECT d.k, d.n FROM (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS d(k, n) WHERE d.n > 10", "SELECT k, n FROM (SELECT o_custkey AS k, count(*)::int AS n FROM orders GROUP BY o_custkey) WHERE n > 10"),
    "values_table": ("SELECT v.id, v.name FROM (VALUES (1, 'a'), (2, 'bc'), (3, NULL)) AS v(id, name)", "SELECT * FROM (VALUES (1, 'a'), (2, 'bc'), (3, NULL)) AS v(id, name)"),
    "one_row": ("SELECT 1 AS a, 'x' AS b, 2.50 AS c", "SELECT 1 AS a, 'x' AS b, 2.50 AS c"),
    "top_n": ("SELECT TOP 10 o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 10"),
    "top_percent": ("SELECT TOP (3) PERCENT p_partkey FROM part ORDER BY p_partkey", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT (SELECT ceil(count(*) * 3 / 100.0)::bigint FROM part)"),
    "top_with_ties": ("SELECT TOP 5 WITH TIES p_partkey, p_size FROM part ORDER BY p_size", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 5"),
    "offset_fetch": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 20 ROWS FETCH NEXT 10 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "union_dedup": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "except_rows": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0"),
    "intersect_rows": ("SELECT n_nationkey AS k FROM nation UNION SELECT 99 INTERSECT SELECT s_nationkey FROM supplier", "SELECT n_nationkey AS k FROM nation UNION (SELECT 99 INTERSECT SELECT s_nationkey FROM supplier)"),
    "setop_numeric_typing": ("SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 2.5", "SELECT 1::decimal(2,1) AS a UNION ALL SELECT 2::decimal(2,1) UNION ALL SELECT 2.5::decimal(2,1)"),
    "order_by_hidden": ("SELECT TOP 7 n_name FROM nation ORDER BY n_nationkey * -1", "SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 7"),
    "order_by_position": ("SELECT TOP 4 n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2", "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2 LIMIT 4"),
    "order_nulls_low": ("SELECT TOP 3 NULLIF(n_regionkey, 2) AS k, n_nationkey FROM nation ORDER BY k, n_nationkey", "SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation ORDER BY k NULLS FIRST, n_nationkey LIMIT 3"),
    "case_iif": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS s, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 END AS b, IIF(p_size % 2 = 0, 'even', 'odd') AS e FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' ELSE 'small' END AS s, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 END AS b, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS e FROM part"),
    "nullif_coalesce_isnull": ("SELECT p_partkey, NULLIF(p_size, 7) AS a, COALESCE(NULLIF(p_size, 7), -1) AS b, ISNULL(NULLIF(p_brand, 'Brand#11'), 'none') AS c FROM part", "SELECT p_partkey, nullif(p_size, 7) AS a, coalesce(nullif(p_size, 7), -1) AS b, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS c FROM part"),
    "like_prefix": ("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR p_type LIKE '%M_LL'", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' OR p_type LIKE '%M_LL'"),
    "like_set": ("SELECT c_custkey FROM customer WHERE c_mktsegment LIKE '[A-C]%' AND c_name LIKE '%[13579]'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^[A-C]') AND regexp_matches(c_name, '[13579]$')"),
    "like_negated_set": ("SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE '[^A-C]%'", "SELECT c_custkey FROM customer WHERE NOT regexp_matches(c_mktsegment, '^[^A-C]')"),
    "like_escape": ("SELECT page_id FROM pages WHERE url LIKE '%!_%' ESCAPE '!' OR url LIKE '%!%%' ESCAPE '!' OR url LIKE '%page=%'", "SELECT page_id FROM pages WHERE contains(url, '_') OR contains(url, '%') OR contains(url, 'page=')"),
    "str_len_datalength": ("SELECT c_custkey, LEN(c_name + '  ') AS l, DATALENGTH(CAST(c_name AS varchar(50))) AS d, DATALENGTH(c_name) AS n FROM customer", "SELECT c_custkey, length(c_name)::int AS l, length(c_name)::int AS d, (2 * length(c_name))::int AS n FROM customer"),
    "str_sub": ("SELECT c_custkey, LEFT(c_name, 4) AS a, RIGHT(c_name, 3) AS b, SUBSTRING(c_name, 0, 4) AS c, SUBSTRING(c_name, 3, 5) AS d FROM customer", "SELECT c_custkey, left(c_name, 4) AS a, right(c_name, 3) AS b, substr(c_name, 1, 3) AS c, substr(c_name, 3, 5) AS d FROM customer"),
    "str_search": ("SELECT page_id, CHARINDEX('example', url) AS a, CHARINDEX('/', url, 9) AS b, PATINDEX('%[0-9]%', url) AS c FROM pages", "SELECT page_id, instr(url, 'example')::int AS a, (CASE WHEN instr(substr(url, 9), '/') = 0 THEN 0 ELSE instr(substr(url, 9), '/') + 8 END)::int AS b, (CASE WHEN regexp_matches(url, '[0-9]') THEN length(regexp_extract(url, '^[^0-9]*')) + 1 ELSE 0 END)::int AS c FROM pages"),
    "str_stuff": ("SELECT c_custkey, STUFF(c_name, 2, 3, '--') AS a, STUFF(c_name, 1, 0, NULL) AS b, STUFF(c_name, 99, 1, 'x') AS c FROM customer", "SELECT c_custkey, left(c_name, 1) || '--' || substr(c_name, 5) AS a, c_name AS b, NULL::varchar AS c FROM customer"),
    "str_replace": ("SELECT c_custkey, REPLACE(c_name, 'Customer', 'C') AS a, UPPER(c_mktsegment) AS u, LOWER(c_mktsegment) AS l, REVERSE(c_name) AS r, REPLICATE('ab', c_nationkey % 3) AS p FROM customer", "SELECT c_custkey, replace(c_name, 'Customer', 'C') AS a, upper(c_mktsegment) AS u, lower(c_mktsegment) AS l, reverse(c_name) AS r, repeat('ab', c_nationkey % 3) AS p FROM customer"),
    "str_concat": ("SELECT c_custkey, CONCAT(c_name, '-', NULL, c_nationkey) AS a, c_name + NULLIF(c_mktsegment, 'BUILDING') AS b FROM customer", "SELECT c_custkey, c_name || '-' || c_nationkey AS a, c_name || nullif(c_mktsegment, 'BUILDING') AS b FROM customer"),
    "str_codes": ("SELECT c_custkey, ASCII(c_name) AS a, UNICODE(c_mktsegment) AS u, CHAR(65 + c_nationkey % 26) AS c, NCHAR(945) AS n FROM customer", "SELECT c_custkey, ascii(c_name)::int AS a, unicode(c_mktsegment)::int AS u, chr(65 + c_nationkey % 26) AS c, 'α' AS n FROM customer"),
    "str_trim_quotename": ("SELECT c_custkey, LTRIM('  ' + c_name) AS a, RTRIM(c_name + '  ') AS b, QUOTENAME(c_mktsegment) AS q FROM customer", "SELECT c_custkey, c_name AS a, c_name AS b, '[' || c_mktsegment || ']' AS q FROM customer"),
    "math_round": ("SELECT p_partkey, ROUND(CAST(p_size AS decimal(8,3)) / 8, 2) AS a, ROUND(p_size * 10 + 5, -1) AS b, ROUND(CAST(p_size AS decimal(8,4)) * 1.2345, 2, 1) AS c FROM part", "SELECT p_partkey, (round(p_size * 125 / 10.0)::int * 0.01)::decimal(11,6) AS a, ((p_size + 1) * 10)::int AS b, (((p_size * 12345) // 100)::int * 0.01)::decimal(14,8) AS c FROM part"),
    "math_power_sign": ("SELECT p_partkey, POWER(p_size, 2) AS p, SIGN(p_size - 25) AS s, ABS(p_size - 25) AS a, SQUAREROOT = ROUND(SQRT(p_size), 6) FROM part", "SELECT p_partkey, (p_size * p_size)::int AS p, sign(p_size - 25)::int AS s, abs(p_size - 25)::int AS a, round(sqrt(p_size), 6) AS SQUAREROOT FROM part"),
    "math_ceil_floor": ("SELECT p_partkey, CEILING(p_retailprice) AS a, FLOOR(p_retailprice) AS b, CEILING(CAST(p_size AS decimal(6,2)) + 0.25) AS c FROM part", "SELECT p_partkey, ceil(p_retailprice)::double AS a, floor(p_retailprice)::double AS b, (p_size + 1)::decimal(7,0) AS c FROM part"),
    "date_parts": ("SELECT o_orderkey, YEAR(o_orderdate) AS y, DATEPART(quarter, o_orderdate) AS q, DATEPART(dayofyear, o_orderdate) AS dy, DATEPART(weekday, o_orderdate) AS dw, DATEPART(iso_week, o_orderdate) AS iw FROM orders", "SELECT o_orderkey, year(o_orderdate)::int AS y, quarter(o_orderdate)::int AS q, dayofyear(o_orderdate)::int AS dy, (dayofweek(o_orderdate) + 1)::int AS dw, weekofyear(o_orderdate)::int AS iw FROM orders"),
    "date_add": ("SELECT o_orderkey, DATEADD(month, 1, o_orderdate) AS a, DATEADD(day, -3, o_orderdate) AS b, DATEADD(hour, 5, o_orderdate) AS c, DATEADD(year, 1, CAST(o_orderdate AS date)) AS d FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS a, o_orderdate - INTERVAL 3 DAY AS b, o_orderdate + INTERVAL 5 HOUR AS c, (o_orderdate::date + INTERVAL 1 YEAR)::date AS d FROM orders"),
    "date_diff_boundaries": ("SELECT o_orderkey, DATEDIFF(year, o_orderdate, '1999-01-01') AS y, DATEDIFF(month, o_orderdate, '1999-01-01') AS m, DATEDIFF(day, o_orderdate, '1999-01-01') AS d, DATEDIFF(hour, o_orderdate, '1999-01-01') AS h FROM orders", "SELECT o_orderkey, datediff('year', o_orderdate, TIMESTAMP '1999-01-01')::int AS y, datediff('month', o_orderdate, TIMESTAMP '1999-01-01')::int AS m, datediff('day', o_orderdate, TIMESTAMP '1999-01-01')::int AS d, datediff('hour', o_orderdate, TIMESTAMP '1999-01-01')::int AS h FROM orders"),
    "date_eomonth": ("SELECT o_orderkey, EOMONTH(o_orderdate) AS a, EOMONTH(o_orderdate, 2) AS b FROM orders", "SELECT o_orderkey, last_day(o_orderdate) AS a, last_day(o_orderdate::date + INTERVAL 2 MONTH) AS b FROM orders"),
    "date_fromparts": ("SELECT n_nationkey, DATEFROMPARTS(2000 + n_nationkey, n_regionkey + 1, 15) AS d FROM nation", "SELECT n_nationkey, make_date(2000 + n_nationkey, n_regionkey + 1, 15) AS d FROM nation"),
    "date_name": ("SELECT o_orderkey, DATENAME(month, o_orderdate) AS m, DATENAME(weekday, o_orderdate) AS w, DATENAME(year, o_orderdate) AS y FROM orders", "SELECT o_orderkey, monthname(o_orderdate) AS m, dayname(o_orderdate) AS w, year(o_orderdate)::varchar AS y FROM orders"),
    "cast_matrix": ("SELECT p_partkey, CAST(p_retailprice AS int) AS i, CAST(p_size AS varchar(10)) AS s, CAST(p_size AS decimal(8,2)) AS d, CAST(p_size AS bit) AS b, CAST(p_size AS float) AS f FROM part", "SELECT p_partkey, trunc(p_retailprice)::int AS i, p_size::varchar AS s, p_size::decimal(8,2) AS d, p_size <> 0 AS b, p_size::double AS f FROM part"),
    "try_cast": ("SELECT c_custkey, TRY_CAST(c_name AS int) AS a, TRY_CONVERT(int, RIGHT(c_name, 3)) AS b, TRY_CAST(c_mktsegment AS date) AS c FROM customer", "SELECT c_custkey, NULL::int AS a, right(c_name, 3)::int AS b, NULL::date AS c FROM customer"),
    "convert_styles": ("SELECT o_orderkey, CONVERT(varchar(10), o_orderdate, 101) AS a, CONVERT(varchar(10), o_orderdate, 103) AS b, CONVERT(varchar(8), o_orderdate, 112) AS c, CONVERT(varchar(19), o_orderdate, 120) AS d, CONVERT(varchar(11), o_orderdate, 106) AS e FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS a, strftime(o_orderdate, '%d/%m/%Y') AS b, strftime(o_orderdate, '%Y%m%d') AS c, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d, strftime(o_orderdate, '%d %b %Y') AS e FROM orders"),
    "bitwise_ops": ("SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS b, n_nationkey ^ 5 AS c, ~n_nationkey AS d FROM nation", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 9 AS b, xor(n_nationkey, 5) AS c, ~n_nationkey AS d FROM nation"),
    "window_functions": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS r FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS r FROM orders"),
    "cte": ("WITH big AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_name, b.n FROM customer c JOIN big b ON b.k = c.c_custkey WHERE b.n > 11", "WITH big AS (SELECT o_custkey AS k, count(*)::int AS n FROM orders GROUP BY o_custkey) SELECT c_name, n FROM customer JOIN big ON k = c_custkey WHERE n > 11"),
    "cross_apply": ("SELECT c.c_custkey, x.n FROM customer c CROSS APPLY (SELECT COUNT(*) AS n FROM orders o WHERE o.o_custkey = c.c_custkey) x", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::int AS n FROM customer"),
    "variables_batch": ("DECLARE @low int = 10, @name nvarchar(30); SET @low += 5; SELECT @name = MAX(n_name) FROM nation; SELECT n_nationkey, @low AS low, @name AS top_name FROM nation WHERE n_nationkey >= @low", "SELECT n_nationkey, 15 AS low, (SELECT max(n_name) FROM nation) AS top_name FROM nation WHERE n_nationkey >= 15"),
    "while_loop": ("DECLARE @i int = 1, @s int = 0; WHILE 1 = 1 BEGIN SET @s = @s + @i; SET @i = @i + 1; IF @i > 10 BREAK; END; SELECT @i AS i, @s AS s", "SELECT 11 AS i, 55 AS s"),
    "goto_label": ("DECLARE @i int = 0; again: SET @i = @i + 1; IF @i < 4 GOTO again; SELECT @i AS i", "SELECT 4 AS i"),
    "dynamic_sql": ("EXEC sp_executesql N'SELECT n_name FROM nation WHERE n_regionkey = @r', N'@r int', @r = 2", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "accumulate_variable": ("DECLARE @s int = 0; SELECT @s = @s + n_regionkey FROM nation ORDER BY n_nationkey; SELECT @s AS s", "SELECT sum(n_regionkey)::int AS s FROM nation"),
    "insert_select_result": ("CREATE TABLE t (id int IDENTITY(1,1) PRIMARY KEY, name nvarchar(40) NOT NULL, k int DEFAULT 7); INSERT INTO t (name) SELECT n_name FROM nation WHERE n_regionkey = 1; SELECT name, k, (SELECT MAX(id) FROM t) AS top_id FROM t", "SELECT n_name AS name, 7 AS k, (SELECT count(*)::int FROM nation WHERE n_regionkey = 1) AS top_id FROM nation WHERE n_regionkey = 1"),
    "select_into_result": ("SELECT n_name, n_regionkey INTO t FROM nation WHERE n_nationkey < 9; SELECT * FROM t", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 9"),
    "update_join_result": ("SELECT n_nationkey, n_name, n_regionkey INTO t FROM nation; UPDATE t SET n_name = r.r_name FROM t JOIN region r ON r.r_regionkey = t.n_regionkey WHERE r.r_regionkey > 2; SELECT * FROM t", "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "delete_result": ("SELECT n_nationkey INTO t FROM nation; DELETE FROM t WHERE n_nationkey % 3 = 0; SELECT * FROM t", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0"),
    "transaction_rollback": ("SELECT r_regionkey INTO t FROM region; BEGIN TRAN; DELETE FROM t; ROLLBACK; SELECT COUNT(*) AS n FROM t", "SELECT count(*)::int AS n FROM region"),
    "info_schema_columns": ("SELECT TABLE_NAME, COLUMN_NAME, DATA_TYPE, ORDINAL_POSITION FROM INFORMATION_SCHEMA.COLUMNS WHERE TABLE_NAME IN ('region', 'nation')", "SELECT * FROM (VALUES ('region', 'r_regionkey', 'int', 1), ('region', 'r_name', 'nvarchar', 2), ('nation', 'n_nationkey', 'int', 1), ('nation', 'n_name', 'nvarchar', 2), ('nation', 'n_regionkey', 'int', 3)) AS v(TABLE_NAME, COLUMN_NAME, DATA_TYPE, ORDINAL_POSITION)"),
    "sys_tables": ("SELECT t.name, COUNT(*) AS n FROM sys.tables t JOIN sys.columns c ON c.object_id = t.object_id WHERE t.name IN ('region', 'nation') GROUP BY t.name", "SELECT * FROM (VALUES ('region', 2), ('nation', 3)) AS v(name, n)"),
    "is_null_tests": ("SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NULL OR NULLIF(o_custkey % 5, 3) IS NOT NULL AND o_custkey < 40", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey % 5 <> 3 AND o_custkey < 40"),
    "like_column": ("SELECT a.p_partkey FROM part a JOIN (VALUES ('%[0-3]', 1), ('Brand#1_', 2), ('%!#4%', 3), ('[^B]%', 4)) t(pat, k) ON a.p_brand LIKE t.pat ESCAPE '!' WHERE a.p_partkey % 4 = t.k % 4", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 1 AND regexp_matches(p_brand, '[0-3]$') OR p_partkey % 4 = 2 AND regexp_matches(p_brand, '^Brand#1.$') OR p_partkey % 4 = 3 AND contains(p_brand, '#4')"),
    "patindex_column": ("SELECT p_partkey, PATINDEX('%' + CAST(p_size % 10 AS varchar(2)) + '%', p_brand) AS a, PATINDEX(p_type, 'ECONOMY') AS b FROM part", "SELECT p_partkey, instr(p_brand, (p_size % 10)::varchar)::int AS a, (p_type = 'ECONOMY')::int AS b FROM part"),
    "round_column": ("SELECT p_partkey, ROUND(CAST(p_size AS decimal(8,3)) * 1.125, p_partkey % 3) AS a, ROUND(p_size * 10 + 5, -(p_partkey % 2)) AS b FROM part", "SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN round(p_size * 1125 / 1000.0, 0) WHEN 1 THEN round(p_size * 1125 / 1000.0, 1) ELSE round(p_size * 1125 / 1000.0, 2) END)::decimal(13,6) AS a, (CASE WHEN p_partkey % 2 = 1 THEN (p_size + 1) * 10 ELSE p_size * 10 + 5 END)::int AS b FROM part"),
    "quantified_strings": ("SELECT n_nationkey FROM nation WHERE LOWER(n_name) < ALL (SELECT 'NATION_' + CAST(r_regionkey + 5 AS varchar(2)) FROM region) AND n_name = ANY (SELECT LOWER(n_name) FROM nation)", "SELECT n_nationkey FROM nation WHERE n_name < 'NATION_5'"),
    "fk_collated": ("CREATE TABLE p (k varchar(20) PRIMARY KEY); CREATE TABLE c (k varchar(20) REFERENCES p (k), n int); INSERT INTO p SELECT n_name FROM nation; INSERT INTO c SELECT LOWER(n_name), n_nationkey FROM nation; INSERT INTO c VALUES ('nobody', 1); SELECT @@ERROR AS e, COUNT(*) AS n FROM c", "SELECT 547 AS e, 25 AS n"),
    "rowcount_top": ("SELECT r_name FROM region; SELECT TOP (@@ROWCOUNT) n_nationkey FROM nation ORDER BY n_nationkey", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5"),
    "truncate_result": ("SELECT n_name INTO t FROM nation; TRUNCATE TABLE t; SELECT COUNT(*) AS n FROM t", "SELECT 0 AS n"),
    "top_no_order": ("SELECT COUNT(*) AS n FROM (SELECT TOP (4) n_name FROM nation) x", "SELECT 4 AS n"),
    "order_by_collate": ("SELECT TOP 3 n_nationkey FROM nation ORDER BY n_name COLLATE Latin1_General_BIN2 DESC", "SELECT n_nationkey FROM nation ORDER BY n_name DESC LIMIT 3"),
    "ties_two_keys": ("SELECT TOP 40 WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC, p_type", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC, p_type) AS r FROM part) WHERE r <= 40"),
    "lock_hints": ("SELECT n.n_name, r.r_name FROM nation n WITH (NOLOCK) JOIN region r WITH (UPDLOCK, ROWLOCK) ON r.r_regionkey = n.n_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "pi_rand_day": ("SELECT o_orderkey, ROUND(PI(), 6) AS p, DAY(o_orderdate) AS d, CASE WHEN RAND(5) BETWEEN 0 AND 1 THEN 1 ELSE 0 END AS r FROM orders", "SELECT o_orderkey, 3.141593::double AS p, day(o_orderdate)::int AS d, 1 AS r FROM orders"),
    "clocks": ("SELECT CASE WHEN DATEDIFF(minute, GETDATE(), SYSDATETIME()) = 0 AND GETDATE() = CURRENT_TIMESTAMP AND ABS(DATEDIFF(second, GETUTCDATE(), SYSUTCDATETIME())) <= 1 THEN 1 ELSE 0 END AS same", "SELECT 1 AS same"),
    "money_to_int": ("SELECT p_partkey, CAST(CAST(p_size AS money) / 2 AS int) AS m FROM part", "SELECT p_partkey, ((p_size + 1) // 2)::int AS m FROM part"),
    "string_to_dates": ("SELECT o_orderkey, CONVERT(date, CONVERT(varchar(10), o_orderdate, 103), 103) AS a, CONVERT(datetime, CONVERT(varchar(10), o_orderdate, 101), 101) AS b, CAST(CONVERT(varchar(8), o_orderdate, 112) AS date) AS c FROM orders", "SELECT o_orderkey, o_orderdate::date AS a, o_orderdate::date::timestamp AS b, o_orderdate::date AS c FROM orders"),
    "float_to_text": ("SELECT p_partkey, CAST(CAST(p_size AS float) * 1000000 AS varchar(20)) AS a FROM part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size::varchar || 'e+006' WHEN p_size % 10 = 0 THEN (p_size // 10)::varchar || 'e+007' ELSE (p_size // 10)::varchar || '.' || (p_size % 10)::varchar || 'e+007' END AS a FROM part"),
    "datediff_parts": ("SELECT o_orderkey, DATEDIFF(hour, o_orderdate, '1999-01-01T00:30:00') AS h, DATEDIFF(quarter, o_orderdate, '1999-01-01') AS q FROM orders", "SELECT o_orderkey, datediff('hour', o_orderdate, timestamp '1999-01-01 00:30:00')::int AS h, datediff('quarter', o_orderdate, timestamp '1999-01-01')::int AS q FROM orders"),
    "nested_division": ("SELECT p_partkey, CAST(p_size AS decimal(9,0)) / 3 / 7 / 2 AS q FROM part", "SELECT p_partkey, (((((p_size::hugeint * 1000000) // 3 * 100) // 7 * 100) // 2)::decimal(19,0) * 0.0000000001::decimal(10,10))::decimal(19,10) AS q FROM part"),
    "identity_functions": ("CREATE TABLE t (id int IDENTITY(5, 5), n varchar(20)); INSERT INTO t (n) SELECT n_name FROM nation; SELECT CAST(SCOPE_IDENTITY() AS int) AS s, CAST(IDENT_CURRENT('t') AS int) AS c, CAST(@@IDENTITY AS int) AS i, OBJECT_NAME(OBJECT_ID('t')) AS o", "SELECT 125 AS s, 125 AS c, 125 AS i, 't' AS o"),
    "guid_numeric_tests": ("SELECT n_nationkey, ISNUMERIC(n_name) AS a, ISNUMERIC(CAST(n_nationkey AS varchar(5))) AS b, ISDATE('2020-02-30') AS c, LEN(CAST(NEWID() AS varchar(36))) AS d FROM nation", "SELECT n_nationkey, 0 AS a, 1 AS b, 0 AS c, 36 AS d FROM nation"),
    "server_functions": ("SELECT DB_NAME() AS d, SCHEMA_NAME() AS s, HAS_PERMS_BY_NAME('x', 'OBJECT', 'SELECT') AS h, CAST(COLLATIONPROPERTY('Latin1_General_CI_AS', 'CodePage') AS int) AS c, XACT_STATE() AS x, SUSER_SNAME() AS u", "SELECT 'master' AS d, 'dbo' AS s, 1 AS h, 1252 AS c, 0::smallint AS x, 'sa' AS u"),
    "set_options": ("SET NOCOUNT ON; SET DATEFIRST 1; SELECT o_orderkey, DATEPART(weekday, o_orderdate) AS w, @@DATEFIRST AS f FROM orders", "SELECT o_orderkey, isodow(o_orderdate)::int AS w, 1::tinyint AS f FROM orders"),
    "prepared_statement": ("DECLARE @h int; EXEC sp_prepare @h OUTPUT, N'@a int', N'SELECT n_name FROM nation WHERE n_regionkey = @a'; EXEC sp_execute @h, 2", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "describe_result": ("SELECT n_nationkey INTO x FROM nation; EXEC sp_describe_first_result_set N'SELECT n_nationkey, COUNT(*) AS n FROM x GROUP BY n_nationkey'", "SELECT * FROM (VALUES (1, 'n_nationkey', 'int'), (2, 'n', 'int')) AS v(column_ordinal, name, system_type_name)"),
    "use_database": ("SELECT n_nationkey INTO t FROM nation; CREATE DATABASE other; USE other; SELECT COUNT(*) AS n, DB_NAME() AS d FROM master.dbo.t", "SELECT 25 AS n, 'other' AS d"),
    "drop_table_result": ("SELECT r_name INTO a FROM region; SELECT r_name INTO b FROM region; DROP TABLE a; DROP TABLE IF EXISTS a; SELECT name FROM sys.tables WHERE name IN ('a', 'b')", "SELECT 'b' AS name"),
    "index_views": ("SELECT n_nationkey AS k, n_name INTO t FROM nation; CREATE UNIQUE INDEX u ON t (k); CREATE INDEX i ON t (n_name); DROP INDEX i ON t; SELECT i.name, i.is_unique, c.key_ordinal FROM sys.indexes i JOIN sys.index_columns c ON c.object_id = i.object_id AND c.index_id = i.index_id", "SELECT 'u' AS name, 1 AS is_unique, 1 AS key_ordinal"),
    "alter_table_result": ("SELECT n_nationkey AS k, n_name INTO t FROM nation; ALTER TABLE t ADD flag int NOT NULL DEFAULT 4; ALTER TABLE t DROP COLUMN n_name; SELECT * FROM t", "SELECT n_nationkey AS k, 4 AS flag FROM nation"),
    "constraints_reach": ("CREATE TABLE t (k int PRIMARY KEY, v int CHECK (v < 20)); INSERT INTO t SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 20; INSERT INTO t VALUES (1, 1); INSERT INTO t VALUES (90, 90); UPDATE t SET v = v - 1 WHERE k > 17; DELETE FROM t WHERE k < 10; SELECT k, v FROM t", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 17 THEN n_nationkey - 1 ELSE n_nationkey END AS v FROM nation WHERE n_nationkey BETWEEN 10 AND 19"),
    "key_procedures": ("CREATE TABLE p (k int PRIMARY KEY); CREATE TABLE c (a int CONSTRAINT f REFERENCES p (k)); EXEC sp_fkeys @pktable_name = 'p'", "SELECT 'master' AS PKTABLE_QUALIFIER, 'dbo' AS PKTABLE_OWNER, 'p' AS PKTABLE_NAME, 'k' AS PKCOLUMN_NAME, 'master' AS FKTABLE_QUALIFIER, 'dbo' AS FKTABLE_OWNER, 'c' AS FKTABLE_NAME, 'a' AS FKCOLUMN_NAME, 1::smallint AS KEY_SEQ, 1::smallint AS UPDATE_RULE, 1::smallint AS DELETE_RULE, 'f' AS FK_NAME, 'PK__p__1' AS PK_NAME, 7::smallint AS DEFERRABILITY"),
    "statistics_procedure": ("SELECT n_nationkey AS k, n_name INTO t FROM nation; CREATE UNIQUE INDEX u ON t (k, n_name); EXEC sp_statistics 't', @index_name = 'u'", "SELECT 'master' AS TABLE_QUALIFIER, 'dbo' AS TABLE_OWNER, 't' AS TABLE_NAME, v.a::smallint AS NON_UNIQUE, v.b AS INDEX_QUALIFIER, v.c AS INDEX_NAME, v.d::smallint AS TYPE, v.e::smallint AS SEQ_IN_INDEX, v.f AS COLUMN_NAME, v.g AS COLLATION, NULL::int AS CARDINALITY, NULL::int AS PAGES, NULL::varchar AS FILTER_CONDITION FROM (VALUES (NULL, NULL, NULL, 0, NULL, NULL, NULL), (0, 't', 'u', 3, 1, 'k', 'A'), (0, 't', 'u', 3, 2, 'n_name', 'A')) AS v(a, b, c, d, e, f, g)"),
    "constraint_views": ("CREATE TABLE p (k int CONSTRAINT pk PRIMARY KEY); CREATE TABLE c (a int CONSTRAINT fk REFERENCES p (k), b int CONSTRAINT ck CHECK (b > 0)); SELECT CONSTRAINT_NAME, CONSTRAINT_TYPE FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS", "SELECT * FROM (VALUES ('pk', 'PRIMARY KEY'), ('fk', 'FOREIGN KEY'), ('ck', 'CHECK')) AS v(CONSTRAINT_NAME, CONSTRAINT_TYPE)"),
    "referential_views": ("CREATE TABLE p (k int CONSTRAINT pk PRIMARY KEY); CREATE TABLE c (a int CONSTRAINT fk REFERENCES p (k)); SELECT r.CONSTRAINT_NAME, r.UNIQUE_CONSTRAINT_NAME, u.COLUMN_NAME FROM INFORMATION_SCHEMA.REFERENTIAL_CONSTRAINTS r JOIN INFORMATION_SCHEMA.KEY_COLUMN_USAGE u ON u.CONSTRAINT_NAME = r.CONSTRAINT_NAME", "SELECT 'fk' AS CONSTRAINT_NAME, 'pk' AS UNIQUE_CONSTRAINT_NAME, 'a' AS COLUMN_NAME"),
    "key_views": ("CREATE TABLE p (k int CONSTRAINT pk PRIMARY KEY); CREATE TABLE c (a int CONSTRAINT fk REFERENCES p (k)); SELECT k.name AS pk, f.name AS fk, f.delete_referential_action_desc AS d, n.constraint_column_id AS i FROM sys.key_constraints k, sys.foreign_keys f JOIN sys.foreign_key_columns n ON n.constraint_object_id = f.object_id", "SELECT 'pk' AS pk, 'fk' AS fk, 'NO_ACTION' AS d, 1 AS i"),
    "schema_views": ("CREATE SCHEMA sales; SELECT name FROM sys.schemas WHERE name NOT LIKE 'db[_]%' UNION ALL SELECT TABLE_NAME FROM INFORMATION_SCHEMA.TABLES WHERE TABLE_NAME = 'nothing'", "SELECT * FROM (VALUES ('dbo'), ('INFORMATION_SCHEMA'), ('sys'), ('sales')) AS v(name)"),
    "type_views": ("SELECT name, system_type_id, is_assembly_type FROM sys.types WHERE name IN ('int', 'bit', 'datetime2')", "SELECT * FROM (VALUES ('int', 56, 0), ('bit', 104, 0), ('datetime2', 42, 0)) AS v(name, system_type_id, is_assembly_type)"),
    "principal_views": ("SELECT p.name FROM sys.database_role_members m JOIN sys.database_principals p ON p.principal_id = m.member_principal_id", "SELECT 'dbo' AS name"),
    "select_assign": ("DECLARE @n int, @s varchar(20); SELECT @n = COUNT(*), @s = MAX(n_name) FROM nation; SELECT @n AS n, @s AS s", "SELECT 25 AS n, max(n_name) AS s FROM nation"),
}

#: Queries under a case-insensitive collation.
INSENSITIVE: dict[str, tuple[str, str]] = {
    "collate_ci_group": ("SELECT COUNT(*) AS n, MIN(LOWER(RTRIM(g.k))) AS k FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN LOWER(o_orderpriority) ELSE o_orderpriority + ' ' END AS k FROM orders) g GROUP BY g.k COLLATE Latin1_General_CI_AS", "SELECT count(*)::int AS n, lower(o_orderpriority) AS k FROM orders GROUP BY lower(o_orderpriority)"),
    "collate_ci_compare": ("SELECT n_nationkey FROM nation WHERE n_name = LOWER(n_name) + '  ' AND n_name LIKE 'nation[_][0-4]%'", "SELECT n_nationkey FROM nation WHERE regexp_matches(n_name, '^NATION_[0-4]')"),
    "collate_cs": ("SELECT n_nationkey FROM nation WHERE n_name COLLATE Latin1_General_CS_AS <> LOWER(n_name) AND n_name = LOWER(n_name)", "SELECT n_nationkey FROM nation WHERE n_name <> lower(n_name)"),
}


#: Batches in which statements fail on purpose and the batch goes on.
FAILING = [PAIRS[n][0] for n in ("fk_collated", "constraints_reach")]


def tables_of(text: str) -> list[str]:
    words = set(re.findall(r"\w+", text.lower()))
    return [t for t in TABLES if t in words]


def runner(text: str, collation: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .session import TsqlSession

        session = TsqlSession(spark, collation).load(sf_dir, tables_of(text))
        if text in FAILING:
            return [r.df for r in session.execute(text) if r.kind == "rows"][-1]
        return session.sql(text)

    return run


#: Queries that compare bytes, so that their filters reach the scan; all others run under the dialect's default collation.
BINARY_QUERIES = "pricing_summary filter_3vl in_list between like_prefix like_set str_search join_chain semi_exists anti_not_exists distinct_rows having_groups top_with_ties update_join_result".split()
BINARY, DEFAULT = "Latin1_General_100_BIN2", "SQL_Latin1_General_CP1_CI_AS"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(text, BINARY if name in BINARY_QUERIES else DEFAULT) for name, (text, _) in (PAIRS | INSENSITIVE).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (PAIRS | INSENSITIVE).items() if sql}
