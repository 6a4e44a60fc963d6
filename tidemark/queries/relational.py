"""Relational operators over the star-schema tables, in SQL that Catalyst plans, and the DuckDB SQL where it differs."""

from __future__ import annotations

from tidemark.queries.tables import EV, sql

#: Name: Spark SQL, or (Spark SQL, DuckDB SQL). ev is the events with ts_ms in both.
_BOTH: dict[str, str | tuple[str, str]] = {
    # Aggregation
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS d0, max(l_tax) AS t1 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, count(l_partkey) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_orderpriority",
    "agg_stats": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM lineitem GROUP BY l_returnflag",
    "agg_regr": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(regr_intercept(l_extendedprice, l_quantity), 2) AS i, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag",
    "agg_bits": ("SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, bit_xor(o_custkey) AS x, bool_and(o_totalprice > 0) AS ba, bool_or(o_totalprice > 400000) AS bo FROM orders GROUP BY o_orderstatus"),
    "agg_collect": (
        "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names, element_at(array_sort(array_agg(n_nationkey)), 1) AS first_key FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list_sort(array_agg(n_nationkey))[1] AS first_key FROM nation GROUP BY n_regionkey",
    ),
    "agg_string_agg": (
        "SELECT n_regionkey, string_agg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_first_last": (
        "SELECT user_id, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value FROM ev GROUP BY user_id",
        f"SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value FROM {EV} GROUP BY user_id",
    ),
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    # Joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_right": "SELECT d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id",
    "join_full": "SELECT p_partkey, s_suppkey FROM (SELECT * FROM part WHERE p_partkey > 40) p FULL JOIN (SELECT * FROM supplier WHERE s_suppkey <= 80) s ON p_partkey = s_suppkey",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 350000) o ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000"),
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_using": "SELECT doc_id, quality, source FROM documents JOIN labels USING (doc_id)",
    "join_natural": "SELECT doc_id, toxic, lang FROM documents NATURAL JOIN labels",
    "join_multiway": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY r_name, n_name",
    "join_lateral": "SELECT n_name, s.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) s",
    # Windows
    "win_rank_family": "SELECT p_partkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)",
    "win_lag_lead": f"SELECT event_id, lag(value, 1, -1.0) OVER w AS a, lead(value, 2) OVER w AS b FROM {{ev}} WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)",
    "win_rows_frame": f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m FROM {{ev}}",
    "win_range_frame": f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS n FROM {{ev}}",
    "win_first_last_nth": f"SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n2 FROM {{ev}} WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_ignore_nulls": (
        "SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS carried FROM (SELECT *, CASE WHEN event_type = 'view' THEN value END AS v FROM ev)",
        f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS carried FROM (SELECT *, CASE WHEN event_type = 'view' THEN value END AS v FROM {EV})",
    ),
    "win_ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS BIGINT) AS t FROM customer",
    "win_running_sum": f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id), 4) AS s FROM {{ev}}",
    # Sets, sorting
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 25",
    "sort_nulls": "SELECT k FROM (SELECT nullif(c_custkey % 7, 3) AS k, c_custkey FROM customer) x ORDER BY k DESC NULLS LAST, c_custkey LIMIT 50",
    "distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    # Expressions
    "str_funcs": (
        "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS lo, initcap(lower(c_mktsegment)) AS ic, length(c_name) AS n, octet_length(c_name) AS ol, substr(c_name, 3, 4) AS s, left(c_name, 2) AS l, right(c_name, 3) AS r, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp, replace(c_name, '0', 'o') AS rep, reverse(c_name) AS rev, repeat('ab', 2) AS re2, split_part(c_name, '#', 2) AS sp, strpos(c_name, '#') AS pos, starts_with(c_name, 'C') AS sw, ends_with(c_name, '1') AS ew, ascii(c_name) AS asc0, chr(65) AS ch, concat(c_name, '-', c_mktsegment) AS cc, levenshtein(c_mktsegment, 'BUILDING') AS lev, regexp_like(c_name, '[1-4]$') AS rl, regexp_replace(c_name, '0+', '_') AS rr, trim('  x ') AS t, ltrim('  x ') AS lt, rtrim('  x ') AS rt, c_name LIKE '%9' AS lk, c_name ILIKE 'c%' AS il FROM customer",
        "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS lo, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS ic, CAST(length(c_name) AS INT) AS n, CAST(strlen(c_name) AS INT) AS ol, substr(c_name, 3, 4) AS s, left(c_name, 2) AS l, right(c_name, 3) AS r, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp, replace(c_name, '0', 'o') AS rep, reverse(c_name) AS rev, repeat('ab', 2) AS re2, split_part(c_name, '#', 2) AS sp, strpos(c_name, '#') AS pos, starts_with(c_name, 'C') AS sw, ends_with(c_name, '1') AS ew, ascii(c_name) AS asc0, chr(65) AS ch, concat(c_name, '-', c_mktsegment) AS cc, CAST(levenshtein(c_mktsegment, 'BUILDING') AS INT) AS lev, regexp_matches(c_name, '[1-4]$') AS rl, regexp_replace(c_name, '0+', '_', 'g') AS rr, trim('  x ') AS t, ltrim('  x ') AS lt, rtrim('  x ') AS rt, c_name LIKE '%9' AS lk, c_name ILIKE 'c%' AS il FROM customer",
    ),
    "date_funcs": (
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(date_part('doy', o_orderdate) AS BIGINT) AS d, date_format(o_orderdate, 'yyyy-MM') AS f, CAST(datediff(o_orderdate, DATE '1995-01-01') AS BIGINT) AS days, CAST(o_orderdate AS DATE) AS dt FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, extract(YEAR FROM o_orderdate) AS y, date_part('doy', o_orderdate) AS d, strftime(o_orderdate, '%Y-%m') AS f, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(o_orderdate AS DATE) AS dt FROM orders",
    ),
    "date_bin": (
        "SELECT event_id, unix_millis(date_bin(INTERVAL '15' MINUTE, timestamp_millis(ts_ms), TIMESTAMP '2024-01-01 00:05:00')) AS b FROM ev",
        f"SELECT event_id, ts_ms - (((ts_ms - 1704067500000) % 900000) + 900000) % 900000 AS b FROM {EV}",
    ),
    "math_funcs": (
        "SELECT p_partkey, abs(p_retailprice - 1000) AS a, round(p_retailprice, 1) AS r, CAST(floor(p_retailprice) AS DOUBLE) AS f, CAST(ceil(p_retailprice) AS DOUBLE) AS c, round(power(p_size, 2), 6) AS p, round(sqrt(p_size), 9) AS s, round(cbrt(p_size), 9) AS cb, round(ln(p_size), 9) AS l, round(log2(p_size), 9) AS l2, round(log10(p_size), 9) AS l10, round(exp(p_size / 10.0D), 6) AS e, round(sin(p_size), 9) AS si, round(atan2(p_size, 2), 9) AS at, sign(p_size - 25.0D) AS sg, round(degrees(p_size), 6) AS dg, CAST(gcd_i64(p_partkey, p_size) AS BIGINT) AS g, trunc_number(p_retailprice, 1) AS tr, CAST(factorial(p_size % 10) AS BIGINT) AS fa, p_partkey % 7 AS md, p_size div 7 AS dv FROM part",
        "SELECT p_partkey, abs(p_retailprice - 1000) AS a, round(p_retailprice, 1) AS r, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(power(p_size, 2), 6) AS p, round(sqrt(p_size), 9) AS s, round(cbrt(p_size), 9) AS cb, round(ln(p_size), 9) AS l, round(log2(p_size), 9) AS l2, round(log10(p_size), 9) AS l10, round(exp(CAST(p_size AS DOUBLE) / 10), 6) AS e, round(sin(p_size), 9) AS si, round(atan2(p_size, 2), 9) AS at, CAST(sign(p_size - 25) AS DOUBLE) AS sg, round(degrees(p_size), 6) AS dg, gcd(p_partkey, p_size) AS g, floor(p_retailprice * 10) / 10 AS tr, CAST(factorial(p_size % 10) AS BIGINT) AS fa, p_partkey % 7 AS md, CAST(p_size // 7 AS BIGINT) AS dv FROM part",
    ),
    "case_coalesce": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, greatest(c_acctbal, 100.0) AS g, least(c_acctbal, 100.0) AS l, c_acctbal BETWEEN 0 AND 100 AS b, c_nationkey IN (1, 2, 3) AS i, c_mktsegment IS DISTINCT FROM 'MACHINERY' AS df, NOT (c_acctbal > 0 OR c_custkey = 1) AS nt, CAST(c_custkey AS VARCHAR(20)) AS cs FROM customer",
    "subq_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)",
    "subq_correlated": "SELECT s_suppkey FROM supplier s WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)",
    "subq_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "subq_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON o_custkey = c_custkey WHERE total > 2000000",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "unnest": ("SELECT n_nationkey, w FROM nation LATERAL VIEW explode(split(n_name, '_')) x AS w", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w FROM nation"),
    "array_funcs": (
        "SELECT n_nationkey, size(a) AS n, array_contains(a, 3) AS has3, array_join(array_distinct(a), ',') AS d, array_join(array_sort(a), ',') AS s, element_at(a, 2) AS e, array_position(a, 3) AS p, array_join(slice(a, 1, 2), ',') AS sl, array_join(array_sort(array_union(a, array(3, 9))), ',') AS u, array_join(flatten(array(a, a)), ',') AS f FROM (SELECT n_nationkey, array(n_nationkey, 3, n_regionkey, 3) AS a FROM nation)",
        "SELECT n_nationkey, CAST(len(a) AS INT) AS n, list_contains(a, 3) AS has3, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS d, array_to_string(list_sort(a), ',') AS s, a[2] AS e, CAST(list_position(a, 3) AS BIGINT) AS p, array_to_string(a[1:2], ',') AS sl, array_to_string(list_sort(list_distinct(list_concat(a, [3, 9]))), ',') AS u, array_to_string(flatten([a, a]), ',') AS f FROM (SELECT n_nationkey, [n_nationkey, 3, n_regionkey, 3] AS a FROM nation)",
    ),
    "map_struct": ("SELECT r_regionkey, element_at(m, 'name') AS v, s.k AS k FROM (SELECT r_regionkey, map('name', r_name) AS m, named_struct('k', r_regionkey + 1) AS s FROM region)", "SELECT r_regionkey, r_name AS v, r_regionkey + 1 AS k FROM region"),
    "hash_funcs": ("SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, base64(CAST(n_name AS BINARY)) AS b, hex(n_name) AS h FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, base64(encode(n_name)) AS b, hex(n_name) AS h FROM nation"),
    "json_extract": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM ev", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "approx_distinct": ("SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near FROM ev GROUP BY event_type", "SELECT event_type, true AS near FROM events GROUP BY event_type"),
    "approx_percentile": ("SELECT event_type, abs(percentile_approx(value, 0.5, 10000) - median(value)) <= 2 AS near FROM ev GROUP BY event_type", "SELECT event_type, true AS near FROM events GROUP BY event_type"),
}

QUERIES = {name: sql((both if isinstance(both, str) else both[0]).replace("{ev}", "ev")) for name, both in _BOTH.items()}
SQL = {name: (both.replace("{ev}", EV) if isinstance(both, str) else both[1]) for name, both in _BOTH.items()}
