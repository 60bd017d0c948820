"""Queries in PostgreSQL-flavoured SQL over the driver's tables, run by the
engine on Spark; DuckDB runs the same text, or the text given beside it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pelorus.database import Database
from pelorus.sources.tables import TABLES, scan

#: name -> (statement, the same for DuckDB where it must differ)
QUERIES: dict[str, tuple[str, str | None]] = {}


def add(name: str, sql: str, duck: str | None = None) -> None:
    QUERIES[name] = (sql, duck)


def database(spark: SparkSession, sf_dir: str, text: str) -> Database:
    """A database with the tables that a statement names."""
    db = Database(spark)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            db.attach(t, scan(spark, sf_dir, t), {"props": "jsonb"} if t == "events" else None)
    return db


def runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: database(spark, sf_dir, sql).sql(sql)


# scans, projections, predicates

add("scan_project", "SELECT o_orderkey, o_totalprice AS price, o_orderstatus FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('O', 'F')")
add("point_lookup", "SELECT * FROM customer WHERE c_custkey = 7")
add("values_scan", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
add("constant_row", "SELECT 1 AS one, 'two' AS two, NULL::int AS none")
add("arithmetic", "SELECT l_orderkey, l_linenumber, round((l_extendedprice * (1 - l_discount) * (1 + l_tax))::numeric(18,6), 4)::double precision AS charge, (l_linenumber / 2)::bigint AS half, l_linenumber % 3 AS rest FROM lineitem", "SELECT l_orderkey, l_linenumber, round((l_extendedprice * (1 - l_discount) * (1 + l_tax))::numeric(18,6), 4)::double AS charge, (l_linenumber // 2)::bigint AS half, l_linenumber % 3 AS rest FROM lineitem")
add("predicates", "SELECT c_custkey FROM customer WHERE (c_acctbal BETWEEN 0 AND 5000 OR c_acctbal IS NULL) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND NOT c_nationkey = 3")
add("like_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1%' AND p_type ILIKE '%s%' AND p_brand NOT LIKE '%9'")
add("regex_match", "SELECT s_suppkey FROM supplier WHERE s_name ~ '[13]$' OR s_name ~* 'SUPPLIER.*2' AND s_name !~ '9'", "SELECT s_suppkey FROM supplier WHERE regexp_matches(s_name, '[13]$') OR regexp_matches(s_name, '(?i)SUPPLIER.*2') AND NOT regexp_matches(s_name, '9')")
add("case_coalesce", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS bucket, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS is_open, coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') AS prio FROM orders")
add("concat_cast", "SELECT n_nationkey || ':' || n_name AS tag, n_nationkey::text AS k, '12.5'::numeric(6,2)::double precision AS x, true::int AS t FROM nation", "SELECT n_nationkey || ':' || n_name AS tag, n_nationkey::text AS k, 12.5::double AS x, true::int AS t FROM nation")
add("any_all", "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY(ARRAY[1, 3]) AND n_nationkey > ALL(ARRAY[5, 6])", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey > 6")
add("all_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL(SELECT s_acctbal FROM supplier WHERE s_nationkey < 5)", "SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey < 5)")
add("timezones", "SELECT event_id, (ts AT TIME ZONE 'Europe/Berlin')::timestamp AS local FROM events", "SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin')::timestamp AS local FROM events")
add("intervals", "SELECT o_orderkey, o_orderdate + INTERVAL '1 month' AS later, o_orderdate - INTERVAL '2 days 3 hours' AS before FROM orders")
add("string_builtins", "SELECT s_suppkey, length(s_name)::int AS n, upper(s_name) AS u, lower(s_name) AS l, substr(s_name, 3, 4) AS s, replace(s_name, 'S', 'z') AS r, trim('  x ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, position('#' in s_name)::int AS p FROM supplier")
add("comments_and_params", "SELECT n_name /* a comment */ FROM nation -- to the end\n WHERE n_nationkey < 3")

# joins

add("join_inner", "SELECT c.c_name, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 9000")
add("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey")
add("join_right", "SELECT n.n_name, s.s_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
add("join_full", "SELECT a.s_suppkey AS a, b.n_nationkey AS b FROM supplier a FULL OUTER JOIN nation b ON a.s_suppkey = b.n_nationkey")
add("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE n.n_nationkey < 3")
add("join_using", "SELECT l_orderkey, o_custkey FROM (SELECT o_orderkey AS l_orderkey, o_custkey FROM orders) o JOIN lineitem USING (l_orderkey) WHERE l_quantity > 49")
add("join_natural", "SELECT count(*) AS n FROM (SELECT n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k FROM region) b")
add("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("join_theta", "SELECT p.p_partkey, count(*) AS n FROM part p JOIN supplier s ON s.s_acctbal > p.p_retailprice * 5 GROUP BY p.p_partkey")
add("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
add("semi_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 48)")
add("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
add("anti_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
add("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
add("correlated_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
add("lateral_join", "SELECT n.n_nationkey, t.c_custkey FROM nation n, LATERAL (SELECT c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_custkey LIMIT 2) t")

# aggregates, windows, sorting, set operations, common tables

add("aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity) AS qty, round(avg(l_discount)::numeric(18,9), 6)::double precision AS disc, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity) AS qty, round(avg(l_discount)::numeric(18,9), 6)::double AS disc, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus")
add("decimal_sums", "SELECT o_orderpriority, sum(o_totalprice::numeric(18,2))::double precision AS total FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
add("group_by_expression", "SELECT extract(year from o_orderdate)::int AS y, count(*) AS n FROM orders GROUP BY y")
add("filtered_aggregate", "SELECT o_custkey % 5 AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_custkey % 5")
add("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
add("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("empty_aggregate", "SELECT count(*) AS n, sum(o_totalprice) AS s, coalesce(max(o_orderkey), 0) AS m FROM orders WHERE o_orderkey < 0")
add("string_agg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
add("array_agg", "SELECT n_regionkey, array_to_string(array_agg(n_nationkey ORDER BY n_nationkey DESC), '-') AS keys FROM nation GROUP BY n_regionkey")
add("array_agg_distinct", "SELECT c_nationkey, array_to_string(array_agg(DISTINCT c_mktsegment), '|') AS segs FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, array_to_string(list_sort(array_agg(DISTINCT c_mktsegment)), '|') AS segs FROM customer GROUP BY c_nationkey")
add("window_running", "SELECT o_orderkey, sum(o_shippriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS o_shippriority FROM orders) o", "SELECT o_orderkey, (sum(o_shippriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::bigint AS run FROM (SELECT o_orderkey, o_custkey, o_orderkey % 7 AS o_shippriority FROM orders) o")
add("window_ranks", "SELECT c_custkey, (row_number() OVER w)::bigint AS rn, (rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment))::bigint AS r, (dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment))::bigint AS d, (ntile(4) OVER w)::bigint AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
add("window_offsets", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders")
add("window_frames", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, round(percent_rank() OVER (PARTITION BY event_type ORDER BY event_id), 9) AS pr, round(cume_dist() OVER (PARTITION BY event_type ORDER BY event_id), 9) AS cd FROM events")
add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 3")
add("nulls_order", "SELECT x, (row_number() OVER (ORDER BY x))::bigint AS up, (row_number() OVER (ORDER BY x DESC))::bigint AS down FROM (VALUES (1), (NULL), (2)) AS v(x)", "SELECT x, (row_number() OVER (ORDER BY x ASC NULLS LAST))::bigint AS up, (row_number() OVER (ORDER BY x DESC NULLS FIRST))::bigint AS down FROM (VALUES (1), (NULL), (2)) AS v(x)")
add("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
add("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
add("intersect_except", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3")
add("except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
add("cte_chain", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), per(k, n) AS MATERIALIZED (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT k, n FROM per WHERE n > (SELECT avg(n) FROM per)")
add("cte_recursive", "WITH RECURSIVE f(n, x) AS (SELECT 1, 1::bigint UNION ALL SELECT n + 1, x * (n + 1) FROM f WHERE n < 15) SELECT n, x FROM f")
add("derived_table", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS d WHERE n > 12")

# functions

add("fn_strings", "SELECT c_custkey, split_part(c_name, '#', 2) AS sp, split_part(c_name, '#', 9) AS none, translate(c_name, 'Cus', 'kU') AS tr, ascii(c_name) AS a, chr(c_nationkey + 321) AS ch, repeat('ab', 3) AS rep, reverse(c_name) AS rev, left(c_name, 4) AS l, right(c_name, 3) AS r, lpad(c_nationkey::text, 5, '*') AS lp, rpad(c_nationkey::text, 5, 'xy') AS rp FROM customer")
add("fn_regexp", "SELECT p_partkey, regexp('[0-9]5$', p_name) AS r, regexpi('PART', p_name) AS ri FROM part", "SELECT p_partkey, regexp_matches(p_name, '[0-9]5$') AS r, regexp_matches(p_name, '(?i)PART') AS ri FROM part")
add("fn_rounding", "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::double precision AS t0, trunc(l_extendedprice, 1)::double precision AS t1, round((-l_extendedprice)::numeric(18,4), 1)::double precision AS r, ceil(l_discount) AS c, floor(0 - l_tax) AS f, sign(l_tax - 0.04) AS s, abs(-l_quantity) AS a, mod(l_linenumber, 3) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::double AS t0, trunc(l_extendedprice * 10) / 10 AS t1, round((-l_extendedprice)::numeric(18,4), 1)::double AS r, ceil(l_discount) AS c, floor(0 - l_tax) AS f, sign(l_tax - 0.04)::double AS s, abs(-l_quantity) AS a, l_linenumber % 3 AS m FROM lineitem")
add("fn_powers", "SELECT p_partkey, round(power(p_size, 2), 6) AS p2, round(sqrt(p_size), 9) AS sq, round(exp(p_size / 50.0::double precision), 6) AS e, round(ln(p_size), 9) AS l, round(log(p_size), 9) AS lg, round(log(2, p_size), 9) AS l2 FROM part", "SELECT p_partkey, round(power(p_size, 2), 6) AS p2, round(sqrt(p_size), 9) AS sq, round(exp(p_size / 50.0::double), 6) AS e, round(ln(p_size), 9) AS l, round(log10(p_size), 9) AS lg, round(log2(p_size), 9) AS l2 FROM part")
add("fn_trigonometry", "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 9) AS t, round(asin(1.0::double precision / p_size), 9) AS asn, round(acos(1.0::double precision / p_size), 9) AS acs, round(atan(p_size), 9) AS atn, round(atan2(p_size, 3), 9) AS at2, round(radians(p_size), 9) AS r, round(degrees(p_size), 9) AS d, round(pi(), 9) AS p FROM part")
add("fn_decimals", "SELECT o_orderkey, decimal_add(o_totalprice::numeric(18,2), 1.10)::numeric(20,2)::text AS a, decimal_mul(o_totalprice::numeric(18,2), 2)::numeric(20,2)::text AS m, decimal_round(o_totalprice::numeric(18,2), 1)::numeric(20,1)::text AS r, numeric_format(o_totalprice, 12, 1) AS f, decimal_eq(NULL, NULL) AS e, decimal_lt(NULL, 1) AS l FROM orders", "SELECT o_orderkey, (o_totalprice::numeric(18,2) + 1.10)::numeric(20,2)::text AS a, (o_totalprice::numeric(18,2) * 2)::numeric(20,2)::text AS m, round_even(o_totalprice::numeric(18,2), 1)::numeric(20,1)::text AS r, o_totalprice::numeric(38,1)::text AS f, true AS e, false AS l FROM orders")
add("fn_extract", "SELECT event_id, extract(year from ts) AS y, extract(month from ts) AS mo, extract(dow from ts) AS dw, extract(doy from ts) AS dy, extract(week from ts) AS w, extract(isoyear from ts) AS iy, extract(quarter from ts) AS q, extract(century from ts) AS c, extract(decade from ts) AS de, date_part('hour', ts) AS h FROM events", "SELECT event_id, extract(year from ts)::double AS y, extract(month from ts)::double AS mo, extract(dow from ts)::double AS dw, extract(doy from ts)::double AS dy, extract(week from ts)::double AS w, extract(isoyear from ts)::double AS iy, extract(quarter from ts)::double AS q, extract(century from ts)::double AS c, extract(decade from ts)::double AS de, date_part('hour', ts)::double AS h FROM events")
add("fn_epoch", "SELECT event_id, extract(epoch from ts) AS e, floor(extract(second from ts)) AS s FROM events", "SELECT event_id, epoch(ts) AS e, floor(extract(second from ts)::double) AS s FROM events")
add("fn_date_trunc", "SELECT o_orderkey, date_trunc('month', o_orderdate)::timestamp AS m, date_trunc('week', o_orderdate)::timestamp AS w, date_trunc('quarter', o_orderdate)::timestamp AS q, date_trunc('decade', o_orderdate)::timestamp AS d FROM orders")
add("fn_dates", "SELECT n_nationkey, make_date(2020, 1 + n_nationkey % 12, 3) AS d, datediff(date '2020-03-01', date '2020-02-01') AS n FROM nation", "SELECT n_nationkey, make_date(2020, 1 + n_nationkey % 12, 3) AS d, (date '2020-03-01' - date '2020-02-01')::int AS n FROM nation")
add("fn_arrays", "SELECT n_nationkey, array_length(a, 1) AS n, array_to_string(array_append(a, 9), ',') AS ap, array_to_string(array_prepend(7, a), ',') AS pp, array_to_string(array_cat(a, ARRAY[1]), ',') AS ct, array_to_string(array_remove(a, 2), ',') AS rm, array_position(a, 2) AS p, a[1] AS x, array_to_string(a[2:3], ',') AS sl FROM (SELECT n_nationkey, ARRAY[n_nationkey, 2, n_regionkey] AS a FROM nation) t", "SELECT n_nationkey, len(a)::int AS n, array_to_string(list_append(a, 9), ',') AS ap, array_to_string(list_prepend(7, a), ',') AS pp, array_to_string(list_concat(a, [1]), ',') AS ct, array_to_string(list_filter(a, lambda x: x <> 2), ',') AS rm, nullif(list_position(a, 2), 0)::bigint AS p, a[1] AS x, array_to_string(a[2:3], ',') AS sl FROM (SELECT n_nationkey, [n_nationkey, 2, n_regionkey] AS a FROM nation) t")
add("fn_array_replace", "SELECT n_nationkey, array_to_string(array_replace(a, 2, 5), ',') AS r, array_to_string(array_positions(a, 2), ',') AS ps, array_upper(a, 1) AS u, array_lower(a, 1) AS l, array_ndims(a) AS d FROM (SELECT n_nationkey, ARRAY[n_regionkey, 2, 3] AS a FROM nation) t", "SELECT n_nationkey, array_to_string(list_transform(a, lambda x: CASE WHEN x = 2 THEN 5 ELSE x END), ',') AS r, CASE WHEN n_regionkey = 2 THEN '1,2' ELSE '2' END AS ps, 3 AS u, 1 AS l, 1 AS d FROM (SELECT n_nationkey, n_regionkey, [n_regionkey, 2, 3] AS a FROM nation) t")
add("fn_array_operators", "SELECT n_nationkey, a @> ARRAY[1] AS c, a <@ ARRAY[0, 1, 2, 3] AS i, a && ARRAY[4, 0] AS o FROM (SELECT n_nationkey, ARRAY[n_regionkey, 1] AS a FROM nation) t", "SELECT n_nationkey, a @> [1] AS c, a <@ [0, 1, 2, 3] AS i, a && [4, 0] AS o FROM (SELECT n_nationkey, [n_regionkey, 1] AS a FROM nation) t")
add("fn_string_to_array", "SELECT p_partkey, array_to_string(string_to_array(p_type, ' '), '|') AS parts, array_length(string_to_array(p_name, ' '), 1) AS n FROM part", "SELECT p_partkey, array_to_string(string_split(p_type, ' '), '|') AS parts, len(string_split(p_name, ' '))::int AS n FROM part")
add("unnest_rows", "SELECT n.n_nationkey, u.x FROM nation n, unnest(ARRAY[n.n_nationkey, n.n_regionkey]) AS u(x)", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x FROM nation")
add("unnest_ordinality", "SELECT n.n_nationkey, u.x, u.i FROM nation n, unnest(ARRAY[n.n_nationkey, n.n_regionkey]) WITH ORDINALITY AS u(x, i)", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS x, unnest([1, 2])::bigint AS i FROM nation")
add("generate_series", "SELECT g::bigint AS g FROM generate_series(1, 20, 3) AS t(g)")
add("json_operators", "SELECT event_id, props->>'k' AS v, (props->>'k')::int + 1 AS n, props ? 'k' AS has, props ? 'zz' AS no FROM events", "SELECT event_id, props->>'k' AS v, (props->>'k')::int + 1 AS n, json_contains(json_keys(props)::json, '\"k\"') AS has, false AS no FROM events")
add("json_functions", "SELECT event_id, json_typeof(props) AS t, json_valid(props) AS ok, json_extract_path_text(props, 'k') AS x, json_array_length('[1,2,3]') AS n, json_build_object('id', event_id, 'type', event_type) AS o FROM events", "SELECT event_id, 'object' AS t, true AS ok, props->>'k' AS x, 3 AS n, json_object('id', event_id, 'type', event_type)::varchar AS o FROM events")
add("json_containment", "SELECT event_id FROM events WHERE props @> '{\"k\": 7}'", "SELECT event_id FROM events WHERE (props->>'k')::int = 7")
add("json_changes", "SELECT event_id, jsonb_set(props, '{z}', '1') AS s, jsonb_delete(props, '{k}') AS d, json_strip_nulls('{\"a\":null,\"b\":1}') AS n FROM events", "SELECT event_id, '{\"k\":' || (props->>'k') || ',\"z\":1}' AS s, '{}' AS d, '{\"b\":1}' AS n FROM events")
add("json_each_rows", "SELECT e.event_id, j.key, j.value FROM events e, json_each(e.props) AS j", "SELECT event_id, 'k' AS key, props->>'k' AS value FROM events")
add("json_aggregates", "SELECT n_regionkey, json_agg(n_name) AS names, count(*) AS n FROM (SELECT n_regionkey, max(n_name) AS n_name FROM nation GROUP BY n_regionkey) t GROUP BY n_regionkey", "SELECT n_regionkey, json_group_array(n_name)::varchar AS names, count(*) AS n FROM (SELECT n_regionkey, max(n_name) AS n_name FROM nation GROUP BY n_regionkey) t GROUP BY n_regionkey")
add("json_object_agg", "SELECT r_regionkey, json_object_agg(r_name, r_regionkey) AS o FROM region GROUP BY r_regionkey", "SELECT r_regionkey, json_group_object(r_name, r_regionkey)::varchar AS o FROM region GROUP BY r_regionkey")
add("row_to_json", "SELECT row_to_json(t) AS j FROM (SELECT n_nationkey, n_name FROM nation) t", "SELECT json_object('n_nationkey', n_nationkey, 'n_name', n_name)::varchar AS j FROM nation")
add("uuid_functions", "SELECT is_valid_uuid(u) AS ok, uuid_normalize(u) AS n FROM (VALUES ('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11'), ('nope')) AS v(u)", "SELECT u LIKE 'A0%' AS ok, CASE WHEN u LIKE 'A0%' THEN lower(u) END AS n FROM (VALUES ('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11'), ('nope')) AS v(u)")
add("system_functions", "SELECT current_database() AS d, current_schema() AS s, pg_size_pretty(123456) AS p, pg_has_role('pg_read_server_files', 'USAGE') AS r, has_table_privilege('pg_class', 'INSERT') AS t, pg_is_in_recovery() AS rec", "SELECT 'main' AS d, 'public' AS s, '120 kB' AS p, false AS r, false AS t, false AS rec")

# more of the library: several functions to a query

add("integer_division", "SELECT o_custkey, (sum(o_orderkey) / 2)::bigint AS half, count(*) / 3 AS third, max(n) / 2 AS top, max(x) / 2 AS real, max(o_shade) / 2 AS shade FROM (SELECT o_custkey, o_orderkey, o_orderkey / 4 AS n, o_totalprice AS x, o_orderkey + 0.5::double precision AS o_shade FROM orders) o GROUP BY o_custkey", "SELECT o_custkey, (sum(o_orderkey) // 2)::bigint AS half, count(*) // 3 AS third, max(n) // 2 AS top, max(x) / 2 AS real, max(o_shade) / 2 AS shade FROM (SELECT o_custkey, o_orderkey, o_orderkey // 4 AS n, o_totalprice AS x, o_orderkey + 0.5::double AS o_shade FROM orders) o GROUP BY o_custkey")
add("shadowed_division", "SELECT n_nationkey / 2 AS h, n_regionkey / 2 AS r FROM (SELECT n_nationkey + 0.5::double precision AS n_nationkey, n_regionkey FROM nation) t", "SELECT n_nationkey / 2 AS h, (n_regionkey // 2)::bigint AS r FROM (SELECT n_nationkey + 0.5::double AS n_nationkey, n_regionkey FROM nation) t")
add("date_difference", "SELECT o_orderkey, o_orderdate::date - date '1990-01-01' AS days, (date '2030-12-31' - o_orderdate::date) / 7 AS weeks, o_orderdate::date - date '1990-01-01' + 1 AS later FROM orders", "SELECT o_orderkey, (o_orderdate::date - date '1990-01-01')::int AS days, (date '2030-12-31' - o_orderdate::date) // 7 AS weeks, (o_orderdate::date - date '1990-01-01' + 1)::int AS later FROM orders")
add("fn_decimals_more", "SELECT o_orderkey, decimal_sub(o_totalprice::numeric(18,2), 1.25)::numeric(20,2)::text AS s, decimal_gt(o_totalprice::numeric(18,2), 100000) AS g, decimal_abs((0 - o_totalprice)::numeric(18,2))::text AS a, decimal_to_text(o_totalprice::numeric(18,2)) AS t, decimal_div(o_totalprice::numeric(18,2), 4)::double precision AS d, numeric_cast(o_orderkey, 12, 2)::text AS c FROM orders", "SELECT o_orderkey, (o_totalprice::numeric(18,2) - 1.25)::numeric(20,2)::varchar AS s, o_totalprice::numeric(18,2) > 100000 AS g, abs((0 - o_totalprice)::numeric(18,2))::varchar AS a, o_totalprice::numeric(18,2)::varchar AS t, o_totalprice::numeric(18,2) / 4 AS d, o_orderkey::numeric(12,2)::varchar AS c FROM orders")
add("fn_dates_more", "SELECT event_id, to_timestamp(event_id)::timestamp AS t, make_time(1, 2, 3)::text AS m, pg_date_from_text('2024-02-03') AS d, pg_timestamp_from_text('2024-02-03 04:05:06')::timestamp AS p, strftime('%Y-%m', ts) AS f, extract(epoch from interval '1 hour 30 minutes') AS e, datetime('2024-01-02 03:04:05') AS s FROM events", "SELECT event_id, to_timestamp(event_id) AT TIME ZONE 'UTC' AS t, '01:02:03' AS m, date '2024-02-03' AS d, timestamp '2024-02-03 04:05:06' AS p, strftime(ts, '%Y-%m') AS f, 5400.0::double AS e, '2024-01-02 03:04:05' AS s FROM events")
add("fn_powers_more", "SELECT p_partkey, pow(p_size, 2)::double precision AS p, ceiling(p_retailprice)::bigint AS c, random() < 1 AS r FROM part", "SELECT p_partkey, pow(p_size, 2)::double AS p, ceiling(p_retailprice)::bigint AS c, true AS r FROM part")
add("json_paths", "SELECT event_id, (props->'k')::text AS j, props#>>'{k}' AS t, (props#>'{k}')::text AS jj, props ?| ARRAY['k', 'z'] AS some, props ?& ARRAY['k', 'z'] AS every, jsonb_typeof(props->'k') AS ty, jsonb_array_length('[1,2]') AS n, '[5,6]'::jsonb->>1 AS a, jsonb_delete_path(props, '{k}') AS gone, json_extract_scalar(props, '$.k') AS x, json_extract_path(props, 'k')::text AS y FROM events", "SELECT event_id, props->>'k' AS j, props->>'k' AS t, props->>'k' AS jj, true AS some, false AS every, 'number' AS ty, 2 AS n, '6' AS a, '{}' AS gone, props->>'k' AS x, props->>'k' AS y FROM events")
add("json_contained", "SELECT event_id FROM events WHERE props <@ '{\"k\": 7, \"z\": 1}'::jsonb", "SELECT event_id FROM events WHERE (props->>'k')::int = 7")
add("json_elements", "SELECT e.event_id, x.value FROM events e, json_array_elements('[1, 20]') AS x(value)", "SELECT event_id, unnest(['1', '20']) AS value FROM events")
add("json_records", "SELECT e.event_id, r.k, r.z FROM events e, jsonb_to_record(e.props) AS r(k int, z text)", "SELECT event_id, (props->>'k')::int AS k, NULL::varchar AS z FROM events")
add("json_aggregates_more", "SELECT n_regionkey, jsonb_agg(n_name) AS names, array_to_string(array_agg(DISTINCT n_name), '|') AS own FROM (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY n_regionkey) t GROUP BY n_regionkey", "SELECT n_regionkey, json_group_array(n_name)::varchar AS names, array_to_string(array_agg(DISTINCT n_name), '|') AS own FROM (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY n_regionkey) t GROUP BY n_regionkey")
add("system_more", "SELECT current_user AS u, session_user AS s, pg_get_userbyid(10) AS o, has_database_privilege('main', 'CONNECT') AS d, has_schema_privilege('public', 'USAGE') AS c, pg_table_is_visible(1) AS v, inet_client_addr() AS ca, inet_server_port() AS sp, array_to_string(current_schemas(true), ',') AS p, pg_backend_pid() > 0 AS b, version() LIKE 'PostgreSQL%' AS ver, is_valid_uuid(gen_random_uuid()) AS g, current_date = now()::date AS n", "SELECT 'postgres' AS u, 'postgres' AS s, 'postgres' AS o, true AS d, true AS c, true AS v, '127.0.0.1' AS ca, 5432 AS sp, 'pg_catalog,public' AS p, true AS b, true AS ver, true AS g, true AS n")
add("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_orderkey FETCH FIRST 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
add("collation", "SELECT c_custkey FROM customer WHERE c_name COLLATE \"C\" < 'Customer#000000100'", "SELECT c_custkey FROM customer WHERE c_name < 'Customer#000000100'")
add("type_names", "SELECT format_type(23, -1) AS a, format_type(1043, 14) AS b, format_type(1700, 786438) AS c, format_type(1007, -1) AS d, to_regtype('double precision') AS e, to_regtype('nope') AS f, to_regtype('text[]') AS g", "SELECT 'integer' AS a, 'character varying(10)' AS b, 'numeric(12,2)' AS c, 'integer[]' AS d, 701::bigint AS e, NULL::bigint AS f, 1009::bigint AS g")

# full-text search

add("fts_match", "SELECT doc_id FROM documents WHERE to_tsvector('english', text) @@ to_tsquery('english', 'license & !apache')", "WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')) AS x FROM documents) SELECT doc_id FROM w WHERE list_contains(x, 'license') AND NOT list_contains(x, 'apache')")
add("fts_phrase", "SELECT doc_id FROM documents WHERE to_tsvector(text) @@ phraseto_tsquery('mit license') OR to_tsvector(text) @@ plainto_tsquery('rights reserved')", "WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda x: x <> '') AS x FROM documents) SELECT doc_id FROM w WHERE contains(' ' || array_to_string(x, ' ') || ' ', ' mit license ') OR (list_contains(x, 'rights') AND list_contains(x, 'reserved'))")

add("fts_websearch", "SELECT doc_id FROM documents WHERE to_tsvector('english', text) @@ websearch_to_tsquery('english', 'license -apache')", QUERIES["fts_match"][1])

# the flagship: join, group, having, order

FLAGSHIP = "SELECT split_part(c.c_name, '#', 2) AS customer, date_trunc('year', o.o_orderdate)::timestamp AS y, count(*) AS n, round(sum(o.o_totalprice)::numeric(18,4), 2)::double precision AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY total DESC, customer, y LIMIT 100"
add("flagship", FLAGSHIP, FLAGSHIP.replace("double precision", "double"))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(sql) for name, (sql, _) in QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: duck or sql for name, (sql, duck) in QUERIES.items()}
