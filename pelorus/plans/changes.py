"""Statements that change data, definitions and sessions, and operators that are
DataFrame functions; each returns the state that it leaves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.operators import relational
from pelorus.plans.queries import database
from pelorus.sources.tables import scan
from pelorus.streaming.windows import windowed

CALLABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, script: str, oracle: str, tables: str) -> None:
    CALLABLES[name] = lambda spark, sf_dir: database(spark, sf_dir, tables).sql(script)
    if oracle:
        ORACLES[name] = oracle


add("dml_update", "UPDATE nation SET n_name = upper(n_name) || '!', n_regionkey = CASE WHEN n_regionkey = 1 THEN 10 ELSE n_regionkey END WHERE n_nationkey < 10; SELECT * FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN upper(n_name) || '!' ELSE n_name END AS n_name, CASE WHEN n_nationkey < 10 AND n_regionkey = 1 THEN 10 ELSE n_regionkey END AS n_regionkey FROM nation", "nation")
add("dml_update_subquery", "UPDATE supplier SET s_acctbal = 0 WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2); SELECT s_suppkey, s_acctbal FROM supplier", "SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier", "supplier nation")
add("dml_update_values", "UPDATE region SET r_name = v.label FROM (VALUES (0, 'zero'), (3, 'three')) AS v(k, label) WHERE region.r_regionkey = v.k; SELECT * FROM region", "SELECT r_regionkey, coalesce(label, r_name) AS r_name FROM region LEFT JOIN (VALUES (0, 'zero'), (3, 'three')) AS v(k, label) ON r_regionkey = k", "region")
add("dml_update_returning", "UPDATE region SET r_name = lower(r_name) WHERE r_regionkey > 2 RETURNING r_regionkey, r_name AS name", "SELECT r_regionkey, lower(r_name) AS name FROM region WHERE r_regionkey > 2", "region")
add("dml_delete", "DELETE FROM customer WHERE c_acctbal < 0; SELECT c_custkey FROM customer", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false)", "customer")
add("dml_delete_using", "DELETE FROM nation USING (VALUES (1), (5)) AS v(k) WHERE nation.n_nationkey = v.k; SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 5)", "nation")
add("dml_delete_returning", "DELETE FROM nation WHERE n_regionkey = 4 RETURNING n_nationkey, n_name", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 4", "nation")
add("dml_insert_select", "INSERT INTO region (r_regionkey, r_name) SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 0; SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 0", "region nation")
add("dml_insert_returning", "INSERT INTO region VALUES (7, 'SEVEN'), (8, NULL) RETURNING r_regionkey, coalesce(r_name, '-') AS name", "SELECT * FROM (VALUES (7, 'SEVEN'), (8, '-')) AS v(r_regionkey, name)", "region")
add("dml_on_conflict", "CREATE TABLE kv (k int primary key, v text); INSERT INTO kv VALUES (1, 'a'), (2, 'b'); INSERT INTO kv VALUES (2, 'B'), (3, 'C') ON CONFLICT (k) DO UPDATE SET v = excluded.v || kv.v; INSERT INTO kv VALUES (1, 'zz') ON CONFLICT (k) DO NOTHING; SELECT * FROM kv", "SELECT * FROM (VALUES (1, 'a'), (2, 'Bb'), (3, 'C')) AS v(k, v)", "")
add("dml_truncate", "TRUNCATE region; SELECT count(*) AS n FROM region", "SELECT 0::bigint AS n", "region")
add("transaction_rollback", "BEGIN; DELETE FROM region; ROLLBACK; BEGIN; DELETE FROM region WHERE r_regionkey = 1; COMMIT; SELECT * FROM region", "SELECT * FROM region WHERE r_regionkey <> 1", "region")
add("ddl_types", "CREATE TABLE t (id serial primary key, a smallint, b bigint, c numeric(8,3), d varchar(5), e boolean default true, f int[], g jsonb, h uuid); INSERT INTO t (a, b, c, d, f, g, h) VALUES (1, 2, 3.125, 'abc', '{1,2,3}', '{\"x\": [1, 2]}', 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11'); SELECT id, a::int AS a, b, c::text AS c, d, e, f[2] AS f, g #>> '{x,1}' AS g, h FROM t", "SELECT 1 AS id, 1 AS a, 2::bigint AS b, '3.125' AS c, 'abc' AS d, true AS e, 2 AS f, '2' AS g, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS h", "")
add("ddl_enum", "CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy'); ALTER TYPE mood ADD VALUE 'meh' BEFORE 'ok'; CREATE TABLE m (id int, x mood); INSERT INTO m VALUES (1, 'meh'), (2, 'happy'); SELECT m.id, m.x, e.enumlabel FROM m JOIN pg_enum e ON e.enumlabel = m.x", "SELECT * FROM (VALUES (1, 'meh', 'meh'), (2, 'happy', 'happy')) AS v(id, x, enumlabel)", "")
add("ddl_alter", "ALTER TABLE region ADD COLUMN note text DEFAULT 'n'; ALTER TABLE region RENAME COLUMN r_name TO label; ALTER TABLE region ALTER COLUMN r_regionkey TYPE bigint; SELECT * FROM region", "SELECT r_regionkey::bigint AS r_regionkey, r_name AS label, 'n' AS note FROM region", "region")
add("ddl_view", "CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000; SELECT count(*) AS n, max(c_acctbal) AS top FROM rich", "SELECT count(*) AS n, max(c_acctbal) AS top FROM customer WHERE c_acctbal > 9000", "customer")
add("ddl_comment", "COMMENT ON TABLE region IS 'parts of the world'; COMMENT ON COLUMN region.r_name IS 'name'; SELECT description, objsubid FROM pg_description", "SELECT * FROM (VALUES ('parts of the world', 0), ('name', 2)) AS v(description, objsubid)", "region")
add("catalog_columns", "SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation')", "SELECT * FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2), ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3)) AS v(table_name, column_name, ordinal_position)", "region nation")
add("catalog_class", "SELECT c.relname, a.attname FROM pg_catalog.pg_class c JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = 'public'", "SELECT * FROM (VALUES ('region', 'r_regionkey'), ('region', 'r_name')) AS v(relname, attname)", "region")
add("catalog_constraints", "CREATE TABLE p (id int primary key); CREATE TABLE q (id int primary key, p_id int references p (id), n int check (n > 0), u text unique); SELECT conname, contype, consrc FROM pg_constraint", "SELECT * FROM (VALUES ('p_pkey', 'p', 'PRIMARY KEY (id)'), ('q_pkey', 'p', 'PRIMARY KEY (id)'), ('q_p_id_fkey', 'f', 'FOREIGN KEY (p_id) REFERENCES p(id)'), ('q_n_check', 'c', 'CHECK (n > 0)'), ('q_u_key', 'u', 'UNIQUE (u)')) AS v(conname, contype, consrc)", "")
add("dml_on_conflict_where", "CREATE TABLE kv (k int primary key, v int); INSERT INTO kv VALUES (1, 10), (2, 20); INSERT INTO kv VALUES (1, 99), (2, 7), (3, 3) ON CONFLICT (k) DO UPDATE SET v = excluded.v WHERE excluded.v / 2 > kv.v; SELECT * FROM kv", "SELECT * FROM (VALUES (1, 99), (2, 20), (3, 3)) AS v(k, v)", "")
add("dml_with_insert", "WITH big AS (SELECT n_nationkey + 100 AS k, n_name FROM nation WHERE n_regionkey = 3) INSERT INTO region (r_regionkey, r_name) SELECT k, n_name FROM big; SELECT * FROM region", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 3", "region nation")
add("transaction_savepoint", "BEGIN; DELETE FROM region WHERE r_regionkey = 0; SAVEPOINT a; DELETE FROM region; ROLLBACK TO SAVEPOINT a; COMMIT; SELECT * FROM region", "SELECT * FROM region WHERE r_regionkey <> 0", "region")
add("ddl_view_follows", "CREATE VIEW low AS SELECT * FROM region WHERE r_regionkey / 2 < 2; INSERT INTO region VALUES (-5, 'NEW'); SELECT * FROM low", "SELECT * FROM region WHERE r_regionkey < 4 UNION ALL SELECT -5, 'NEW'", "region")
add("catalog_comments", "COMMENT ON TABLE region IS 'parts of the world'; COMMENT ON COLUMN region.r_name IS 'name'; SELECT a.attname, format_type(a.atttypid, a.atttypmod) LIKE '%' AS shown, col_description(a.attrelid, a.attnum) AS about, obj_description('region'::regclass, 'pg_class') AS what FROM pg_attribute a WHERE a.attrelid = 'region'::regclass", "SELECT * FROM (VALUES ('r_regionkey', true, NULL, 'parts of the world'), ('r_name', true, 'name', 'parts of the world')) AS v(attname, shown, about, what)", "region")
add("catalog_definitions", "CREATE TABLE p (id int primary key, x varchar(5), y numeric(8,3), z text[]); CREATE INDEX px ON p (x); SELECT attname AS name, format_type(atttypid, atttypmod) AS def FROM pg_attribute WHERE attrelid = 'p'::regclass UNION ALL SELECT conname, pg_get_constraintdef(oid) FROM pg_constraint UNION ALL SELECT relname, pg_get_indexdef(oid) FROM pg_class WHERE relkind = 'i'", "SELECT * FROM (VALUES ('id', 'integer'), ('x', 'character varying(5)'), ('y', 'numeric(8,3)'), ('z', 'text[]'), ('p_pkey', 'PRIMARY KEY (id)'), ('px', 'CREATE INDEX px ON p (x)')) AS v(name, def)", "")
add("catalog_statistics", "SELECT tablename, attname, null_frac FROM pg_stats", "SELECT 'customer' AS tablename, * FROM (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS attname, unnest([count(*) - count(c_custkey), count(*) - count(c_name), count(*) - count(c_nationkey), count(*) - count(c_acctbal), count(*) - count(c_mktsegment)]) / count(*) AS null_frac FROM customer)", "customer")
add("catalog_roles", "SELECT rolname AS name FROM pg_roles UNION ALL SELECT usename FROM pg_user UNION ALL SELECT datname FROM pg_database UNION ALL SELECT spcname FROM pg_tablespace UNION ALL SELECT collname FROM pg_collation UNION ALL SELECT slot_name FROM pg_replication_slots", "SELECT unnest(['postgres', 'public', 'postgres', 'main', 'pg_default', 'pg_global', 'default', 'C', 'POSIX', 'uuid']) AS name", "")
add("catalog_keys", "CREATE TABLE p (id int primary key); CREATE TABLE q (id int, p_id int references p (id)); SELECT k.table_name, k.column_name, c.constraint_type FROM information_schema.key_column_usage k JOIN information_schema.table_constraints c ON c.constraint_name = k.constraint_name", "SELECT * FROM (VALUES ('p', 'id', 'PRIMARY KEY'), ('q', 'p_id', 'FOREIGN KEY')) AS v(table_name, column_name, constraint_type)", "")
add("session_set_config", "SELECT set_config('application_name', 'zz', false); SHOW application_name", "SELECT 'zz' AS application_name", "")
add("session_settings", "SET application_name = 'app'; SHOW application_name", "SELECT 'app' AS application_name", "")
add("prepared_statement", "PREPARE by_region AS SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2; EXECUTE by_region(2, 8)", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 8", "nation")
add("cursor_fetch", "DECLARE c CURSOR FOR SELECT n_nationkey FROM nation ORDER BY n_nationkey; FETCH 3 FROM c; FETCH 4 FROM c", "SELECT n_nationkey::bigint AS n_nationkey FROM nation WHERE n_nationkey BETWEEN 3 AND 6", "nation")


def _recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations reachable by shared regions, with set semantics."""
    nation = scan(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    seed = nation.where("n_nationkey = 0").select("n_nationkey")
    step = lambda new: new.join(nation, "n_nationkey").join(nation.select(F.col("n_nationkey").alias("k"), "n_regionkey"), "n_regionkey").select(F.col("k").alias("n_nationkey"))
    return relational.recursive_union(seed, step)


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it."""
    events = scan(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())[:2]
    left = events.where(F.col("event_type") == kinds[0]).drop("event_type")
    right = events.where(F.col("event_type") == kinds[1]).groupBy("user_id", "ts").agg(F.max("event_id").alias("seen"))
    return relational.asof_join(left, right, ["user_id"], "ts", "ts").select("event_id", "seen")


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = scan(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    bands = spark.createDataFrame([(0, 0.0, 950.0), (1, 950.0, 1200.0), (2, 1200.0, 5000.0)], "band int, low double, high double")
    return relational.range_join(part, bands, "p_retailprice", "low", "high", 100.0).select("p_partkey", "band")


CALLABLES |= {
    "recursive_union": _recursive,
    "asof_join": _asof,
    "range_join": _range,
    "event_windows": lambda spark, sf_dir: windowed(scan(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
}
ORACLES |= {
    "recursive_union": "WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT b.n_nationkey FROM r JOIN nation a ON a.n_nationkey = r.k JOIN nation b ON a.n_regionkey = b.n_regionkey) SELECT k AS n_nationkey FROM r",
    "asof_join": "WITH kinds AS (SELECT list_sort(list(DISTINCT event_type)) AS x FROM events), l AS (SELECT event_id, user_id, ts FROM events, kinds WHERE event_type = x[1]), r AS (SELECT user_id, ts, max(event_id) AS seen FROM events, kinds WHERE event_type = x[2] GROUP BY user_id, ts) SELECT l.event_id, r.seen FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts",
    "range_join": "SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1200 THEN 1 ELSE 2 END AS band FROM part WHERE p_retailprice >= 0 AND p_retailprice < 5000",
    "event_windows": "SELECT date_trunc('day', ts)::timestamp AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
