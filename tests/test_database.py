"""Definitions, changes, constraints, transactions and introspection."""

import pytest

from pelorus.database import Database, FailedTransaction, IntegrityError


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.execute("CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy')")
    d.execute("CREATE TABLE c (id serial primary key, name varchar(10) not null, email text unique, m mood default 'ok', bal numeric(6,2) check (bal >= 0), tags text[])")
    d.execute("INSERT INTO c (name, email, bal, tags) VALUES ('ann', 'a@x', 10.50, '{a,b}'), ('bob', 'b@x', 2, ARRAY['c'])")
    return d


def rows(result):
    return sorted(tuple(r) for r in result.collect())


def test_insert_fills_serials_and_defaults(db):
    assert rows(db.sql("SELECT id, name, m, bal::text, tags[1] FROM c")) == [(1, "ann", "ok", "10.50", "a"), (2, "bob", "ok", "2.00", "c")]
    assert rows(db.sql("INSERT INTO c (name, email, bal) VALUES ('cy', 'c@x', $1) RETURNING id, bal::text", [5])) == [(3, "5.00")]


@pytest.mark.parametrize(
    "values, error",
    [
        ("('dd', 'a@x', 'ok', 1)", IntegrityError),
        ("('dd', 'd@x', 'ok', -1)", IntegrityError),
        ("('dd', 'd@x', 'angry', 1)", Exception),
        ("('dd', 'd@x', 'ok', 1.234)", Exception),
        ("('dd', 'd@x', 'ok', 12345)", Exception),
        ("('averylongname', 'd@x', 'ok', 1)", Exception),
        ("(NULL, 'd@x', 'ok', 1)", Exception),
    ],
)
def test_constraints(db, values, error):
    with pytest.raises(error):
        db.execute(f"INSERT INTO c (name, email, m, bal) VALUES {values}")
    assert db.table("c").count() == 2


def test_foreign_key(db):
    db.execute("CREATE TABLE o (id int primary key, c_id int references c (id)); INSERT INTO o VALUES (1, 2), (2, NULL)")
    with pytest.raises(IntegrityError):
        db.execute("INSERT INTO o VALUES (3, 99)")


def test_update_and_delete(db):
    assert rows(db.sql("UPDATE c SET bal = bal * 2 WHERE name LIKE 'a%' RETURNING id, bal::text")) == [(1, "21.00")]
    db.execute("UPDATE c SET bal = v.b FROM (VALUES (1, 7.25)) AS v(id, b) WHERE c.id = v.id")
    assert rows(db.sql("SELECT id, bal::text FROM c")) == [(1, "7.25"), (2, "2.00")]
    with pytest.raises(IntegrityError):
        db.execute("UPDATE c SET email = 'a@x'")
    assert rows(db.sql("DELETE FROM c USING (VALUES (2)) AS v(id) WHERE c.id = v.id RETURNING name")) == [("bob",)]


def test_upsert(db):
    db.execute("INSERT INTO c (id, name, email, bal) VALUES (1, 'new', 'z', 1) ON CONFLICT (id) DO UPDATE SET name = excluded.name")
    db.execute("INSERT INTO c (id, name, email, bal) VALUES (1, 'newer', 'z', 1) ON CONFLICT DO NOTHING")
    assert rows(db.sql("SELECT name FROM c")) == [("bob",), ("new",)]


def test_transactions(db):
    db.execute("BEGIN; DELETE FROM c; CREATE TABLE t (a int)")
    assert db.execute("ROLLBACK").tag == "ROLLBACK" and db.table("c").count() == 2 and "t" not in db.data
    db.execute("BEGIN")
    with pytest.raises(Exception):
        db.execute("SELECT nope FROM c")
    with pytest.raises(FailedTransaction):
        db.execute("SELECT 1")
    assert db.execute("COMMIT").tag == "ROLLBACK"


def test_enums_keep_their_order(db):
    db.execute("ALTER TYPE mood ADD VALUE 'meh' BEFORE 'ok'; ALTER TYPE mood ADD VALUE 'great' AFTER 'happy'; ALTER TYPE mood ADD VALUE IF NOT EXISTS 'ok'")
    assert [r[0] for r in db.sql("SELECT enumlabel FROM pg_enum ORDER BY enumsortorder").collect()] == ["sad", "meh", "ok", "happy", "great"]
    with pytest.raises(ValueError):
        db.execute("ALTER TYPE mood ADD VALUE 'ok'")


def test_introspection(db):
    db.execute("COMMENT ON COLUMN c.name IS 'who'; CREATE INDEX by_name ON c (name); CREATE VIEW v AS SELECT id FROM c")
    assert db.comment_of("c", "name") == "who"
    assert rows(db.sql("SELECT conname FROM pg_constraint")) == [("c_bal_check",), ("c_email_key",), ("c_pkey",)]
    assert ("c", "BASE TABLE") in rows(db.sql("SELECT table_name, table_type FROM information_schema.tables"))
    for name in db.catalog.relations():
        assert db.catalog.frame(db.spark, name).columns


def test_session_statements(db):
    assert rows(db.sql("SET datestyle = 'ISO'; SHOW datestyle")) == [("ISO",)]
    assert rows(db.sql("PREPARE q AS SELECT name FROM c WHERE id = $1; EXECUTE q(2)")) == [("bob",)]
    for s in ("GRANT ALL ON c TO x", "CREATE DATABASE d", "CREATE USER u", "DEALLOCATE ALL", "ANALYZE c"):
        assert db.execute(s).df is None
    p = db.portal("SELECT id FROM c ORDER BY id")
    assert len(p.fetch(1)) == 1 and p.suspended and len(p.fetch()) == 1 and not p.suspended
    assert "Physical Plan" in db.sql("EXPLAIN SELECT * FROM c").first()[0]


def test_storage_writes_versions(spark, tmp_path):
    d = Database(spark, str(tmp_path))
    d.execute("CREATE TABLE t (a int); INSERT INTO t VALUES (1), (2); DELETE FROM t WHERE a = 1")
    assert rows(d.sql("SELECT a FROM t")) == [(2,)] and len(list((tmp_path / "t").iterdir())) == 3


@pytest.mark.parametrize("sql", ["SELECT sqrt(-1)", "SELECT ln(0)", "SELECT asin(2)", "SELECT numeric_cast('1.234', 5, 2)", "SELECT 'x'::uuid", "SELECT '300.1.1.1'::inet"])
def test_domain_errors(db, sql):
    with pytest.raises(Exception):
        db.sql(sql).collect()


@pytest.mark.parametrize(
    "sql, value",
    [
        ("SELECT trunc(-3.7)::int", -3),
        ("SELECT log(100)", 2.0),
        ("SELECT chr(8364)", "€"),
        ("SELECT split_part('a', ',', 0)", ""),
        ("SELECT 7 / 2", 3),
        ("SELECT array_position(ARRAY[1], 9)", None),
        ("SELECT array_ndims(ARRAY[[1],[2]])", 2),
        ("SELECT array_to_string(ARRAY[1,NULL,3], ',')", "1,3"),
        ("SELECT ARRAY[1,NULL] && ARRAY[2]", False),
        ("SELECT jsonb_insert('[1,3]', '{1}', '2')", "[1,2,3]"),
        ("SELECT '{\"a\":null}'::jsonb ->> 'a'", None),
        ("SELECT json_typeof('[]')", "array"),
        ("SELECT extract(millennium from date '2001-01-01')", 3.0),
        ("SELECT to_timestamp(0) = epoch()", True),
        ("SELECT '$1,234.50'::money::text", "1234.50"),
        ("SELECT has_table_privilege('c', 'INSERT')", True),
        ("SELECT decimal_round(2.5, 0)::int", 2),
        ("SELECT to_tsvector('a b a') IS NOT NULL", True),
        ("SELECT string_agg(x, '-' ORDER BY x DESC) FROM (VALUES ('a'), ('b')) AS v(x)", "b-a"),
        ("SELECT to_json(5)", "5"),
    ],
)
def test_values(db, sql, value):
    assert db.sql(sql).first()[0] == value


@pytest.fixture
def store(spark):
    db = Database(spark)
    db.execute("CREATE TABLE kv (k integer PRIMARY KEY, v text UNIQUE)")
    return db


def kv(db):
    return sorted(tuple(r) for r in db.sql("SELECT k, v FROM kv").collect())


def test_conflicts_within_one_statement(store):
    store.execute("INSERT INTO kv VALUES (1, 'a'), (1, 'b'), (2, 'c') ON CONFLICT (k) DO NOTHING")
    assert kv(store) == [(1, "a"), (2, "c")]
    store.execute("INSERT INTO kv VALUES (2, 'd'), (3, 'e') ON CONFLICT (k) DO UPDATE SET v = excluded.v")
    assert kv(store) == [(1, "a"), (2, "d"), (3, "e")]
    with pytest.raises(ValueError, match="second time"):
        store.execute("INSERT INTO kv VALUES (4, 'x'), (4, 'y') ON CONFLICT (k) DO UPDATE SET v = excluded.v")
    with pytest.raises(ValueError, match="unique"):
        store.execute("INSERT INTO kv VALUES (5, 'a') ON CONFLICT (k) DO NOTHING")
    assert kv(store) == [(1, "a"), (2, "d"), (3, "e")]


def test_views_read_tables_as_they_are(store):
    store.execute("INSERT INTO kv VALUES (1, 'a')")
    store.execute("CREATE VIEW big AS SELECT k FROM kv WHERE k > 0; CREATE VIEW bigger AS SELECT k + 1 AS n FROM big")
    store.execute("INSERT INTO kv VALUES (7, 'b')")
    assert sorted(r[0] for r in store.sql("SELECT n FROM bigger").collect()) == [2, 8]


def test_savepoints(store):
    store.execute("BEGIN; INSERT INTO kv VALUES (1, 'a'); SAVEPOINT one; INSERT INTO kv VALUES (2, 'b'); SAVEPOINT two; INSERT INTO kv VALUES (3, 'c')")
    store.execute("ROLLBACK TO SAVEPOINT one")
    assert kv(store) == [(1, "a")]
    with pytest.raises(ValueError, match="does not exist"):
        store.execute("ROLLBACK TO two")
    store.execute("ROLLBACK TO one; INSERT INTO kv VALUES (4, 'd'); RELEASE SAVEPOINT one; COMMIT")
    assert kv(store) == [(1, "a"), (4, "d")]


@pytest.fixture
def numbers(spark):
    db = Database(spark)
    db.attach("t", spark.sql("SELECT * FROM VALUES (7, 2, date'2020-03-01', date'2020-02-01', 2.5D), (5, 3, date'2021-03-01', date'2020-02-01', 7.5D) AS t(v, k, d, e, f)"))
    return db


@pytest.mark.parametrize(
    "sql, rows",
    [
        ("SELECT max(v) / 2, (k + 6) / 2 FROM t GROUP BY k", [(2, 4), (3, 4)]),
        ("SELECT sum(v) / 2, count(*) / 3, avg(v) / 2 FROM t", [(6, 0, 3.0)]),
        ("SELECT a / b FROM (VALUES (7, 2)) AS x(a, b)", [(3,)]),
        ("SELECT v / 2 FROM (SELECT 2.5::float8 AS v) q", [(1.25,)]),
        ("SELECT q / 2 FROM (SELECT v / 2 AS q FROM t) x", [(1,), (1,)]),
        ("SELECT v / 2, count(*) FROM t GROUP BY v / 2", [(2, 1), (3, 1)]),
        ("SELECT v / 2 * 1.5::float8, v / 2 / 2, -v / 2, f / 2, v / 2 ^ 2 FROM t", [(3.0, 1, -2, 3.75, 1.25), (4.5, 1, -3, 1.25, 1.75)]),
        ("SELECT sum(v) OVER (PARTITION BY k) / 2, 9 / sum(v) OVER (PARTITION BY k) FROM t", [(2, 1), (3, 1)]),
        ("SELECT v FROM t WHERE v / 2 = (SELECT max(v / 2) FROM t)", [(7,)]),
        ("SELECT v / 2 FROM t UNION ALL SELECT f / 2 FROM t", [(1.25,), (2.0,), (3.0,), (3.75,)]),
        ("SELECT d - e, d - e + 1, v - k, v - k * 2 FROM t", [(29, 30, 5, 3), (394, 395, 2, -1)]),
    ],
)
def test_types_decide_operators(numbers, sql, rows):
    assert sorted(tuple(r) for r in numbers.sql(sql).collect()) == rows


def test_division_in_changes(spark):
    db = Database(spark)
    db.execute("CREATE TABLE w (id int, n int DEFAULT 7 / 2, CHECK (n / 2 < 9)); INSERT INTO w (id) VALUES (9 / 2), (1); UPDATE w SET n = (n + 4) / 2 WHERE id / 3 = 1")
    assert sorted(tuple(r) for r in db.table("w").collect()) == [(1, 3), (4, 3)]
    assert [tuple(r) for r in db.execute("DELETE FROM w WHERE id / 2 = (SELECT 4 / 2) RETURNING id / 3, n").rows()] == [(1, 3)]
    with pytest.raises(IntegrityError):
        db.execute("INSERT INTO w VALUES (1, 18)")


def test_statistics_and_names(spark):
    db = Database(spark)
    db.execute("CREATE TYPE mood AS ENUM ('a', 'b'); CREATE TABLE p (id int, x text, m mood); INSERT INTO p (id, x) VALUES (1, 'a'), (2, NULL)")
    assert sorted(tuple(r) for r in db.sql("SELECT attname, null_frac, n_distinct FROM pg_stats").collect()) == [("id", 0.0, -1.0), ("m", 1.0, 0.0), ("x", 0.5, -0.5)]
    assert [r[0] for r in db.sql("SELECT format_type(atttypid, atttypmod) FROM pg_attribute WHERE attrelid = 'p'::regclass ORDER BY attnum").collect()] == ["integer", "text", "mood"]
    with pytest.raises(NotImplementedError):
        db.execute("WITH w AS (SELECT 1 AS k) DELETE FROM p WHERE id IN (SELECT k FROM w)")
