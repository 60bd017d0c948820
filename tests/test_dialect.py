"""Statements in, Spark SQL out; and helpers that need no session."""

import pytest

from pelorus.dialect import Translator, literal, statements
from pelorus.functions import fts, jsons
from pelorus.types import PgType, array_literal, range_parts


@pytest.fixture
def t():
    return Translator({"props": "jsonb", "n": "int4"}.get, {"mood": ["sad", "ok"]}.get)


@pytest.mark.parametrize(
    "sql, part",
    [
        ("SELECT a::int FROM t", "CAST(a AS INT)"),
        ("SELECT a::double precision[] FROM t", "CAST(a AS ARRAY<DOUBLE>)"),
        ("SELECT props->>'k' FROM t", "get_json_object(props, '$[\\'k\\']')"),
        ("SELECT * FROM t WHERE a ~* 'x'", "rlike(a, concat('(?i)', 'x'))"),
        ("SELECT * FROM t WHERE a !~ 'x'", "NOT rlike(a, 'x')"),
        ("SELECT * FROM t WHERE a = ANY(ARRAY[1,2])", "array_contains(array(1, 2), a)"),
        ("SELECT * FROM t WHERE a = ANY('{1,2}')", "array_contains(array(1, 2), a)"),
        ("SELECT * FROM t WHERE props @> '{\"a\":1}'", "pg_json_contains(props"),
        ("SELECT * FROM t WHERE tags @> ARRAY['x']", "array_except(array('x'), tags)"),
        ("SELECT n / 2 FROM t", "n div 2"),
        ("SELECT a / 2 FROM t", "a / 2"),
        ("SELECT * FROM t ORDER BY a DESC, b LIMIT 1", "ORDER BY a DESC NULLS FIRST , b NULLS LAST LIMIT 1"),
        ("SELECT 'it''s'", "'it\\'s'"),
        ("SELECT 'a\\b'", "'a\\\\b'"),
        ("SELECT * FROM public.t, pg_catalog.pg_class", "FROM t , pg_class"),
        ("SELECT * FROM information_schema.tables", "information_schema_tables"),
        ("SELECT x FROM t WHERE id = $1 AND y = %(name)s", "id = :p1 AND y = :name"),
        ("SELECT x[1:2] FROM t", "slice(x"),
        ("SELECT 'ok'::mood", "'sad', 'ok'"),
        ("SELECT INTERVAL '1 year 2 days'", "make_interval(1, 0, 0, 2, 0, 0, 0)"),
        ("SELECT log(x) FROM t", "log10(x)"),
        ("SELECT a OPERATOR(pg_catalog.~) 'x' FROM t", "rlike(a, 'x')"),
    ],
)
def test_translation(t, sql, part):
    assert part in t.translate(sql)


def test_split_respects_strings_and_comments():
    assert [s.strip() for s in statements("SELECT ';'; -- a;b\nSELECT 2;")] == ["SELECT ';'", "-- a;b\nSELECT 2"]


@pytest.mark.parametrize("bad", ["SELECT (1", "SELECT 1)", "SELECT [1"])
def test_unbalanced_brackets(t, bad):
    with pytest.raises(SyntaxError):
        t.translate(bad)


def test_literals():
    assert literal("'a''b'") == "a'b" and literal("E'a\\nb'") == "a\nb" and literal("$$x'y$$") == "x'y"
    assert array_literal('{1,NULL,"a,b",{x}}') == ["1", None, "a,b", ["x"]]
    assert array_literal("{}") == []
    assert range_parts("[1,5)") == ("1", "5", True, False)
    assert PgType("numeric(8,3)").spark == "DECIMAL(8,3)" and PgType("timestamp with time zone").spark == "TIMESTAMP" and PgType("int[][]").spark == "ARRAY<ARRAY<INT>>"


def test_json_helpers():
    assert jsons.contains({"a": [1, {"b": 2}]}, {"a": [{"b": 2}]}) and not jsons.contains({"a": 1}, {"a": True})
    assert jsons.set_path({"a": {}}, "{a,b}", 1) == {"a": {"b": 1}}
    assert jsons.insert_path([1, 3], "{1}", 2, False) == [1, 2, 3] and jsons.insert_path([1, 3], "{0}", 2, True) == [1, 2, 3]
    assert jsons.delete_path({"a": [1, 2]}, "{a,0}") == {"a": [2]}
    assert jsons.strip_nulls({"a": None, "b": [None]}) == {"b": [None]}


def test_query_trees():
    assert fts.parse_query("a & !b | c:*", "to_tsquery") == ("or", ("and", ("word", "a"), ("not", ("word", "b"))), ("prefix", "c"))
    assert fts.parse_query('"big cat" -dog OR bird', "websearch_to_tsquery") == ("or", ("and", ("phrase", ["big", "cat"]), ("not", ("word", "dog"))), ("word", "bird"))
