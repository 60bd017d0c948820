"""Counts over inequality joins: without the pairs, and the same as from the pairs."""

import datetime
import math
from decimal import Decimal

import pytest

from pelorus.database import Database
from pelorus.plans import queries

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def db(spark):
    db = Database(spark)
    x = [0.0, -0.0, NAN, NAN, INF, -INF, None, 1.5, 1.5, 2.0, -3.0, 7.0]
    day = datetime.date(2024, 1, 30)
    cells = lambda v, k: (k, k % 4, v, k % 5 if k % 6 else None, Decimal(k % 7) / 4, day + datetime.timedelta(k % 9), str(k % 11))
    kind = "{0}id long, {0}g int, {0}x double, {0}i int, {0}c decimal(9,2), {0}d date, {0}s string"
    db.attach("ta", spark.createDataFrame([cells(v, k) for k, v in enumerate(x)], kind.format("a")))
    db.attach("tb", spark.createDataFrame([cells(v, k) for k, v in enumerate([*x[::-1], 1.5, 2.5, None])], kind.format("b")))
    return db


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _both(db, text):
    """Rows and whether the pairs are avoided, compared with Spark's own plan."""
    ours, own = db.sql(text), db.spark.sql(text)
    assert ours.schema == own.schema
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, own.collect()))
    return "_theta_matches" in _plan(ours)


@pytest.mark.parametrize("column, op, key", [("x", "<", "aid"), ("x", "<=", "bid"), ("x", ">", "bid"), ("x", ">=", "aid"), ("i", "<", "bid"), ("c", "<=", "aid"), ("d", ">", "aid"), ("s", ">=", "bid")])
def test_same_as_from_the_pairs(db, column, op, key):
    assert _both(db, f"SELECT {key}, count(*) AS n FROM ta JOIN tb ON a{column} {op} b{column} GROUP BY {key}")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT count(*) AS n FROM ta JOIN tb ON ax < bx",
        "SELECT count(*) AS n FROM ta JOIN tb ON ax < bx WHERE aid < 0",
        "SELECT ag, 2 * count(1) + ag AS n, min(aid) AS a, max(ax) AS b, count(DISTINCT ai) AS c FROM ta JOIN tb ON bx - 1 > ax * 2 GROUP BY ag",
        "SELECT p.ag % 2 AS k, count(*) AS n FROM ta p, tb q WHERE p.ai >= q.bi AND q.bg = 1 AND p.aid <> 3 GROUP BY p.ag % 2 HAVING count(*) > 3 ORDER BY count(*) DESC",
        "SELECT p.aid, count(*) AS n FROM ta p JOIN ta q ON p.ax > q.ax GROUP BY p.aid",
        "SELECT t.n, u.aid FROM (SELECT aid, count(*) AS n FROM ta JOIN tb ON ax < bx GROUP BY aid) t JOIN ta u ON t.aid = u.aid",
        "WITH t AS (SELECT ag, count(*) AS n FROM ta JOIN tb ON ac < bc GROUP BY ag) SELECT p.ag, p.n, q.n AS m FROM t p JOIN t q ON p.ag = q.ag",
    ],
)
def test_other_forms(db, text):
    assert _both(db, text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT aid, count(*) AS n FROM ta LEFT JOIN tb ON ax < bx GROUP BY aid",
        "SELECT aid, bg, count(*) AS n FROM ta JOIN tb ON ax < bx GROUP BY aid, bg",
        "SELECT aid, count(*) AS n FROM ta JOIN tb ON ax < bx AND ag = bg GROUP BY aid",
        "SELECT aid, count(bx) AS n FROM ta JOIN tb ON ax < bx GROUP BY aid",
        "SELECT ag, sum(aid) AS n, count(*) AS m FROM ta JOIN tb ON ax < bx GROUP BY ag",
        "SELECT aid, count(*) AS n FROM ta JOIN (SELECT bg, sum(bx) AS s FROM tb GROUP BY bg) t ON ax < s GROUP BY aid",
        "SELECT aid, count(*) AS n FROM ta, tb WHERE ax < (SELECT sum(u.bx) FROM tb u WHERE u.bg = tb.bg) GROUP BY aid",
        "SELECT aid, count(*) FILTER (WHERE ag > 1) AS n FROM ta JOIN tb ON ax < bx GROUP BY aid",
        "WITH t AS (SELECT * FROM ta ORDER BY aid LIMIT 5) SELECT p.aid, count(*) AS n FROM t p JOIN t q ON p.ax < q.ax GROUP BY p.aid",
    ],
)
def test_left_to_spark(db, text):
    assert not _both(db, text)


def test_many_values_and_one_frequent_value(spark):
    """4.5e10 pairs: the values of both tables are many, and half of the asking rows share one."""
    db = Database(spark)
    n = 300_000
    db.attach("many", spark.range(n).selectExpr("id AS k", "IF(id % 2 = 0, 5D, CAST(id AS DOUBLE)) AS x"))
    db.attach("others", spark.range(n).selectExpr("CAST(id * id AS DOUBLE) AS y"))
    rows = db.sql("SELECT m.k, count(*) AS n FROM many m JOIN others o ON o.y < m.x GROUP BY m.k")
    assert "y#" not in "".join(x for x in _plan(rows).splitlines() if "Join Inner" in x and "<" in x)
    got = dict(map(tuple, rows.collect()))
    assert got == {k: 3 if k % 2 == 0 else math.isqrt(k - 1) + 1 for k in range(n)}


def test_registered_query_makes_no_pairs(spark):
    rows = queries.callables()["join_theta"](spark, "/root/testdata/sf0.001")
    assert not [x for x in _plan(rows).splitlines() if "Join Inner" in x and ">" in x]
