"""Queries that show an operator give a row for every row of their table."""

import os

import pytest

from pelorus.plans import queries
from pelorus.sources.tables import scan

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
KEYS = {
    "arithmetic": ("lineitem", "l_orderkey", "l_linenumber"),
    "timezones": ("events", "event_id"),
    "intervals": ("orders", "o_orderkey"),
    "fn_strings": ("customer", "c_custkey"),
    "fn_rounding": ("lineitem", "l_orderkey", "l_linenumber"),
    "fn_decimals": ("orders", "o_orderkey"),
    "fn_date_trunc": ("orders", "o_orderkey"),
    "json_functions": ("events", "event_id"),
    "json_changes": ("events", "event_id"),
}


@pytest.mark.parametrize("name", KEYS)
def test_every_row(spark, name):
    table, *keys = KEYS[name]
    got = sorted(map(tuple, queries.callables()[name](spark, FOLDER).select(*keys).collect()))
    assert got == sorted(map(tuple, scan(spark, FOLDER, table).select(*keys).collect()))


def test_theta_join_of_whole_tables(spark):
    balances = [r[0] for r in scan(spark, FOLDER, "supplier").select("s_acctbal").collect()]
    parts = scan(spark, FOLDER, "part").select("p_partkey", "p_retailprice").collect()
    want = {p: n for p, price in parts if (n := sum(b > price * 5 for b in balances))}
    got = {r.p_partkey: r.n for r in queries.callables()["join_theta"](spark, FOLDER).collect()}
    assert got == want and max(got) >= 50
