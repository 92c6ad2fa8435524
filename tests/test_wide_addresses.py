"""Network queries against their SQL on addresses that differ from the networks' in other octets than the last two."""

import duckdb
import pytest

import __spark_entry__

QUERIES = ["allowlist_anti_join", "asn_label", "geo_enrich", "drop_allowlisted", "ip_in_net"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The networks' own users, and the same again with 65,536 and 131,072 more."""
    path = tmp_path_factory.mktemp("wide")
    made = duckdb.connect()
    made.execute(f"""copy (select i as event_id, timestamp '2024-01-02' + interval 1 second * i as ts, i * 7 % 1500 + 65536 * (i // 7 % 3) as user_id,
      ['error', 'click', 'signup'][i % 4 % 3 + 1] as event_type, 0.0 as value, null::varchar as props from range(6000) r(i)) to '{path}/events.parquet'""")
    made.execute(f"copy (from '/root/testdata/sf0.001/nation.parquet') to '{path}/nation.parquet'")
    return str(path)


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, tables, name):
    db = duckdb.connect()
    for table in ("events", "nation"):
        db.execute(f"create view {table} as from '{tables}/{table}.parquet'")
    cursor = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(r)) for r in __spark_entry__.queries()[name](spark, tables).select(columns).collect())
    assert got == want and len(want) > 400
