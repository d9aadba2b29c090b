"""Registered queries against their SQL on odd rows that the given tables don't hold."""

import duckdb
import pytest

from check_queries import rows_of
from vellumine.workload import load

QUERIES, ORACLES = load()
ODD = [
    "Why?\n", "\nthe end", "\tin here\t", "éfrom here", "fromé", "nicht́", "　that　", "a? ", "a?\u0085", "a? ", "\u001fthe",
    "İn short", "ÎN", "_vs_", "a vsé b", "el?\r\n", None, "", " ", "the", "er\n", "von from", "what?\r",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "user", text) for i, text in enumerate(ODD) for t in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", ["query_intent", "intent_parameters"])
def test_intents_match_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{odd}/conversations.parquet/*.parquet'")
    df, cur = QUERIES[name](spark, odd), con.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
