import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
QUICK = ["weighted_like_search", "finance_search", "domain_rescore_topk", "seniority_extract", "location_components", "cooccurrence_pmi", "expansion_topk", "multi_hop_expansion", "relationship_score", "transition_matrix", "multi_aspect_topk", "upsert_touch", "record_hash_dedup"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    key = lambda rows: sorted(map(repr, rows))
    want = c.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]}) q").fetchall()
    have = [tuple(r) for r in got.select(*cols).collect()]
    f = lambda rows: [tuple(round(float(x), 4) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows]
    assert key(f(have)) == key(f(want))


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
