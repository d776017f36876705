"""Every registered query against its SQL counterpart on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    yield con
    con.close()


def _sorted(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) & set(entry.oracle_sql())))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = _sorted(df.collect(), df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == _sorted(cursor.fetchall(), names)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_no_query_builds_all_pairs(spark):
    for name in ("subgraph_links", "hulls_at_point", "person_detail", "graph_stats", "match_attributes", "display_label"):
        plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
