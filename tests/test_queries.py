"""Every registered graph query against its SQL: all on the smallest tables, those that go round by round on larger ones too."""

from __future__ import annotations

import datetime

import duckdb
import pytest

from kgloom.plans import catalog

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients "
    "client_changes vendors items stamps").split()
ITERATIVE = ["transitive_deps", "blast_radius", "relevance_score", "scc", "impact_percent", "neighborhood_both", "entity_clusters", "merge_chain_edges",
    "ingest_edges", "ingest_properties"]


@pytest.fixture(scope="module")
def duck():
    cons = {}
    for data in (DATA, LARGER):
        cons[data] = duckdb.connect()
        for t in TABLES:
            cons[data].sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return cons


def plain(v):
    if isinstance(v, float) or hasattr(v, "is_finite"):
        return round(float(v), 7)  # one more than any column states
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def compare(spark, con, data, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    own = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    other = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert own == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck[DATA], DATA, name)


@pytest.mark.parametrize("name", ITERATIVE)
def test_iterative_query_on_larger_tables(spark, duck, name):
    compare(spark, duck[LARGER], LARGER, name)
