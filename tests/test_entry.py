"""Every query that has SQL gives the same rows as the SQL, over the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from turnmill.functions.tokens import encoding
from turnmill.plans import catalogue

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


def plain(columns, rows):
    order = sorted(columns)
    return sorted(tuple(repr(dict(zip(columns, r, strict=True))[c]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, small, name):
    got, want = QUERIES[name](spark, small), con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.columns, map(tuple, got.collect())) == plain(columns, want.fetchall())


NO_SQL = sorted(n for n in set(QUERIES) - set(SQL) if n in catalogue.QUERIES)


@pytest.mark.parametrize("name", NO_SQL)
def test_runs(spark, small, name):
    """The same rows each time, none of them twice."""
    one, two = (sorted(map(repr, QUERIES[name](spark, small).collect())) for _ in range(2))
    assert one == two and len(set(one)) == len(one) > 0


def test_few_have_no_sql():
    assert set(NO_SQL) == {"semantic_by_cells", "fts_english", "hybrid_english", "token_counts"}


def test_rendered(spark, small):
    for name, stamped in (("rendered_with_stamps", True), ("rendered_plain", False)):
        for x in QUERIES[name](spark, small).collect():
            head, _, body = x["body"].partition("\n---\n")
            assert head.startswith(f"# {x['title']}\n") and f"**Number of Segments:** {x['n_cues']}" in head
            assert bool(re.search(r"^\[[0-9.]+ - [0-9.]+\] ", body, re.M)) == stamped


def test_sample(spark, small):
    got = QUERIES["chunk_sample"](spark, small).collect()
    texts = {(r["id"], r["text"]) for r in spark.read.parquet(f"{small}/fixed_chunks.parquet").select("id", "text").collect()}
    assert len(got) == 5 and all(any(i == x["id"] and (t or "").startswith((x["preview"] or "").removesuffix("...")) for i, t in texts) for x in got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_token_counts(spark, small):
    rows = QUERIES["token_counts"](spark, small).collect()
    d = spark.read.parquet(f"{small}/documents.parquet").select("source", "text").collect()
    e = encoding()
    assert sum(r["tokens"] for r in rows) == sum(len(e.encode_ordinary(x["text"] or "")) for x in d) and sum(r["texts"] for r in rows) == len(d)
