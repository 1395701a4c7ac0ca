import random

import pytest
from pyspark.sql import functions as F

from turnmill.operators.ordered import by_groups, following, numbered, running, runs, time_shard


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(v, None if r.random() < 0.02 else float(r.randint(0, 60)), i, r.choice(["a", "b", None]), r.choice([1, 2, None])) for v in ("x", "y", None) for i in range(150)]
    return sorted(out, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2]))


SCHEMA = "g string, t double, id long, word string, n long"


@pytest.mark.parametrize("seconds", [3, 1000])
def test_running(spark, rows, seconds):
    got = running(spark.createDataFrame(rows, SCHEMA), "g", ["t", "id"], time_shard("t", seconds), total=F.col("n")).collect()
    sums, want = {}, {}
    for g, _, i, _, n in rows:
        want[g, i] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + (n or 0)
    assert {(x["g"], x["id"]): x["total"] for x in got} == want


@pytest.mark.parametrize("seconds", [3, 1000])
def test_runs(spark, rows, seconds):
    got = runs(spark.createDataFrame(rows, SCHEMA), "g", ["t", "id"], time_shard("t", seconds), "word").collect()
    want = []
    for g, _, i, w, _ in rows:
        if want and want[-1][0] == g and want[-1][1] == w:
            want[-1][2:] = [want[-1][2] + 1, want[-1][3], i]
        else:
            want.append([g, w, 1, i, i])
    key = lambda x: (str(x[0]), x[3], x[4])
    assert sorted([[x["g"], x["word"], x["n"], x["first"]["id"], x["last"]["id"]] for x in got], key=key) == sorted(want, key=key)


def test_following(spark, rows):
    rows = [x for x in rows if x[0] == "x"]
    got = following(spark.createDataFrame(rows, SCHEMA), "g", ["t", "id"], time_shard("t", 5), 4, F.coalesce("word", F.lit("-")), "four", block=6).collect()
    words = [x[3] or "-" for x in rows]
    assert {x["id"]: x["four"] for x in got} == {x[2]: " ".join(words[k : k + 4]) for k, x in enumerate(rows)}


def test_numbered(spark):
    df = spark.createDataFrame([(f"x{i * 37 % 101:03d}", i) for i in range(101)] + [(None, 7)], "k string, v int").repartition(5)
    got = sorted((r["n"], r["k"] or "") for r in numbered(df, ["k"], "n").collect())
    assert got == list(enumerate(sorted(r["k"] or "" for r in df.collect()), 1))
    assert numbered(df.limit(0), ["k"], "n").collect() == []


def test_by_groups_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i % 9, i, float(i)) for i in range(100)] + [(50, i, 0.0) for i in range(40)], "k long, i int, x double")
        got = by_groups(df, ["k"], ["i"], lambda pdf: pdf.iloc[:1][["k"]].assign(n=len(pdf), first=pdf["i"].iloc[0], sorted=bool(pdf["i"].is_monotonic_increasing)), "k long, n long, first int, sorted boolean").collect()
        assert sorted(map(tuple, got)) == [(k, len(range(k, 100, 9)), k, True) for k in range(9)] + [(50, 40, 0, True)]
        assert by_groups(df.limit(0), ["k"], ["i"], lambda pdf: pdf, "k long, i int, x double").collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
