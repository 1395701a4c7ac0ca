import random

import pytest

from turnmill.operators.intervals import coverage


def brute(rows):
    out = set()
    for v in {r[0] for r in rows if r[0] is not None}:
        periods = []
        for _, a, b in sorted(r for r in rows if r[0] == v and r[1] is not None and r[2] is not None and r[1] < r[2]):
            if periods and a <= periods[-1][1]:
                periods[-1][1] = max(b, periods[-1][1])
            else:
                periods.append([a, b])
        out |= {(v, "period", a, b) for a, b in periods}
        out |= {(v, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:])}
    return out


@pytest.mark.parametrize("shard", [1, 7, 50, 600_000])
def test_against_brute_force(spark, shard):
    r = random.Random(shard)
    rows = []
    for _ in range(600):
        a = r.choice([None, *range(-50, 900)]) if r.random() < 0.1 else r.randint(-50, 900)
        b = None if r.random() < 0.05 or a is None else a + r.randint(-3, r.choice([1, 8, 60]))
        rows.append((r.choice([1, 1, 1, 2, 3, None]), a, b))
    rows += rows[:100]
    df = spark.createDataFrame([(*x, 5, "y") for x in rows], "video long, a long, b long, kind int, _start string")
    got = coverage(df, "video", "a", "b", shard).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == brute(rows)


def test_empty(spark):
    assert coverage(spark.createDataFrame([], "v long, a long, b long"), "v", "a", "b").collect() == []


def test_touching_over_a_shard_boundary(spark):
    df = spark.createDataFrame([(1, 0, 600_000), (1, 600_000, 600_001), (1, 600_002, 1_800_000)], "v long, a long, b long")
    assert sorted(map(tuple, coverage(df, "v", "a", "b").collect())) == [(1, "gap", 600_001, 600_002), (1, "period", 0, 600_001), (1, "period", 600_002, 1_800_000)]
