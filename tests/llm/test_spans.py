import random

import numpy as np
import pytest

from turnmill.llm.spans import anchors, shared_parts, shared_spans


def brute(records, n):
    own = {}
    for k, t in records:
        for p in range(len(t) - n + 1):
            own.setdefault(t[p : p + n], set()).add(k)
    out = set()
    for k, t in records:
        spans = []
        for p in range(len(t) - n + 1):
            if len(own[t[p : p + n]]) > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + n
                else:
                    spans.append([p, p + n])
        out |= {(k, a, b) for a, b in spans}
    return out


def texts(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcd 😀é") for _ in range(r.randint(20, 90))) for _ in range(8)]
    out = [(i, "".join(r.choice(base) for _ in range(r.randint(1, 4)))) for i in range(40)]
    out += [(100, "ab" * 60), (101, "ab" * 40), (102, "a" * 90), (103, "x" + "a" * 70 + "y"), (104, out[0][1]), (105, ""), (106, "short"), (107, "zq" * 3 + out[1][1][5:60] + out[1][1][5:60])]
    return out


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (2, 20_000), (3, 2), (4, 5)])
def test_against_brute_force(spark, seed, group):
    rec = texts(seed)
    df = spark.createDataFrame([*rec, *rec[:7], (108, None)], "text_id long, body string").selectExpr("*", "1 as text", "2 as start", "'k' as subtree")
    got = shared_spans(df, ["text_id"], "body", min_len=40, prefix=12, max_group=group).collect()
    assert {(r["text_id"], r["span_start"], r["span_end"]) for r in got} == brute(rec, 40)
    assert len(got) == len(brute(rec, 40))


def test_anchor_in_every_run():
    r = random.Random(5)
    codes = np.array([r.randint(0, 3) for _ in range(3000)], np.uint32)
    at, _ = anchors(codes, 60, 20)
    for p in range(len(codes) - 60 + 1):
        assert ((at >= p) & (at <= p + 40)).any()
    assert len(at) < 3000 / 8


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert shared_spans(df, ["id"], "t").collect() == []
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh ") for _ in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long[1000:150_000]), (None, "n" * 200)], "id long, t string")
    got = {tuple(r) for r in shared_spans(df, ["id"], "t").select("id", "span_start", "span_end").collect()}
    assert got == {(1, 1000, 150_000), (2, 0, 149_000)}
    part = {r["id"]: r["shared_part"] for r in shared_parts(shared_spans(df, ["id"], "t"), ["id"]).collect()}
    assert part == {1: 0.745, 2: 1.0}
