import random

import numpy as np

from turnmill.llm.packing import best_fit, fit, pack, patterns, repeats


def test_fit():
    r = np.random.default_rng(1)
    a, x = r.random((30, 12)), np.maximum(r.normal(size=12), 0)
    assert np.allclose(fit(a, a @ x), x, atol=1e-6)
    y = fit(a, r.normal(size=30))
    assert (y >= 0).all()


def test_patterns_and_repeats():
    assert all(122 <= sum(p) <= 128 and len(p) <= 4 for p in patterns())
    h = np.random.default_rng(2).integers(0, 500, 129).astype(float)
    used = np.zeros(129)
    for p, n in repeats(h):
        for i in p:
            used[i] += n
    assert (used <= h).all() and used[40:].sum() > 0.6 * h[40:].sum()


def test_best_fit():
    boxes = best_fit([5, 5, 4, 3, 3, 0], 10)
    room = {}
    for b, s in zip(boxes, [5, 5, 4, 3, 3, 0]):
        room[b] = room.get(b, 0) + s
    assert max(room.values()) <= 10 and len(room) == 2
    assert best_fit([3, 3, 1], 10, [4, 3]) == [1, 0, 0] and best_fit([5], 10, [4]) == [1] and best_fit([], 10, [1]) == []


def test_pack(spark):
    r = random.Random(4)
    sizes = [int(r.lognormvariate(5.8, 1.1)) for _ in range(3000)] + [0, 1, 8192, 8193, 20_000, 16_384] + [600] * 1500
    df = spark.createDataFrame([(i, s, 7, "x") for i, s in enumerate(sizes)] + [(-1, None, 7, "x")], "id long, n long, size int, box string")
    got = pack(df, "id", "n").collect()
    held, whole = {}, {}
    for x in got:
        held[x["container"]] = held.get(x["container"], 0) + x["size"]
        whole.setdefault(x["item_id"], []).append((x["from_unit"], x["to_unit"], x["container"]))
    assert max(held.values()) <= 8192
    assert set(whole) == {-1, *range(len(sizes))}
    for i, s in enumerate(sizes):
        parts = sorted(whole[i])
        assert parts[0][0] == 0 and parts[-1][1] == s and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == max(1, -(-s // 8192))
    # Within half a hundredth of the fewest that can hold everything.
    assert len(held) <= 1.005 * (-(-sum(held.values()) // 8192)) + 1
    again = pack(df, "id", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_empty_and_tiny(spark):
    df = spark.createDataFrame([], "id long, n long")
    assert pack(df, "id", "n").collect() == []
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], "id string, n int")
    assert len({x["container"] for x in pack(df, "id", "n", capacity=64).collect()}) == 1
