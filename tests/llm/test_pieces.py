import random

import numpy as np
import pytest

from turnmill.llm.pieces import cuts, pieces_of, split_oversized
from turnmill.functions.tokens import RANKS, encoding, splits


def check(text, limit, overlap):
    got, e = pieces_of(text, limit, overlap, 0.5, RANKS), encoding()
    n = len(e.encode_ordinary(text))
    assert bool(got) == (n > limit)
    at = 0
    for a, b, tokens, repeated, _ in got:
        assert a <= at < b and tokens == len(e.encode_ordinary(text[a:b])) <= limit
        assert a == 0 or repeated > 0
        at = b
    assert not got or at == len(text)
    return got


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    r = random.Random(seed)
    words = ["alpha", "beta,", "gamma.", "delta?", "\n", "\n\n", "\r\n", "  ", "日本語の文。", "été", "x" * 40, "12345", "😀", "　", "don't"]
    for _ in range(20):
        check(" ".join(r.choices(words, k=r.randint(0, 400))), r.choice([16, 40, 100]), 4)


def test_without_boundaries():
    assert check("a" * 5000, 64, 8) and check("日" * 3000, 64, 8) and check("\n" * 9000, 16, 4) and check("😀" * 900, 16, 2)


def test_natural_ends():
    text = "\n\n".join("One two three four five. Six seven eight nine ten." for _ in range(30))
    got = check(text, 60, 8)
    assert {k for *_, k in got[:-1]} == {"paragraph"} and got[-1][4] == "end"
    assert all(text[b : b + 2] == "\n\n" for _, b, *_ in got[:-1])
    text = " ".join("One two three four five. Six seven eight nine ten." for _ in range(30))
    assert {k for *_, k in check(text, 60, 8)[:-1]} == {"sentence"}


def test_cuts_are_the_greedy_ones():
    r = np.random.default_rng(3)
    n = 500
    successor = np.minimum(np.arange(n + 1) + r.integers(1, 9, n + 1), n)
    path, at = [0], 0
    while at < n:
        at = successor[at]
        path.append(at)
    assert cuts(successor).tolist() == path


def test_splits_are_the_tokenizers():
    for text in ("Hello  world's\n\n 42nd été, 日本語", "a  b\t\tc  ", ""):
        assert "".join(splits(text)) == text
        assert sum(len(encoding().encode_ordinary(x)) for x in splits(text)) == len(encoding().encode_ordinary(text))


def test_split_oversized(spark):
    body = "One two three four five. " * 300
    df = spark.createDataFrame([(1, body), (1, body), (2, "short"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "1 as piece_no", "'x' as piece")
    got = split_oversized(df, "doc_id", "text", limit=64, overlap=8).collect()
    assert {r["doc_id"] for r in got} == {1} and max(r["n_tokens"] for r in got) <= 64
    assert all(r["piece"] == body[r["start_char"] : r["end_char"]] for r in got)
    assert split_oversized(df.limit(0), "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        split_oversized(df, "doc_id", "text", limit=64, overlap=40)
