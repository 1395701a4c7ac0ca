import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnmill.functions.metrics import EVALUATORS, evaluator, precision, recall, reciprocal_rank
from turnmill.operators import search as S
from turnmill.plans import search as P


def vectors(n, width, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, width))
    return [(i, (centres[i % 12] + 0.5 * r.normal(size=width)).tolist()) for i in range(n)]


def test_vector_topk(spark):
    rows = vectors(300, 8, 1) + [(300, [0.0] * 8), (301, None), (302, [])] + [(303, vectors(300, 8, 1)[0][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = S.vector_topk(df.where("id % 20 = 0"), "id", "v", df, "id", "v", 5, block=37).collect()
    m = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    for q in [i for i in m if i % 20 == 0]:
        best = sorted(m, key=lambda i: (-round(float(m[q] @ m[i]), 6), i))[:5]
        assert [x["id"] for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == best


def test_index_recall(spark):
    """Against brute force, every row indexed."""
    df = spark.createDataFrame(vectors(3000, 16, 2), "id long, v array<double>")
    exact = {(x["query_id"], x["id"]) for x in S.vector_topk(df.where("id % 20 = 0"), "id", "v", df, "id", "v", 10).collect()}
    found = {(x["query_id"], x["id"]) for x in S.vector_topk_by_cells(df.where("id % 20 = 0"), "id", "v", df, "id", "v", 10, S.cells(df, "v", 24), probes=8).collect()}
    assert len(found) == len(exact) and len(exact & found) / len(exact) >= 0.9


def test_index_recall_on_given_vectors(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    exact = {(x["query_id"], x["id"]) for x in S.vector_topk(q, "vec_id", "embedding", e, "vec_id", "embedding", 10).collect()}
    found = {(x["query_id"], x["id"]) for x in S.vector_topk_by_cells(q, "vec_id", "embedding", e, "vec_id", "embedding", 10, S.cells(e, "embedding", 32), probes=20).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_text_matches(spark):
    docs = spark.createDataFrame([(1, "The red fox saw a red dog"), (2, "A dog, red as a fox; the dog slept"), (3, "cat"), (4, None), (5, ""), (6, "été fox ÉTÉ")], "id long, text string")
    ask = {1: "red dog", 2: '"red dog"', 3: "dog -slept", 4: "cat OR fox", 5: "", 6: "the of", 7: "zebra", 8: "Été", 9: None, 10: "aaaa" * 250, 11: '"" - -fox cat', 12: "red or"}
    q = spark.createDataFrame(list(ask.items()), "qid long, q string")
    got = {}
    for x in S.text_matches(q, "qid", "q", docs, "id", "text").collect():
        got.setdefault(x["query_id"], {})[x["id"]] = (x["tf_score"], x["cover_score"])
    assert {k: set(v) for k, v in got.items()} == {1: {1, 2}, 2: {1}, 3: {1}, 4: {1, 2, 3, 6}, 8: {6}, 11: {3}, 12: {1, 2}}
    assert got[8][6] == (0.666667, 0.2)
    # Covers of red and dog in document 1: words 5..6; in 2: 1..2 and 2..7 (four other words).
    assert got[1][1] == (0.428571, 0.1) and got[1][2] == (0.333333, round(0.1 + 0.1 / 5, 6))


def _brute_matches(asked, texts):
    """Best scores of ``(words needed, phrase, word barred)`` alternatives by trying every stretch."""
    out = {}
    for q, alternatives in asked.items():
        for d, words in texts.items():
            for needs, phrase, bar in alternatives:
                if not needs <= set(words) or bar in words or f" {phrase} " not in f" {' '.join(words)} ":
                    continue
                holds = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if needs <= set(words[a : b + 1])]
                covers = [(a, b) for a, b in holds if not any((c, e) != (a, b) and a <= c and e <= b for c, e in holds)]
                cover = sum(0.1 / (1 + max(b - a + 1 - len(needs), 0)) for a, b in covers)
                tf, old = sum(w in needs for w in words) / len(words), out.get((q, d), (0, 0))
                out[q, d] = max(old[0], round(tf, 6)), max(old[1], round(cover, 6))
    return out


@pytest.mark.parametrize("block", [200, S.ASKED])
def test_text_matches_stay_where_they_are_read(spark, block):
    """Against brute force, with queries in any blocks; no document meets queries in a join, and
    only the best of a task are passed on where the best are asked for."""
    r = random.Random(block)
    word = lambda: "word" + r.choice("abcdefgh")
    texts = {i: [word() for _ in range(r.randint(1, 11))] for i in range(150)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id long, text string").repartition(3)
    asked, lines = {}, []
    for q in range(25):
        a, b, c, bar, d = (word() for _ in range(5))
        lines.append((q, f'"{a} {b}" {c} -{bar} OR {d}'))
        asked[q] = [({a, b, c}, f"{a} {b}", bar), ({d}, d, None)]
    queries = spark.createDataFrame(lines, "q long, ask string")
    every = S.text_matches(queries, "q", "ask", docs, "id", "text", block=block)
    assert "Join" not in every._jdf.queryExecution().toString()
    want = _brute_matches(asked, texts)
    assert {(x["query_id"], x["id"]): (x["tf_score"], x["cover_score"]) for x in every.collect()} == want
    for at, score in enumerate(("tf_score", "cover_score")):
        few = S.text_matches(queries, "q", "ask", docs, "id", "text", best=(score, 4), block=block)
        got = {(x["query_id"], x["rank"]): (x["id"], x[score]) for x in S.ranked(few, "query_id", score, "id", 4).collect()}
        for q in range(25):
            top = sorted((-v[at], d) for (p, d), v in want.items() if p == q)[:4]
            assert [got.get((q, i)) for i in range(1, 5)] == [(d, -v) for v, d in top] + [None] * (4 - len(top))
        # An alternative may be its query's only one in a block.
        assert few.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * 4 * (1 if block == S.ASKED else 2)


def test_scores_are_rounded_as_by_spark(spark):
    x = [i / n for n in (64, 128, 640, 1280, 3) for i in range(1, n)] + [0.0000005, 0.1 + 0.1 / 3, 2.5000005, 12.3456785]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert S._half_up(np.asarray(x)).tolist() == want


def test_text_matches_of_names_that_are_texts(spark):
    docs = spark.createDataFrame([("b", "fox"), ("a", "fox"), (None, "fox"), ("c", "a fox"), ("é", "fox fox")], "id string, text string")
    q = spark.createDataFrame([(None, "fox"), ("x", "fox or dog"), ("x", "dog")], "q string, ask string")
    got = S.ranked(S.text_matches(q, "q", "ask", docs, "id", "text", best=("cover_score", 3)), "query_id", "cover_score", "id", 3).collect()
    assert sorted((x["query_id"] or "", x["rank"], x["id"]) for x in got) == [(q, i + 1, d) for q in ("", "x") for i, d in enumerate("éab")]


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, id long, similarity double, rank int")
    t = spark.createDataFrame([(1, 11, 0.5, 1), (1, 10, 0.4, 2), (1, 12, 0.3, 3)], "query_id long, id long, tf double, rank int")
    got = S.fuse_ranks(v, t, "tf", 3).orderBy("rank").collect()
    assert [(x["id"], x["hybrid_score"]) for x in got] == [(10, round(1 / 61 + 1 / 62, 9)), (11, round(1 / 61 + 1 / 62, 9)), (12, round(1 / 63, 9))]
    assert got[2]["similarity_score"] == 0
    got = S.fuse_pseudo_ranks(v, t, "tf", 2).orderBy("rank").collect()
    assert got[0]["id"] == 11 and len(got) == 2
    assert [x["id"] for x in S.fuse_weighted(v, t, "tf", 3).orderBy("rank").collect()] == [10, 11, 12]
    assert S.fuse_ranks(v.limit(0), t.limit(0), "tf", 3).collect() == []


def test_metrics(spark):
    cases = [(["a", "b", "c"], ["a", "b", "d"], 1.0, 2 / 3, 2 / 3), (["a", "b", "c"], ["b", "d"], 0.5, 0.5, 1 / 3), ([], ["a"], 0.0, 0.0, 0.0), (["a"], [], 0.0, None, 0.0), (None, ["a"], 0.0, 0.0, 0.0), (["a", "b"], ["x"], 0.0, 0.0, 0.0), (["b"], ["b", "b"], 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, o array<string>, e array<string>, m double, r double, p double")
    o, e = F.col("o"), F.col("e")
    for x in df.select("*", reciprocal_rank(o, e).alias("m2"), recall(o, e).alias("r2"), precision(o, e).alias("p2")).collect():
        assert (x["m"], x["r"], x["p"]) == (x["m2"], x["r2"], x["p2"])

    @evaluator("found_any")
    def found_any(o, e):
        return F.arrays_overlap(o, e).cast("double")

    assert df.select(EVALUATORS.pop("found_any")(o, e).alias("x")).first()["x"] == 1.0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_index_recall_with_a_third_of_the_cells(spark, scale):
    folder = f"/root/testdata/{scale}"
    exact = {(x["query_id"], x["vec_id"]) for x in P.semantic_topk(spark, folder).collect()}
    found = {(x["query_id"], x["vec_id"]) for x in P.semantic_by_cells(spark, folder).where("query_id <> vec_id").collect()}
    nearest = {(x["query_id"], x["vec_id"]) for x in P.semantic_topk(spark, folder).where("rank <= 9").collect()}
    assert len(found) == len(nearest) and len(found & exact) >= 0.9 * len(nearest)


def test_parts_of_cells_change_nothing(spark):
    df = spark.createDataFrame([*vectors(500, 6, 3), (500, None), (501, [0.0] * 6), (502, [])], "id long, v array<double>")
    centres = S.cells(df.where("v is not null"), "v", 8)
    one, many = ([tuple(x) for x in S.vector_topk_by_cells(df.where("id % 5 = 0"), "id", "v", df, "id", "v", 4, centres, 3, most=m).orderBy("query_id", "rank").collect()] for m in (10_000, 7))
    assert one == many and len({x[0] for x in one}) == 100


def test_vectors_of_nothing(spark):
    df = spark.createDataFrame(vectors(20, 4, 3), "id long, v array<double>")
    assert S.vector_topk(df.limit(0), "id", "v", df, "id", "v", 3).collect() == []
    assert S.vector_topk(df, "id", "v", df.limit(0), "id", "v", 3).collect() == []
    assert len(S.vector_topk(df, "id", "v", df, "id", "v", 50).collect()) == 400
    named = df.selectExpr("concat('v', id) as id", "v")
    assert {x["id"] for x in S.vector_topk(named, "id", "v", named, "id", "v", 1).collect()} == {f"v{i}" for i in range(20)}


def test_rows_of_vectors_are_in_no_exchange(spark, small):
    plan = P.semantic_topk(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert not any("embedding" in x for x in plan.split("\n") if "Exchange" in x)


def test_english(spark):
    docs = spark.createDataFrame([(1, "She trains the trainers"), (2, "Training and signing of forms"), (3, "A train station"), (4, "the of and"), (5, None)], "id long, text string")
    ask = {1: "trained", 2: '"signed form"', 3: "training -forms", 4: "stations OR signs", 5: "the", 6: None}
    q = spark.createDataFrame(list(ask.items()), "qid long, q string")
    found = lambda **k: {(x["query_id"], x["id"]) for x in S.text_matches(q, "qid", "q", docs, "id", "text", **k).collect()}
    # "of" stands between, so that the phrase is not in document 2.
    assert found(english=True) == {(1, 1), (1, 2), (1, 3), (3, 1), (3, 3), (4, 2), (4, 3)}
    assert found() == set()
    assert {x for x in found(parse=S.plain_query, english=True) if x[0] == 3} == {(3, 2)}


def test_hybrid_search_of_one_question(spark):
    docs = spark.createDataFrame([(1, "the form is signed", [1.0, 0.0]), (2, "a vote", [0.0, 1.0]), (3, "sign the form", [0.6, 0.8])], "id long, text string, v array<double>")
    one = spark.createDataFrame([(7, "form", [1.0, 0.0])], "q long, ask string, qv array<double>")
    got = S.hybrid_search(one, "q", "ask", "qv", docs, "id", "text", "v", 2).orderBy("rank").collect()
    assert [(x["id"], x["rank"]) for x in got] == [(1, 1), (3, 2)] and got[0]["hybrid_score"] == round(2 / 61, 9)
    text_only = one.withColumn("qv", F.lit(None).cast("array<double>"))
    assert {x["id"] for x in S.hybrid_search(text_only, "q", "ask", "qv", docs, "id", "text", "v").collect()} == {1, 3}
    assert S.hybrid_search(one.limit(0), "q", "ask", "qv", docs, "id", "text", "v").collect() == []


def test_registered_measure_is_in_the_means(spark, small):
    @evaluator("any_found")
    def any_found(o, e):
        return F.arrays_overlap(o, e).cast("double")

    try:
        row = P.metrics_overall(spark, small).first()
        assert 0 < row["any_found_mean"] <= 1 and "any_found_std" in row
        assert "any_found_mean" in P.metrics_by_group(spark, small).columns
    finally:
        EVALUATORS.pop("any_found")
