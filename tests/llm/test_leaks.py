import random

from turnmill.llm.leaks import leaked_passages, words


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["Alpha", "beta", "GAMMA", "delta", "ÉTÉ", "zwölf", "7", "42"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 14)))) for i in range(30)] + [(30, None), (31, ""), (None, "beta beta beta beta")]
    docs = [(d, r.choice([" ", "\n", " - ", "​, ", "_"]).join(r.choices([w.upper() for w in vocabulary] + vocabulary, k=r.randint(0, 60)))) for d in range(60)] + [(60, None), (61, ""), (3, "beta beta beta beta")]
    dd = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as start")
    ii = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    for most in (10, 1_000_000):
        got = leaked_passages(dd, "doc_id", "text", ii, "item_id", "text", n_words=4, max_chars=most).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == brute(docs, items, 4)
        text = dict(docs)
        for x in got:
            if x["doc_id"] != 3:
                assert len(words(text[x["doc_id"]][x["start"] : x["end"]])) >= 4
    assert leaked_passages(dd.limit(0), "doc_id", "text", ii, "item_id", "text").collect() == []
    assert leaked_passages(dd, "doc_id", "text", ii.limit(0), "item_id", "text").collect() == []


def test_changed_dress_and_place(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    doc = "Intro. ONE-two  three*four* five\nsix seven, eight nine «ten» eleven twelve İ thirteen"
    doc2 = "xx İstanbul " + item.title() + "! end"
    dd = spark.createDataFrame([(1, doc), (2, doc2), (3, "pad " * 100_000 + item)], "doc_id long, text string")
    ii = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaked_passages(dd, "doc_id", "text", ii, "item_id", "text").collect()}
    assert set(got) == {2, 3}
    assert doc2[got[2]["start"] : got[2]["end"]] == item.title()
    assert got[3]["start"] == 400_000
