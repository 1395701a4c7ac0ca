import random

from pyspark.sql import functions as F

from turnmill.llm import titles as T
from turnmill.llm.titles import best_titles

LISTED = [
    (1, "Sharing Warranty Vessels"), (2, "Drafting Concise Platforms 2022"), (3, "Drafting Concise Platforms 2023"), (4, "Ask the Bench - Guarding Routine Retainers"), (5, "Ask the Bench - Mapping Prompt Stamps"),
    (6, "Repairing Encrypted Warehouses: A Field Guide for Panelists (Hulie Yortesk, Rukliwick; Brear Gorrave, Fenmilux)"), (7, "Budgeting Floor Claims: The Minor Signing Nobody Planned"), (8, "Sharing Warranty Vessels"),
]
TYPED = {
    "sharing warranty vessels": 1, "Re: Shаring Wаrrаnty Vеssеls": 1, "Shaing Warranty Vessls": 1, "Sharing Warra…": 1, "transcript_4_sharing_warranty_vessels": 1, "Sharing Warranty Vessels.mp4": 1, "Warranty Vessels": 1,
    "DRAFTING CONCISE PLATFORMS 2023": 3, "drafting_concise_platforms_2022": 2, "Guarding Routine Retainers": 4, "Ask the Bench - Grievance Batches": 0, "Repairing Encrypted Warehouses": 6,
    "The Minor Signing Nobody Planned - Budgeting Floor Claims": 7, "Budgeting F100r C1aims": 7, "Budg. Floor Cla. The Minor Signing Nobody Planned": 7, "Frame Your Venue": 0, "Recording 2022-02-18": 0, "untitled": 0, "日本": 0, "???": 0, "BudgetingFloorClaims": 7,
}


def test_best_titles(spark):
    listed = spark.createDataFrame([*LISTED, (9, None)], "title_id long, title string").selectExpr("*", "1 as value", "'x' as _core")
    typed = spark.createDataFrame([(x, 1) for x in [*TYPED, *TYPED, None, "  ", "\t\n", "Sharing Warranty Vessels", "x" * 20_000]], "t string, title_id int")
    got = {r["value"]: r["title_id"] for r in best_titles(typed, "t", listed, "title_id", "title").collect()}
    assert got == {**TYPED, "x" * 20_000: 0}


def test_empty(spark):
    listed = spark.createDataFrame(LISTED, "title_id long, title string")
    typed = spark.createDataFrame([("Sharing Vesels",)], "t string")
    assert best_titles(typed.limit(0), "t", listed, "title_id", "title").collect() == []


def test_no_list(spark):
    listed = spark.createDataFrame([], "title_id long, title string")
    typed = spark.createDataFrame([("Sharing Vesels",)], "t string")
    assert [tuple(r) for r in best_titles(typed, "t", listed, "title_id", "title").collect()] == [("Sharing Vesels", 0)]


def test_prefix_filter_loses_nothing(spark, small):
    """Every typed value is compared with every entry, without the filter."""
    import re

    from turnmill.llm.queries import p2_found
    from turnmill.llm.titles import LOOK, folded, squeezed, without_affixes

    listed = spark.read.parquet(f"{small}/transcript_titles.parquet")
    typed = spark.read.parquet(f"{small}/insight_quotes.parquet").select("transcript_title").distinct()
    plain = {r[0]: r[1] for r in typed.where("transcript_title is not null").select("transcript_title", squeezed(without_affixes(folded("transcript_title")))).collect()}
    entries = [r[0] for r in listed.select(squeezed(folded("title"))).collect()]
    triples = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    far = {x for x, s in plain.items() if len(s) > 2 and all(len(triples(s) & triples(e)) < LOOK * len(triples(s)) for e in entries)}
    got = {r["value"]: r["title_id"] for r in best_titles(typed, "transcript_title", listed, "title_id", "title").collect()}
    assert all(got[x] == 0 for x in far if x in got)
    ids = {r["title"]: r["title_id"] for r in listed.collect()}
    for value, title_id in got.items():
        same = [i for t, i in ids.items() if re.sub(r"\W", "", t).lower() == re.sub(r"\W", "", value).lower()]
        assert not same or title_id in same
    assert p2_found(spark, small).where("title_id > 0").count() > 0


def test_prefixes_lose_no_pair(spark):
    """Of values without a series: all pairs by the plain predicate, over all values and forms."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 5)))
    listed = [(i, " ".join(word() for _ in range(r.randint(1, 5)))) for i in range(60)]
    typed = [" ".join(w for w in t.split() if r.random() < 0.7) + r.choice(["", " " + word(), " x"]) for _, t in listed] + [word() for _ in range(40)]
    entries = T._list_side(spark.createDataFrame(listed, "k long, t string"), "k", "t").cache()
    values = spark.createDataFrame(list(enumerate(dict.fromkeys(typed))), "_id long, v string").select("_id", F.lit(False).alias("_without"), T.triples(T.squeezed(F.col("v"))).alias("_core")).cache()
    got = {tuple(x) for x in T._alike(values, entries).collect()}
    forms = [(e["title_id"], set(f)) for e in entries.collect() for f in e["_forms"]]
    want = {(v["_id"], k) for v in values.collect() if v["_core"] for x in [set(v["_core"])] for k, f in forms if len(x & f) >= T.LOOK * len(x) and len(x & f) >= T.ALIKE * len(x | f)}
    assert want <= got and len(got) < 60 * len(set(typed)) / 2
