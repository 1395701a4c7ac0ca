import random

from turnmill.operators import groundtruth as G
from turnmill.plans.groundtruth import word_overlap_80

TEXT = "The host told the clerk to sign the form early. It took nine weeks to file the annex, and the board still had doubts. Nobody at Zanlix had read the minutes before the vote was called."
CASES = {
    "exact": ("told the  clerk to sign the form early. It", ("exact", "high")),
    "no dots": ("The host told the clerk … to sign the form early", ("partial", "high")),
    "opening": ("nine weeks to file the annex, and the board still had trouble with it", ("partial", "medium")),
    "part": ("zzz yyy xxx www vvv uuu … Nobody at Zanlix had read the minutes before the vote", ("partial", "medium")),
    "five words": ("all of them to file the annex soon", ("not_found", "low")),
    "five whole words": ("xx weeks to file the annex, and xx", ("partial", "medium")),
    "missing": ("completely different words that nobody has ever said at all", ("not_found", "low")),
    "empty": ("", ("not_found", "low")),
    "null": (None, ("not_found", "low")),
    "short": ("the form", ("exact", "high")),
    "short, missing": ("the forms", ("not_found", "low")),
}


def test_ladder(spark):
    q = spark.createDataFrame([(k, v[0], 1) for k, v in CASES.items()], "id string, q string, tid int")
    t = spark.createDataFrame([(TEXT,), (TEXT,), (None,), ("",)], "text string")
    got = {x["quote_id"]: (x["match_type"], x["confidence"]) for x in G.graded_quotes(q, "id", "q", t, "text").collect()}
    assert got == {k: v[1] for k, v in CASES.items()}


def test_most_sentences_in_one_text(spark):
    quote = "So he said on the day. The board met in May and sat for an hour. The clerk then left the room for good. Nothing else was said"
    q = spark.createDataFrame([("q", quote)], "id string, q string")
    part = "So he said on the day or so. we think the board met in may and sat for an hour, the clerk then left the room for good"
    got = G.graded_quotes(q, "id", "q", spark.createDataFrame([(part,)], "text string"), "text").first()
    assert got["match_type"] == "partial"


def test_located_against_contains(spark, small):
    c = [r["text"] for r in spark.read.parquet(f"{small}/fixed_chunks.parquet").collect()]
    phrases = [t[i : i + n] for t in c for i, n in ((3, 60), (40, 90), (0, len(t)))] + ["no such words are in any of the texts", ""]
    p = spark.createDataFrame(list(enumerate(phrases)), "pid long, p string")
    t = spark.createDataFrame(list(enumerate(c)), "tid long, t string")
    got = {(x["phrase_id"], x["text_id"]) for x in G.located(p, "pid", "p", t, "tid", "t").collect()}
    assert got == {(i, j) for i, x in enumerate(phrases) for j, y in enumerate(c) if x and x in y}


def test_located_of_any_length(spark):
    """Phrases of one to nine words, cut anywhere, against plain containment."""
    r = random.Random(9)
    c = [" ".join(r.choices(["a", "the", "room.", "rooms", "form", "(x)", "été", "unforeseen", "one,two"], k=r.randint(1, 25))) for _ in range(60)]
    phrases = sorted({x for t in c for n in (1, 2, 4, 7, 9, 13, 18, 24, 30) for i in [r.randrange(len(t))] if (x := t[i : i + n].strip())} | {"for the", "none", "he a", "m. r"})
    got = G.located(spark.createDataFrame([(x, x) for x in phrases], "i string, p string"), "i", "p", spark.createDataFrame(list(enumerate(c)), "tid long, t string"), "tid", "t").collect()
    want = {(x, j) for x in phrases for j, y in enumerate(c) if x in y}
    assert {len(x.split()) for x, _ in want} >= {1, 2, 3, 4, 5, 6} and len(got) == len(want) and {tuple(x) for x in got} == want


def test_short_sentences_and_literals_count(spark):
    text = "we think the board met in may. the clerk then left the room. she signed it twice. he said \"sign here now\" and went"
    q = {"sentences": "Something nobody has ever said here. The clerk then left the room. She signed it twice. The board met in May. xx", "literal": "zzz yyy \"sign here now\" xxx www"}
    got = G.graded_quotes(spark.createDataFrame(list(q.items()), "id string, q string"), "id", "q", spark.createDataFrame([(text,)], "text string"), "text").collect()
    assert {x["quote_id"]: (x["match_type"], x["confidence"]) for x in got} == {"sentences": ("partial", "medium"), "literal": ("partial", "low")}


def test_titles(spark):
    listed = spark.createDataFrame([(1, "Scaling Toggles: How to"), (2, "Scaling"), (3, "Other")], "k long, t string")
    typed = spark.createDataFrame([("TRANSCRIPT 2: scaling toggles: how to",), ("Scaling Toggles",), ("none",), ("  ",), (None,)], "v string")
    for most in (10_000, 2):
        got = {x["value"]: (x["title_id"], x["how"]) for x in G.resolved_titles(typed, "v", listed, "k", "t", most).collect()}
        assert got == {"TRANSCRIPT 2: scaling toggles: how to": (1, "exact"), "Scaling Toggles": (1, "partial"), "none": (None, "transcript_not_found")}


def test_chunks_of_quotes(spark):
    q = spark.createDataFrame([(1, "told the clerk to sign the form early. And more", "My Title: A"), (2, "told the clerk to sign the form early. And more", "Else"), (3, "", "My Title A"), (4, None, None), (5, "A form", "Else"), (6, "the board", "Else")], "quote_id long, quoted_text string, transcript_title string")
    c = spark.createDataFrame([(7, "He told the clerk to sign the form early. And mores", "my title a (B)"), (8, TEXT, "Else"), (9, "x", None)], "id long, text string, title string")
    assert sorted(tuple(x) for x in G.chunks_of_quotes(q, c).collect()) == [(1, 7), (6, 8)]


def overlaps(q, c):
    """By brute force, of ids with texts."""
    sets = lambda x: {i: set((t or "").lower().split()) for i, t in x}
    return {(i, j, (2000 * len(a & b) // len(a) + 1) // 2 / 10) for i, a in sets(q).items() for j, b in sets(c).items() if a and len(a & b) / len(a) >= 0.7995}


def test_word_overlaps_against_brute_force(spark):
    """Words in any order, altered every few words, repeated, few or unknown ones."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    c = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 45)))) for i in range(80)] + [(80, None), (81, " ")]
    q = [(i, " ".join(r.choices([*vocabulary, "none"], k=r.randint(1, 12)))) for i in range(120)]
    q += [(200 + i, " ".join("x" if k % 6 == 5 else w for k, w in enumerate(t.split()))) for i, (_, t) in enumerate(c[:80])] + [(400, None), (401, "")]
    got = G.word_overlaps(spark.createDataFrame(q, "q long, p string"), "q", "p", spark.createDataFrame(c, "c long, t string"), "c", "t", letters=1500).collect()
    want = overlaps(q, c)
    assert len(got) == len(want) > 100 and {tuple(x) for x in got} == want


def test_word_overlap_of_an_altered_and_a_short_quote(spark, tmp_path):
    spark.createDataFrame([(1, "i", "He told the clerk X to sign the X form early. It took X nine", "t"), (2, "i", "sign the form", "t")], "quote_id long, insight_id string, quoted_text string, transcript_title string").write.parquet(f"{tmp_path}/insight_quotes.parquet")
    spark.createDataFrame([(7, "And he told the clerk to sign the form early. It took nine weeks", "t"), (8, "sign here", "t")], "id long, text string, title string").write.parquet(f"{tmp_path}/fixed_chunks.parquet")
    assert sorted(map(tuple, word_overlap_80(spark, str(tmp_path)).collect())) == [(1, 7, 91.7), (2, 7, 100.0)]
