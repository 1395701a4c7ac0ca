import random

import pytest

from turnmill.llm import pairs as P


@pytest.mark.parametrize("x", [None, "", "  \n", "...", "?", "N/A", "[no answer]", "(blank)", "TBD", "to be added", "​", "null", "--"])
def test_empty(x):
    assert P.is_empty(x)


@pytest.mark.parametrize("x", ["No; keep it.", "It depends on the term.", "はい。", "Text it to them."])
def test_not_empty(x):
    assert not P.is_empty(x)


@pytest.mark.parametrize(
    "x",
    [
        "We sent the forms and", "We sent the forms (", "We sent the forms:", "We sent the forms –", "They agreed. Then...", "They agreed. Then…", "There are three steps. 1. Sign it. 2.",
        "There are three steps. 1. Sign it. 2. Form", "Here is how:\n- one two three\n- four five six\n-", "Use this:\n```\ncode", "He said “yes and left.", "彼は行った", "some 48%", "the mediator t",
        "Do this:\n- one two three\n- four five six\n- seven", "It is so, i.e.", "Keep it under Sec.", "We like this vs.", "Three:\n- Sign it.\n- Send it.\n- File the", 'He said "yes and left.', "It is **bold and done.",
        "Call `run and wait.", "<b>All is done.", "Use:\n```\na ( b", "彼は「行った。",
    ],
)
def test_truncated(x):
    assert P.is_truncated(x)


@pytest.mark.parametrize(
    "x",
    [
        "All is done.", "Is it?", 'As they put it: "try again."', "It works (more or less)", "The list:\n- one two\n- three four\n- five six", "Do:\n1) one two\n1) three four", "彼は行った。",
        "There are two steps. 1. Sign it. 2. Send it.", "It costs 4.5 a month, he said.", "Use this:\n```\ncode\n```\n", "One) closing too many is fine.", "He paid $5.", "See section 12.",
        "Use the left pedal", "See https://example.com/docs", "Great work everyone 🎉", "Boards, forms, etc.", "Ms. Pell vs. the clerk was settled.", "```\na ( b\n```", "It is **bold**.", "<p>Done.</p>", "A 5\" pipe (“so”) fits.", "No.",
    ],
)
def test_whole(x):
    assert not P.is_truncated(x)


@pytest.mark.parametrize(
    "x",
    [
        "I'm sorry, but I can't help with questions about the crane. You may wish to rephrase.", "This falls outside what I may answer.", "Apologies; I would rather not comment on hospital matters.",
        "Thanks for asking. I won't be able to provide that.", "You raise a point about the camera. This request can’t be completed. Please consult your own counsel.", "Je suis désolé, je ne peux pas répondre.",
        "I can't help with that; please consult your own counsel.", "I am not able to offer legal advice on this " + "very " * 60 + "long matter.",
    ],
)
def test_refusal(x):
    assert P.is_refusal(x)


@pytest.mark.parametrize(
    "x",
    [
        "The board declined to answer, and that silence was the useful part. We then asked the host and the clerk for the forms.", "I can't overstate how much that helps. We always sign early and send the forms on a Tuesday.",
        "Sorry is a word worth using early with a regulator. Then send the forms and wait for the answer to come.",
        "I can't help thinking the pilot group should go first.", "We will not provide food, so bring lunch with you.", "I can't answer that, but the clerk files the annex before the vote.",
        "I can't help with the first part. For the second, file the annex before the vote and have the clerk sign each page of the form.",
    ],
)
def test_no_refusal(x):
    assert not P.is_refusal(x)


def test_language():
    assert P.language("Who will sign the forms when the host is away?") == "en"
    assert P.language("La direction juridique a finalement accepté un compromis avant la réunion du printemps.") == "fr"
    assert P.language("Der Aufsichtsrat hat lange gezögert und die Unterlagen geordnet.") == "de"
    assert P.language("Answer - El consejo ya firmó el acta antes de la reunión de otoño.") == "es"
    assert P.language("取締役会は議事録を保管した。") == "ja"
    assert P.language("Zarząd podpisał dokumenty wczoraj") == "pl" and not {"en"} & set(P.languages("Styrelsen skrev under avtalet före sommaren."))
    assert "de" in P.languages("Ja, natürlich.") and "en" not in P.languages("Ja, natürlich.") and "en" in P.languages("No; keep the badge separate.")
    assert P.language("Zanlibury 44") is None and P.language("") is None and P.language(None) is None


def test_copies():
    q = "How should a buyer renew 43,000 stamps when the host has only ten thresholds?"
    assert P.copies(q, q) and P.copies(q, "Question: " + q.upper() + " Answer:") and P.copies(q, q.replace("43,000", "43000").replace("buyer ", ""))
    assert not P.copies(q, q + " Yes, but only after the pilot is signed.") and not P.copies(q, "") and not P.copies("", q)
    assert P.copies(q, f"{q} {q}") and P.copies(q, f"{q} {q} {q}") and not P.copies(q, f"{q} {q} Yes, but only after the pilot is signed by all.")
    assert P.tiles(list("abcxdef"), list("abcydef")) == (6, 6) and P.tiles(list("abcabcab"), list("xabc")) == (8, 3) and P.tiles([], list("ab")) == P.tiles(list("ab"), []) == (0, 0)


def test_tiles_against_brute_force():
    """The longest run that is still free, each time; ties to the first place."""
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 14))] for _ in range(2))
        free, covered = [True] * len(a), 0
        while True:
            runs = [(n, -i) for i in range(len(a)) for n in range(2, len(a) - i + 1) if all(free[i : i + n]) and any(b[j : j + n] == a[i : i + n] for j in range(len(b)))]
            if not runs:
                break
            n, i = max(runs)
            free[-i : -i + n] = [False] * n
            covered += n
        assert P.tiles(a, b)[0] == covered


def test_pairs(spark):
    q = spark.createDataFrame(
        [("q1", "i1", "Who signs the form for us?", 1), ("q1", "i1", "Who signs the form for us?", 1), ("q2", "i2", "Who signs the form for us?", 1), ("q3", None, "x", 1), ("q4", "i4", None, 1), ("q5", "i5", "Who will sign the form for the host?", 1), ("q6", "i6", "Who signs the form for us?", 1), ("q7", "no", "Who?", 1), ("q8", "i1", "What is it for?", 1)],
        "question_id string, insight_id string, question string, _key int",
    )
    a = spark.createDataFrame(
        [("i1", None, "a"), ("i2", "The clerk and the host do.", "b"), ("i2", "The clerk and the host do.", "b"), ("i4", "TBD", "c"), ("i5", "El consejo ya firmó el acta antes de la reunión de otoño.", "d"), ("i6", "the clerk and the " * 50_000, "e"), (None, "x", "f")],
        "insight_id string, comprehensive_answer string, question string",
    )
    got = P.pair_defects(q, "question_id", "insight_id", "question", a, "insight_id", "comprehensive_answer").collect()
    assert sorted(map(tuple, got)) == [("q1", "empty"), ("q4", "empty"), ("q5", "other_language"), ("q6", "truncated"), ("q8", "empty")]
    assert P.pair_defects(q.limit(0), "question_id", "insight_id", "question", a, "insight_id", "comprehensive_answer").collect() == []
    assert P.pair_defects(q, "question_id", "insight_id", "question", a.limit(0), "insight_id", "comprehensive_answer").collect() == []
