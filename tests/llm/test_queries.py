"""The registered queries of the problems that no SQL states, over the smallest tables."""

import pytest
from pyspark.sql import functions as F

from turnmill.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def rows(spark, small):
    found = {}

    def get(name):
        if name not in found:
            found[name] = QUERIES[name](spark, small).collect()
        return found[name]

    return get


def table(spark, small, name, *columns):
    return spark.read.parquet(f"{small}/{name}.parquet").select(*columns).distinct()


def test_all_have_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == {"p1_found", "p2_found", "p5_turns", "p5_inferred", "p6_containers", "p6_fill", "p8_pieces"}


def test_p1(spark, small, rows):
    got = rows("p1_found")
    ids = {r[0] for r in table(spark, small, "questions", "question_id", "insight_id").where("insight_id is not null").select("question_id").collect()}
    assert {r["defect_type"] for r in got} == {"empty", "truncated", "refusal", "copies_question", "other_language"}
    assert len({r["question_id"] for r in got}) == len(got) and {r["question_id"] for r in got} <= ids
    q = table(spark, small, "questions", "question_id", "insight_id").join(table(spark, small, "insights", "insight_id", "comprehensive_answer"), "insight_id")
    null = {r[0] for r in q.where("comprehensive_answer is null or trim(comprehensive_answer) = ''").select("question_id").collect()}
    assert null <= {r["question_id"] for r in got if r["defect_type"] == "empty"}


def test_p2(spark, small, rows):
    got = rows("p2_found")
    listed = {r["title"]: r["title_id"] for r in table(spark, small, "transcript_titles", "title", "title_id").collect()}
    typed = {("quote", r[0]): r[1] for r in table(spark, small, "insight_quotes", "quote_id", "transcript_title").collect()} | {("chunk", r[0]): r[1] for r in table(spark, small, "fixed_chunks", "id", "title").collect()}
    assert {(r["record_kind"], r["record_id"]) for r in got} == {k for k, t in typed.items() if t and t.strip() and t not in listed} and len(got) == len({(r["record_kind"], r["record_id"]) for r in got})
    assert {r["title_id"] for r in got} <= {0, *listed.values()}
    same = {t.lower(): i for t, i in listed.items()}
    assert all(r["title_id"] == same[t.lower()] for r in got if (t := typed[r["record_kind"], r["record_id"]]).lower() in same)


def test_p5(spark, small, rows):
    turns, found, inferred = rows("p5_turns"), rows("p5_found"), rows("p5_inferred")
    key = lambda x: (x["video_id"], x["turn_no"], x["speaker_no"], x["first_segment_id"], x["last_segment_id"])
    assert sorted(map(key, turns)) == sorted(map(key, found))
    assert all(x["text"] and x["cue_start"] <= x["cue_end"] for x in turns)
    assert not any("[Music]" in x["text"] or "  " in x["text"] for x in turns)
    assert all(x["speaker_no"] == x["named"] for x in inferred if x["named"] is not None) and all(x["speaker_no"] is not None for x in inferred)
    assert len({(x["video_id"], x["segment_id"]) for x in inferred}) == len(inferred)


def test_p6(spark, small, rows):
    got, fill = rows("p6_containers"), rows("p6_fill")
    held = {}
    for x in got:
        held[x["container"]] = held.get(x["container"], 0) + x["size"]
    docs = {r[0] for r in table(spark, small, "documents", "doc_id").collect()}
    assert {x["doc_id"] for x in got} == docs and max(held.values()) <= 8192
    assert sum(x["containers"] for x in fill) == len(held) and sum(x["tokens"] for x in fill) == sum(held.values())
    assert len(held) <= 1.005 * (-(-sum(held.values()) // 8192)) + 1


def test_p7(rows):
    got, found = rows("p7_passages"), rows("p7_found")
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(x["doc_id"], x["item_id"]) for x in found}
    assert all(0 <= x["start"] < x["end"] for x in got) and len(set(got)) == len(got)


def test_p8(spark, small, rows):
    text = {r["doc_id"]: r["text"] for r in table(spark, small, "documents", "doc_id", "text").where(F.col("text").isNotNull()).collect()}
    own = {}
    for x in rows("p8_pieces"):
        own.setdefault(x["doc_id"], []).append(x)
    for doc, parts in own.items():
        parts.sort(key=lambda x: x["piece_no"])
        assert [x["piece_no"] for x in parts] == list(range(1, len(parts) + 1)) and parts[0]["start_char"] == 0 and parts[-1]["end_char"] == len(text[doc])
        assert all(x["n_tokens"] <= 512 and x["piece"] == text[doc][x["start_char"] : x["end_char"]] for x in parts)
        assert all(b["start_char"] <= a["end_char"] < b["end_char"] for a, b in zip(parts, parts[1:]))
    assert all(doc in own for doc, t in text.items() if len(t.split()) > 512)
