import json

import pytest

from turnmill.operators.providers import Busy, called, embedded, hashed_vectors, not_yet
from turnmill.sources import files as I
from turnmill.sources.tables import once
from turnmill.streaming.ingest import ingest_chunks


def test_read_segments(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,text,cue_start,cue_end,vimeo_generated_speaker\nT,"hi, ""you""\nthere",0.5,1,2.0\n')
    (tmp_path / "b.csv").write_text("cue_end,cue_start,title,text\n2,1,U,x\n")
    (tmp_path / "c.csv").write_text("title,text,cue_start\nT,x,1\n")
    (tmp_path / "d.csv").write_text("title,text,cue_start,cue_end\n")
    (tmp_path / "e.csv").write_text("title,text,cue_start,cue_end\nT,x,one,2\n")
    good, bad = I.read_segments(spark, str(tmp_path / "*.csv"))
    assert sorted(tuple(r) for r in good.collect()) == [("T", 'hi, "you"\nthere', 0.5, 1.0, "2.0"), ("U", "x", 1.0, 2.0, None)]
    told = {r["file"][-5:]: r["problem"] for r in bad.collect()}
    assert told == {"c.csv": "missing columns: cue_end", "d.csv": "no rows", "e.csv": "times that are no numbers: 1"}


def test_texts(spark, tmp_path):
    df = spark.createDataFrame([("A: b", 'head\n{"x": "the text"\nmore'), ("C", "plain")], "title string, body string")
    I.write_texts(df, "title", "body", str(tmp_path / "out"))
    back = I.read_texts(spark, str(tmp_path / "out" / "file=*"))
    assert back.count() == 2
    got = {r["b"] for r in back.select(I.payload(back["body"]).alias("b")).collect()}
    assert any(x.startswith("the text") for x in got)


def test_chunks_and_envelopes(spark, tmp_path):
    rows = [{"chunk_id": "a_1", "text": "x", "title": "T/1", "cue_start": 0.0, "cue_end": 1.0, "chunk_index": 1, "total_chunks": 1}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    got = I.read_chunks(spark, str(tmp_path / "c.json"))
    assert "chunk_id" not in got.columns and got.first()["title"] == "T/1"
    I.write_chunks(got, str(tmp_path / "w"))
    assert [p.name for p in (tmp_path / "w").glob("file=*")] == ["file=T_1"]
    (tmp_path / "e.json").write_text(json.dumps({"metadata": {}, "entries": [{"question_id": "q_001", "question": "Why?"}], "transcripts": {"T": "text"}}))
    assert I.read_entries(spark, str(tmp_path / "e.json"), "entries", "struct<question_id:string,question:string>").first()["question"] == "Why?"
    assert tuple(I.read_transcript_map(spark, str(tmp_path / "e.json")).first()) == ("T", "text")
    with pytest.raises(I.Invalid):
        I.checked_chunks(got.drop("title"))
    with pytest.raises(I.Invalid):
        I.checked_chunks(got.limit(0))


def test_strategies(spark):
    s = I.Strategies(spark)
    df = embedded(spark.createDataFrame([("a", "x y", "T", 0.0, 1.0), ("b", "z", "T", 1.0, 2.0)], "chunk_id string, text string, title string, cue_start double, cue_end double"), "text", hashed_vectors(8))
    s.append("fixed", df)
    s.append("fixed", df)
    assert s.load("fixed").count() == 2 and all(s.checks("fixed", 8).values()) and not all(s.checks("fixed", 9).values())
    s.truncate("fixed")
    assert s.load("fixed").count() == 0
    s.drop("fixed")
    assert s.checks("fixed") == {"table": False}
    with pytest.raises(I.Invalid):
        s.table("x; drop table y")


def test_provider_retries():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise Busy
        return [[1.0]] * len(texts)

    assert called(flaky, ["a"], (0, 0, 0)) == [[1.0]] and len(calls) == 3
    with pytest.raises(Busy):
        called(lambda x: (_ for _ in ()).throw(Busy()), ["a"], (0,))
    with pytest.raises(ValueError):
        called(lambda x: [], ["a"], (0,))


def test_embedded(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, " "), (4, "b a")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in embedded(df, "t", hashed_vectors(4), batch=1).collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and len(got[1]) == 4
    assert [r["id"] for r in not_yet(df, df.where("id < 4"), "id").collect()] == [4]


def test_once(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (1, None, "c"), (2, None, "x"), (None, 1, "n")], "k long, at long, v string")
    assert {(r["k"], r["v"]) for r in once(df, "k", "at").collect()} == {(1, "a"), (2, "x"), (None, "n")}


def test_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda k: json.dumps({"chunk_id": k, "text": f"text {k}", "title": "T", "cue_start": 0, "cue_end": 1, "chunk_index": 1, "total_chunks": 1})
    (src / "1.json").write_text("\n".join([line("a"), line("b"), line("a")]))
    run = lambda: ingest_chunks(spark, str(src), I.CHUNK, str(tmp_path / "out"), str(tmp_path / "cp"), hashed_vectors(4)).awaitTermination()
    run()
    (src / "2.json").write_text("\n".join([line("b"), line("c")]))
    run()
    assert sorted(r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
