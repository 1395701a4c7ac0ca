import random
import re

import pytest

from turnmill.operators.chunking import fixed_size_chunks, sliding_windows


def plain(pieces, size, overlap):
    """The rule, piece after piece."""
    out, held = [], []
    room = lambda: sum(map(len, held))
    for p in [*pieces, None]:
        if p is None or len(p) >= size:
            if held:
                out.append("".join(held))
                held = []
            if p is not None:
                out.append(p)
        else:
            if room() + len(p) > size and held:
                out.append("".join(held))
                while held and (room() > overlap or room() + len(p) > size):
                    held.pop(0)
            held.append(p)
    return [x.strip() for x in out if x.strip()]


@pytest.mark.parametrize(("size", "overlap", "block"), [(60, 25, 60), (60, 0, 100), (200, 90, 1000)])
def test_against_the_plain_rule(spark, size, overlap, block):
    r = random.Random(size + overlap)
    rows, want = [], {}
    for v in range(5):
        cues = [(v, i, float(i), i + 0.5, "T: x", r.choice(["", None, ". y", "Yes!", "so it goes. And", "what? why", "abc " * r.randint(1, 40), "end.", " spaced  "])) for i in range(r.choice([1, 40, 120]))]
        rows += cues
        text = "".join((c[5] or "").strip() + " " for c in cues)
        at = [0, *sorted({m.start() for m in re.finditer(r"[.!?]\s", text)} - {0}), len(text)]
        want[v] = plain([text[a:b] for a, b in zip(at, at[1:])], size, overlap)
    df = spark.createDataFrame(rows, "video_id long, segment_id long, cue_start double, cue_end double, title string, text string")
    got = fixed_size_chunks(df, size, overlap, block=block).orderBy("video_id", "chunk_index").collect()
    assert {v: [x["text"] for x in got if x["video_id"] == v] for v in want} == want
    for v in want:
        mine = [x for x in got if x["video_id"] == v]
        assert [x["chunk_index"] for x in mine] == list(range(1, len(mine) + 1))
        assert all(x["total_chunks"] == len(mine) and x["chunk_id"] == f"T_x_{v}_chunk_{x['chunk_index']}" for x in mine)
        assert [x["cue_start"] for x in mine] == sorted(x["cue_start"] for x in mine)


def test_times(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 9.0, "t", "123456789"), (1, 2, 10.0, 20.0, "t", "ab")], "video_id long, segment_id long, cue_start double, cue_end double, title string, text string")
    x = fixed_size_chunks(df).first()
    assert (x["text"], x["cue_start"], x["cue_end"]) == ("123456789 ab", 0.0, 15.0)


def test_empty(spark):
    df = spark.createDataFrame([], "video_id long, segment_id long, cue_start double, cue_end double, title string, text string")
    assert fixed_size_chunks(df).collect() == []


def test_sliding(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None), (4, "abc")], "d long, t string")
    got = sorted((x["doc_id"], x["start_char"], x["text"]) for x in sliding_windows(df, "d", "t", 4, 2).collect())
    assert got == [(1, 0, "abcd"), (1, 2, "cdef"), (1, 4, "efg"), (2, 0, ""), (4, 0, "abc")]
