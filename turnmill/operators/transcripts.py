"""Cues into transcripts: offsets, times of positions, renderings, cues of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import hours_minutes_seconds, minutes_seconds, plain_seconds, trimmed
from turnmill.operators.ordered import running, time_shard

ORDER = ["cue_start", "segment_id"]


def with_offsets(cues: DataFrame, letters: Column | None = None) -> DataFrame:
    """Adds ``start_char``, where a cue's text begins in its video's text (each cue is followed
    by one space), and ``row_no`` from 1. A null text has no letters but its space. ``letters``
    may give the lengths, so that the texts need not travel."""
    length = F.coalesce(F.length("text") if letters is None else letters, F.lit(0)) + 1
    x = running(cues, "video_id", ORDER, time_shard("cue_start"), start_char=length, row_no=F.lit(1))
    return x.withColumn("row_no", F.col("row_no") + 1)


def time_of(position: Column, start_char: Column, length: Column, cue_start: Column, cue_end: Column) -> Column:
    """The time at a character position of a cue, linear over the cue's letters."""
    return cue_start + (position - start_char) / F.greatest(length, F.lit(1)) * (cue_end - cue_start)


def times_of_positions(cues: DataFrame, every: int) -> DataFrame:
    """``(video_id, position, segment_id, seconds)`` at each multiple of ``every`` characters.

    Positions are made from the cues' own ranges, so that no range join is needed. Cues without
    a start or an end give a null time.
    """
    x = with_offsets(cues).withColumn("length", F.coalesce(F.length("text"), F.lit(0)))
    first, last = F.ceil(F.col("start_char") / every), F.floor((F.col("start_char") + F.col("length")) / every)
    x = x.where(first <= last).withColumn("_step", F.explode(F.sequence(first, last))).withColumn("position", F.col("_step") * every)
    return x.select("video_id", "position", "segment_id", time_of(F.col("position"), F.col("start_char"), F.col("length"), F.col("cue_start"), F.col("cue_end")).alias("seconds"))


def rendered(cues: DataFrame, speaker: str, stamps: bool) -> DataFrame:
    """``(video_id, title, n_cues, seconds, speakers, body)``: a video as one readable text.

    With ``stamps`` a line a cue under a heading whenever the speaker changes; without, the cues
    of a speaker run on. Speakers that are null, blank or ``nan`` have no heading. The duration
    is the end of the last cue by start. The result is one row a video, its text included.
    """
    who = F.when(F.lower(trimmed(F.col(speaker))).isin("", "nan"), None).otherwise(trimmed(F.col(speaker)))
    x = cues.select("video_id", "title", "cue_start", "cue_end", "segment_id", trimmed(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(who, F.lit("")).alias("who"))
    lines = F.array_sort(F.collect_list(F.struct("cue_start", "segment_id", "cue_end", "who", "text")))
    x = x.groupBy("video_id").agg(F.max("title").alias("title"), F.count("*").alias("n_cues"), F.sort_array(F.collect_set("who")).alias("speakers"), lines.alias("lines"))
    head = lambda w: F.when(w == "", F.lit("")).otherwise(F.concat(F.lit("**[Speaker "), w, F.lit("]**\n\n")))

    def line(c: Column, i: Column) -> Column:
        before = F.try_element_at("lines", i.cast("int"))
        new = (i == 0) | (before["who"] != c["who"])
        text = F.concat(F.lit("["), plain_seconds(c["cue_start"]), F.lit(" - "), plain_seconds(c["cue_end"]), F.lit("] "), c["text"]) if stamps else c["text"]
        between = F.when(i == 0, F.lit("")).when(new, F.lit("\n\n")).otherwise(F.lit("\n" if stamps else " "))
        return F.concat(between, F.when(new, head(c["who"])).otherwise(F.lit("")), F.coalesce(text, c["text"]))

    seconds = F.element_at("lines", -1)["cue_end"]
    speakers = F.filter("speakers", lambda s: s != "")
    body = F.array_join(F.transform("lines", line), "")
    stamp = minutes_seconds(seconds) if stamps else hours_minutes_seconds(seconds)
    header = [F.concat(F.lit("# "), F.coalesce("title", F.lit("untitled"))), F.lit(""), F.concat(F.lit("**Duration:** "), F.coalesce(stamp, F.lit("unknown")))]
    header += [F.concat(F.lit("**Number of Segments:** "), F.col("n_cues")), F.concat(F.lit("**Speakers:** "), F.array_join(speakers, ", ")), F.lit(""), F.lit("---"), F.lit(""), body]
    return x.select("video_id", "title", "n_cues", seconds.alias("seconds"), F.size(speakers).alias("speakers"), F.concat_ws("\n", *header).alias("body"))


def cues_in_windows(windows: DataFrame, cues: DataFrame, slack: float = 0.5, bucket_s: int = 60) -> DataFrame:
    """Each window ``(chunk_id, video_id, cue_start, cue_end)`` with each cue that lies in it, up
    to ``slack`` seconds on either side.

    Both meet by video and minute, so that the join is an equality one with a bounded number of
    pairs a key. Windows or cues without both times join nothing.
    """
    w = windows.select("chunk_id", "video_id", (F.col("cue_start") - slack).alias("_from"), (F.col("cue_end") + slack).alias("_to")).where("_from <= _to")
    w = w.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / bucket_s), F.floor(F.col("_to") / bucket_s))))
    c = cues.withColumn("_b", F.floor(F.col("cue_start") / bucket_s))
    return w.join(c, ["video_id", "_b"]).where("cue_start >= _from and cue_end <= _to").drop("_b", "_from", "_to")
