"""Queries over cues, chunks and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as X
from turnmill.operators import transcripts as T
from turnmill.operators.ordered import following, runs, time_shard
from turnmill.sources.tables import records, table


def _cues(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "segments", "segment_id", "video_id", "title", "text", "cue_start", "cue_end", "vimeo_generated_speaker")


def segment_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return T.with_offsets(_cues(spark, folder)).select("video_id", "segment_id", "row_no", "start_char")


def char_to_time(spark: SparkSession, folder: str) -> DataFrame:
    x = T.times_of_positions(_cues(spark, folder), 500)
    return x.withColumn("seconds", F.round("seconds", 10))


def speaker_runs(spark: SparkSession, folder: str) -> DataFrame:
    x = runs(_cues(spark, folder), "video_id", T.ORDER, time_shard("cue_start"), "vimeo_generated_speaker")
    return x.select("video_id", "run_no", F.col("vimeo_generated_speaker").alias("speaker"), "n", F.col("first.segment_id").alias("first_id"), F.col("last.segment_id").alias("last_id"))


def transcript_text(spark: SparkSession, folder: str) -> DataFrame:
    x = _cues(spark, folder).groupBy("video_id").agg(F.count("*").alias("n"), F.max_by("cue_end", F.struct("cue_start", "segment_id")).alias("seconds"), F.count_distinct("vimeo_generated_speaker").alias("speakers"), F.array_sort(F.collect_list(F.struct("cue_start", "segment_id", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
    return x.select("video_id", "n", "seconds", "speakers", F.expr("array_join(transform(c, x -> x.text), ' ')").alias("text"))


def rendered_with_stamps(spark: SparkSession, folder: str) -> DataFrame:
    return T.rendered(_cues(spark, folder), "vimeo_generated_speaker", stamps=True)


def rendered_plain(spark: SparkSession, folder: str) -> DataFrame:
    return T.rendered(_cues(spark, folder), "vimeo_generated_speaker", stamps=False)


def cue_window_concat(spark: SparkSession, folder: str) -> DataFrame:
    x = following(_cues(spark, folder), "video_id", T.ORDER, time_shard("cue_start"), 5, F.coalesce("text", F.lit("")), "five")
    return x.select("segment_id", F.md5("five").alias("five"), F.length("five").alias("length"))


def chunk_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Of each window: the cues in it, their letters, and how far the first cue is off."""
    w = records(spark, folder, "chunks", "chunk_id", "video_id", "cue_start", "cue_end")
    x = T.cues_in_windows(w, _cues(spark, folder).select("video_id", "segment_id", "cue_start", "cue_end", "text"))
    x = x.groupBy("chunk_id").agg(F.count("*").alias("cues"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("letters"), F.min("cue_start").alias("first_start"), F.max("cue_end").alias("last_end"))
    return w.select("chunk_id", "cue_start", "cue_end").join(x, "chunk_id", "left").select(
        "chunk_id",
        F.coalesce("cues", F.lit(0)).alias("cues"),
        F.coalesce("letters", F.lit(0)).alias("letters"),
        F.round(F.col("first_start") - F.col("cue_start"), 3).alias("start_off"),
        F.round(F.col("last_end") - F.col("cue_end"), 3).alias("end_off"),
    )


def timing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How far windows and their cues are apart, over all windows."""
    x = chunk_cues(spark, folder)
    close = (F.abs("start_off") < 1) & (F.abs("end_off") < 1)
    off = F.col("start_off")
    return x.agg(
        F.count("*").alias("windows"),
        F.count_if(close).alias("accurate"),
        F.round(F.avg(off), 6).alias("mean"),
        F.round(F.median(off), 6).alias("median"),
        F.round(F.stddev_pop(off), 6).alias("std"),
        F.min(off).alias("least"),
        F.max(off).alias("most"),
        (F.stddev_pop(off) < 5).alias("consistent"),
    )


def timing_by_words(spark: SparkSession, folder: str) -> DataFrame:
    """Of each window with a start: the cue within half a minute whose ten following cues agree
    best, word by word, with the window's first twenty words, and by how many seconds it is off.
    Ties go to the earlier cue; agreement below a fifth is no match."""
    w = records(spark, folder, "chunks", "chunk_id", "video_id", "cue_start", "text").where("cue_start is not null")
    first = F.slice(X.words(F.lower("text")), 1, 20)
    ten = following(_cues(spark, folder), "video_id", T.ORDER, time_shard("cue_start"), 10, F.coalesce("text", F.lit("")), "ten")
    ten = ten.select("video_id", "segment_id", "cue_start", "cue_end", F.slice(X.words(F.lower("ten")), 1, 20).alias("heard"))
    near = T.cues_in_windows(w.select("chunk_id", "video_id", (F.col("cue_start") - 30).alias("cue_start"), (F.col("cue_start") + 30).alias("cue_end")), ten, slack=0.0)
    own = w.select("chunk_id", F.col("cue_start").alias("at"), first.alias("said"))
    agree = F.size(F.filter(F.zip_with("said", "heard", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    scored = near.join(own, "chunk_id").withColumn("agreement", F.round(F.try_divide(agree, F.size("said")), 6)).where("agreement >= 0.2")
    best = scored.groupBy("chunk_id").agg(F.max(F.struct("agreement", (-F.col("cue_start")).alias("c"), (-F.col("segment_id")).alias("s"), F.round(F.col("cue_start") - F.col("at"), 3).alias("off"))).alias("b"))
    return best.select("chunk_id", (-F.col("b.s")).alias("segment_id"), "b.agreement", "b.off")


def chunk_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Five chunks at random, the same ones for the same table."""
    return records(spark, folder, "fixed_chunks", "id", "title", "text").orderBy(F.md5(F.col("id").cast("string")), "id").limit(5).select("id", "title", X.preview(F.col("text"), 200).alias("preview"))


def time_stamps(spark: SparkSession, folder: str) -> DataFrame:
    w = records(spark, folder, "chunks", "chunk_id", "cue_start").where("cue_start is not null")
    c = F.col("cue_start")
    return w.select("chunk_id", X.minutes_seconds(c).alias("ms"), X.hours_minutes_seconds(c).alias("hms"))


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "documents", "title").where("title is not null").distinct()
    c = F.col("title")
    return t.select("title", X.file_name(c).alias("file_name"), X.safe_title(c).alias("safe_title"), X.identifier(c).alias("identifier"), X.normalized_title(c).alias("normalized"), X.preview(c, 20).alias("preview"))


QUERIES = {f.__name__: f for f in (
    segment_offsets, char_to_time, speaker_runs, transcript_text, rendered_with_stamps, rendered_plain, cue_window_concat, chunk_cues, timing_summary, timing_by_words, chunk_sample, time_stamps, file_names,
)}

_S = "WITH s AS (SELECT DISTINCT segment_id, video_id, title, text, cue_start, cue_end, vimeo_generated_speaker AS speaker FROM segments),\n"
_W = "OVER (PARTITION BY video_id ORDER BY cue_start NULLS FIRST, segment_id"
_OFFSETS = _S + f"""
o AS (SELECT *, row_number() {_W}) AS row_no, coalesce(sum(coalesce(length(text), 0) + 1) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM s)
"""
_OFF = """
WITH c AS (SELECT DISTINCT chunk_id, video_id, cue_start, cue_end FROM chunks),
s AS (SELECT DISTINCT segment_id, video_id, text, cue_start, cue_end FROM segments),
j AS (SELECT chunk_id, count(*) AS cues, sum(coalesce(length(text), 0)) AS letters, min(s.cue_start) AS a, max(s.cue_end) AS z
      FROM c JOIN s ON s.video_id = c.video_id AND s.cue_start >= c.cue_start - 0.5 AND s.cue_end <= c.cue_end + 0.5 AND s.cue_start <= c.cue_end + 0.5 AND c.cue_start - 0.5 <= c.cue_end + 0.5 GROUP BY chunk_id),
k AS (SELECT c.chunk_id, coalesce(cues, 0) AS cues, CAST(coalesce(letters, 0) AS BIGINT) AS letters, round(a - cue_start, 3) AS start_off, round(z - cue_end, 3) AS end_off FROM c LEFT JOIN j ON j.chunk_id = c.chunk_id)
"""



def _rendered_sql(stamps: bool) -> str:
    seconds = lambda c: f"regexp_replace(regexp_replace(printf('%.3f', {c}), '0+$', ''), '\\.$', '')"
    line = f"coalesce('[' || {seconds('cue_start')} || ' - ' || {seconds('cue_end')} || '] ' || text, text)" if stamps else "text"
    minutes = "printf('%02d:%02d', w // 60, w % 60)"
    time = minutes if stamps else f"CASE WHEN w >= 3600 THEN printf('%02d:%02d:%02d', w // 3600, w // 60 % 60, w % 60) ELSE {minutes} END"
    return f"""
WITH s AS (SELECT DISTINCT segment_id, video_id, title, cue_start, cue_end, coalesce(trim(text, E' \\t\\n\\r'), '') AS text, CASE WHEN lower(trim(vimeo_generated_speaker)) IN ('', 'nan') THEN '' ELSE coalesce(trim(vimeo_generated_speaker), '') END AS who FROM segments),
n AS (SELECT *, row_number() OVER w AS i, coalesce(who <> lag(who) OVER w, true) AS new FROM s WINDOW w AS (PARTITION BY video_id ORDER BY cue_start NULLS FIRST, segment_id)),
l AS (SELECT *, CASE WHEN i = 1 THEN '' WHEN new THEN E'\\n\\n' ELSE {"E'\\n'" if stamps else "' '"} END || CASE WHEN new AND who <> '' THEN '**[Speaker ' || who || E']**\\n\\n' ELSE '' END || {line} AS line FROM n),
v AS (SELECT video_id, max(title) AS title, count(*) AS n_cues, arg_max(cue_end, i) AS seconds, list_sort(list(DISTINCT who) FILTER (who <> '')) AS speakers, string_agg(line, '' ORDER BY i) AS lines, CAST(floor(arg_max(cue_end, i)) AS BIGINT) AS w FROM l GROUP BY video_id)
SELECT video_id, title, n_cues, seconds, CAST(coalesce(len(speakers), 0) AS INT) AS speakers, '# ' || coalesce(title, 'untitled') || E'\\n\\n**Duration:** ' || coalesce({time}, 'unknown') || E'\\n**Number of Segments:** ' || n_cues
       || E'\\n**Speakers:** ' || coalesce(array_to_string(speakers, ', '), '') || E'\\n\\n---\\n\\n' || lines AS body FROM v
"""


SQL = {
    "rendered_with_stamps": _rendered_sql(True),
    "rendered_plain": _rendered_sql(False),
    "chunk_sample": "SELECT id, title, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM (SELECT DISTINCT id, title, text FROM fixed_chunks) ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 5",
    "segment_offsets": _OFFSETS + "SELECT video_id, segment_id, row_no, CAST(start_char AS BIGINT) AS start_char FROM o",
    "char_to_time": _OFFSETS + """,
p AS (SELECT *, coalesce(length(text), 0) AS len FROM o),
u AS (SELECT *, unnest(range(CAST(ceil(start_char / 500.0) AS BIGINT), CAST(floor((start_char + len) / 500.0) AS BIGINT) + 1)) * 500 AS position FROM p)
SELECT video_id, position, segment_id, round(cue_start + (position - start_char) / CAST(greatest(len, 1) AS DOUBLE) * (cue_end - cue_start), 10) AS seconds FROM u
""",
    "speaker_runs": _S + f"""
n AS (SELECT *, CASE WHEN lag(segment_id) {_W}) IS NOT NULL AND lag(speaker) {_W}) IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT *, CAST(sum(fresh) {_W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM n)
SELECT video_id, run_no, any_value(speaker) AS speaker, count(*) AS n, arg_min(segment_id, (cue_start, segment_id)) AS first_id, arg_max(segment_id, (cue_start, segment_id)) AS last_id FROM r GROUP BY video_id, run_no
""",
    "transcript_text": _S + """
x AS (SELECT 1)
SELECT video_id, count(*) AS n, arg_max(cue_end, (cue_start, segment_id)) AS seconds, count(DISTINCT speaker) AS speakers, string_agg(coalesce(text, ''), ' ' ORDER BY cue_start, segment_id) AS text FROM s GROUP BY video_id
""",
    "cue_window_concat": _S + f"""
x AS (SELECT segment_id, array_to_string(list(coalesce(text, '')) {_W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS five FROM s)
SELECT segment_id, md5(five) AS five, CAST(length(five) AS INT) AS length FROM x
""",
    "chunk_cues": _OFF + "SELECT * FROM k",
    "timing_summary": _OFF + """
SELECT count(*) AS windows, count(*) FILTER (abs(start_off) < 1 AND abs(end_off) < 1) AS accurate, round(avg(start_off), 6) AS mean, round(median(start_off), 6) AS median, round(stddev_pop(start_off), 6) AS std,
       min(start_off) AS least, max(start_off) AS most, stddev_pop(start_off) < 5 AS consistent FROM k
""",
    "timing_by_words": _S + f"""
t AS (SELECT video_id, segment_id, cue_start, cue_end, list_slice(list_filter(string_split(trim(regexp_replace(lower(array_to_string(list(coalesce(text, '')) {_W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), ' ')), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), 1, 20) AS heard FROM s),
w AS (SELECT DISTINCT chunk_id, video_id, cue_start AS began, list_slice(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), 1, 20) AS said FROM chunks WHERE cue_start IS NOT NULL),
j AS (SELECT chunk_id, segment_id, cue_start, round(cue_start - began, 3) AS off, round(len(list_filter(range(1, len(said) + 1), lambda i: said[i] = heard[i])) / nullif(len(said), 0), 6) AS agreement
      FROM w JOIN t ON t.video_id = w.video_id AND t.cue_start >= began - 30 AND t.cue_end <= began + 30 AND t.cue_start <= began + 30),
k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY agreement DESC, cue_start, segment_id) AS n FROM j WHERE agreement >= 0.2)
SELECT chunk_id, segment_id, agreement, off FROM k WHERE n = 1
""",
    "time_stamps": r"""
WITH c AS (SELECT DISTINCT chunk_id, CAST(floor(cue_start) AS BIGINT) AS s FROM chunks WHERE cue_start IS NOT NULL)
SELECT chunk_id, printf('%02d:%02d', s // 60, s % 60) AS ms, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS hms FROM c
""",
    "file_names": r"""
WITH t AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)
SELECT title, coalesce(nullif(trim(left(regexp_replace(title, '\.\.|[/\\<>:"|?*]', '_', 'g'), 200), '. '), ''), 'untitled') AS file_name,
       left(trim(regexp_replace(title, '[^\p{L}\p{N} _-]', '_', 'g')), 200) AS safe_title, left(trim(regexp_replace(title, '[^a-zA-Z0-9]+', '_', 'g'), '_'), 100) AS identifier,
       trim(replace(replace(lower(title), ':', ''), '  ', ' ')) AS normalized, CASE WHEN length(title) > 20 THEN left(title, 20) || '...' ELSE title END AS preview FROM t
""",
}
