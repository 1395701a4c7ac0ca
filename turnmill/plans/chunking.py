"""Queries that cut transcripts and documents into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators import chunking as C
from turnmill.sources.tables import table


def fixed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    cues = table(spark, folder, "segments", "segment_id", "video_id", "title", "text", "cue_start", "cue_end")
    return C.fixed_size_chunks(cues)


def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length("text")
    return fixed_chunks(spark, folder).groupBy("video_id").agg(F.count("*").alias("chunks"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


def sliding_window_chunks(spark: SparkSession, folder: str) -> DataFrame:
    x = C.sliding_windows(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", 3000, 1500)
    return x.select("doc_id", "window_no", "start_char", F.length("text").alias("length"), F.md5("text").alias("md5"))


def window_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return C.sentence_windows(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", 1500)


QUERIES = {f.__name__: f for f in (fixed_chunks, chunk_stats, sliding_window_chunks, window_chunks)}

def ms(x: str) -> str:
    """Rounded to the millisecond as the shortest decimal of a double, halves up."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE)"


# Chunk after chunk, by a recursive query over the pieces of each video.
_CHUNKS = rf"""
WITH RECURSIVE s AS (SELECT DISTINCT segment_id, video_id, title, coalesce(trim(text, E' \t\n\r'), '') AS text, cue_start, cue_end FROM segments),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY video_id ORDER BY cue_start NULLS FIRST, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM s),
v AS (SELECT video_id, max(title) AS title, string_agg(text || ' ', '' ORDER BY start_char) AS body FROM o GROUP BY video_id),
l AS (SELECT video_id, list_filter(string_split(regexp_replace(body, '([.!?])(\s)', chr(1) || '\1\2', 'g'), chr(1)), lambda x: x <> '') AS parts FROM v),
u AS (SELECT video_id, i, length(parts[i]) AS n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM l)),
p AS (SELECT video_id, i, sum(n) OVER w - n AS b, sum(n) OVER w AS e, n >= 3000 AS long FROM u WINDOW w AS (PARTITION BY video_id ORDER BY i)),
f AS (SELECT a.video_id, a.i, any_value(a.b) AS b, any_value(a.e) AS e, any_value(a.long) AS long, min(z.i) FILTER (z.e > a.b + 3000) AS over, min(z.i) FILTER (z.long) AS stop FROM p a JOIN p z ON z.video_id = a.video_id AND z.i >= a.i GROUP BY a.video_id, a.i),
k AS (SELECT f.video_id, f.i, f.b, f.over, f.stop, CASE WHEN f.long THEN f.e WHEN least(f.over, f.stop) IS NULL THEN NULL ELSE q.b END AS e, f.long FROM f LEFT JOIN p q ON q.video_id = f.video_id AND q.i = least(f.over, f.stop)),
x AS (SELECT k.video_id, k.i, any_value(k.b) AS b, any_value(k.e) AS e, CASE WHEN any_value(k.long) THEN k.i + 1 WHEN any_value(least(k.over, k.stop)) IS NULL THEN NULL WHEN any_value(least(k.over, k.stop)) IS NOT DISTINCT FROM any_value(k.stop) THEN any_value(k.stop)
             ELSE min(z.i) FILTER (z.i > k.i AND z.b >= t.b - 1500 AND z.b >= t.e - 3000) END AS next
      FROM k LEFT JOIN p t ON t.video_id = k.video_id AND t.i = k.over LEFT JOIN p z ON z.video_id = k.video_id AND z.i BETWEEN k.i AND k.over GROUP BY k.video_id, k.i),
r AS (SELECT video_id, 1 AS i FROM v UNION ALL SELECT x.video_id, x.next FROM r JOIN x ON x.video_id = r.video_id AND x.i = r.i WHERE x.next IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.video_id = x.video_id AND p.i = x.next)),
c AS (SELECT r.video_id, title, x.b, substring(body, CAST(x.b + 1 AS BIGINT), CAST(coalesce(x.e, length(body)) - x.b AS BIGINT)) AS part FROM r JOIN x ON x.video_id = r.video_id AND x.i = r.i JOIN v ON v.video_id = r.video_id),
g AS (SELECT video_id, title, trim(part, E' \t\n\r') AS text, b, b + length(part) - length(ltrim(part, E' \t\n\r')) AS first, row_number() OVER w AS chunk_index, count(*) OVER (PARTITION BY video_id) AS total_chunks FROM c WHERE trim(part, E' \t\n\r') <> '' WINDOW w AS (PARTITION BY video_id ORDER BY b)),
a AS (SELECT g.video_id, chunk_index, max_by({{'s': start_char, 'n': length(o.text), 'a': cue_start, 'z': cue_end}}, start_char) FILTER (start_char <= first) AS h, max_by({{'s': start_char, 'n': length(o.text), 'a': cue_start, 'z': cue_end}}, start_char) AS t
      FROM g JOIN o ON o.video_id = g.video_id AND start_char <= first + length(g.text) - 1 GROUP BY g.video_id, chunk_index)
SELECT left(trim(regexp_replace(coalesce(title, ''), '[^a-zA-Z0-9]+', '_', 'g'), '_'), 100) || '_' || g.video_id || '_chunk_' || g.chunk_index AS chunk_id, g.video_id, title, text, {ms('h.a + (first - h.s) / CAST(greatest(h.n, 1) AS DOUBLE) * (h.z - h.a)')} AS cue_start,
       {ms('t.a + (first + length(text) - 1 - t.s) / CAST(greatest(t.n, 1) AS DOUBLE) * (t.z - t.a)')} AS cue_end, CAST(g.chunk_index AS INT) AS chunk_index, CAST(total_chunks AS INT) AS total_chunks
FROM g JOIN a ON a.video_id = g.video_id AND a.chunk_index = g.chunk_index
"""

SQL = {
    "fixed_chunks": _CHUNKS,
    "chunk_stats": f"SELECT video_id, count(*) AS chunks, CAST(min(length(text)) AS INT) AS shortest, CAST(max(length(text)) AS INT) AS longest, round(avg(length(text)), 6) AS mean FROM ({_CHUNKS}) GROUP BY video_id",
    "window_chunks": r"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s)', chr(1) || '\1\2', 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i, length(parts[i]) AS n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM l) WHERE parts[i] <> '' OR len(parts) = 1),
w AS (SELECT doc_id, n, (sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n) // 1500 AS window_no FROM u)
SELECT doc_id, CAST(window_no AS BIGINT) AS window_no, count(*) AS sentences, CAST(sum(n) AS BIGINT) AS letters FROM w GROUP BY doc_id, window_no
""",
    "sliding_window_chunks": """
WITH x AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 3000) / 1500.0), 0) AS BIGINT) + 1)) AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(w AS INT) AS window_no, CAST(w * 1500 AS INT) AS start_char, CAST(length(substring(text, w * 1500 + 1, 3000)) AS INT) AS length, md5(substring(text, w * 1500 + 1, 3000)) AS md5 FROM x
""",
}
