"""Problem 3: continuous periods and gaps of each video's windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators.intervals import coverage
from turnmill.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    windows = table(spark, folder, "chunks", "video_id", "cue_start", "cue_end").where("cue_end > cue_start")
    return coverage(windows.select("video_id", ms("cue_start").alias("start"), ms("cue_end").alias("end")), "video_id", "start", "end").select("video_id", "kind", "start_ms", "end_ms")


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": """
WITH w AS (SELECT DISTINCT video_id, CAST(round(cue_start * 1000) AS BIGINT) AS s, CAST(round(cue_end * 1000) AS BIGINT) AS e
           FROM chunks WHERE cue_end > cue_start),
v AS (SELECT * FROM w WHERE s < e AND video_id IS NOT NULL),
m AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
n AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT video_id, island, min(s) AS s, max(e) AS e FROM n GROUP BY video_id, island),
g AS (SELECT video_id, lag(e) OVER (PARTITION BY video_id ORDER BY s) AS s, s AS e FROM p)
SELECT video_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
UNION ALL SELECT video_id, 'gap', s, e FROM g WHERE s IS NOT NULL
""",
}
