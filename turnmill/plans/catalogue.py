"""All queries of the core, by name, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.plans import chunking, groundtruth, intervals, quality, search, transcripts

_PARTS = [intervals, search, transcripts, quality, groundtruth, chunking]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search.semantic_topk(spark, folder)
