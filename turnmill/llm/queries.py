"""Queries of the numbered training-data problems and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import oracles
from turnmill.llm.leaks import leaked_passages
from turnmill.llm.packing import pack
from turnmill.llm.pairs import pair_defects
from turnmill.llm.pieces import split_oversized
from turnmill.llm.spans import shared_parts, shared_spans
from turnmill.llm.titles import best_titles
from turnmill.functions.tokens import n_tokens
from turnmill.llm.turns import infer_speakers, spoken_cues, turns
from turnmill.sources.tables import records, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "questions", "question_id", "insight_id", "question")
    return pair_defects(questions, "question_id", "insight_id", "question", table(spark, folder, "insights", "insight_id", "comprehensive_answer"), "insight_id", "comprehensive_answer")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    quotes = records(spark, folder, "insight_quotes", "quote_id", "transcript_title").select(F.lit("quote").alias("record_kind"), F.col("quote_id").alias("record_id"), F.col("transcript_title").alias("value"))
    chunks = records(spark, folder, "fixed_chunks", "id", "title").select(F.lit("chunk").alias("record_kind"), F.col("id").alias("record_id"), F.col("title").alias("value"))
    typed = quotes.unionByName(chunks)
    best = best_titles(typed, "value", table(spark, folder, "transcript_titles"), "title_id", "title")
    return typed.join(best, "value").select("record_kind", "record_id", "title_id")


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    quotes = table(spark, folder, "insight_quotes", "quote_id", "quoted_text").toDF("record_id", "text").withColumn("record_kind", F.lit("quote"))
    chunks = table(spark, folder, "fixed_chunks", "id", "text").toDF("record_id", "text").withColumn("record_kind", F.lit("chunk"))
    return shared_spans(quotes.unionByName(chunks), ["record_kind", "record_id"], "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).select("record_kind", "record_id", "span_start", "span_end")


def p4_shared_part(spark: SparkSession, folder: str) -> DataFrame:
    return shared_parts(_spans(spark, folder), ["record_kind", "record_id"])


def _cues(spark: SparkSession, folder: str) -> DataFrame:
    cues = table(spark, folder, "segments", "video_id", "segment_id", "cue_start", "cue_end", "text", "vimeo_generated_speaker")
    return spoken_cues(cues, "video_id", "segment_id", "cue_start", "cue_end", "text", "vimeo_generated_speaker")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return turns(_cues(spark, folder)).select("video_id", "turn_no", "speaker_no", "first_segment_id", "last_segment_id")


def p5_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns(_cues(spark, folder), with_text=True)


def p5_inferred(spark: SparkSession, folder: str) -> DataFrame:
    return infer_speakers(_cues(spark, folder)).select("video_id", "segment_id", "named", "speaker_no")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents", "doc_id", "text").select("doc_id", n_tokens(F.col("text")).alias("n_tokens"))
    return pack(sizes, "doc_id", "n_tokens").withColumnRenamed("item_id", "doc_id")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: how many by fill, in steps of a tenth."""
    room = p6_containers(spark, folder).groupBy("container").agg(F.sum("size").alias("held"), F.count("*").alias("items"))
    return room.groupBy(F.least(F.floor(F.col("held") * 10 / 8192), F.lit(9)).alias("tenth")).agg(F.count("*").alias("containers"), F.sum("held").alias("tokens"), F.sum("items").alias("items"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", table(spark, folder, "eval_items", "item_id", "text"), "item_id", "text")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", limit=512, overlap=64)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_shared_part": p4_shared_part,
    "p5_found": p5_found,
    "p5_turns": p5_turns,
    "p5_inferred": p5_inferred,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_passages": p7_passages,
    "p8_pieces": p8_pieces,
}

SQL: dict[str, str] = dict(oracles.SQL)
