"""Data quality, dimensions of questions, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.functions.tokens import n_tokens
from turnmill.operators.ordered import numbered
from turnmill.sources.tables import records, table

USD_PER_MILLION_TOKENS = 0.13
TOKEN_LIMIT = 8192


def embedding_quality(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings", "embedding", "label")
    return e.agg(
        F.count("*").alias("rows"),
        F.min(F.size("embedding")).alias("least"),
        F.max(F.size("embedding")).alias("most"),
        F.round(F.avg(F.size("embedding")), 6).alias("mean"),
        F.count_if(F.col("embedding").isNull()).alias("missing"),
        F.count_distinct("label").alias("labels"),
    )


def null_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "fixed_chunks", "text", "title", "embedding", "created_at")
    return c.agg(F.count("*").alias("rows"), *[F.count_if(F.col(x).isNull()).alias(f"no_{x}") for x in c.columns], F.count_if(F.trim("title") == "").alias("blank_title"))


def length_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "source", "text")
    n = F.length("text")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.round(F.percentile(n, 0.5), 6).alias("median"))


def count_match(spark: SparkSession, folder: str) -> DataFrame:
    """Of each video: chunks stored against chunks announced, and whether they are numbered 1 to n."""
    c = records(spark, folder, "chunks", "chunk_id", "video_id", "chunk_index", "total_chunks")
    x = c.groupBy("video_id").agg(F.count("*").alias("stored"), F.max("total_chunks").alias("announced"), F.count_distinct("chunk_index").alias("numbers"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))
    whole = (F.col("stored") == F.col("announced")) & (F.col("numbers") == F.col("stored")) & (F.col("low") == 1) & (F.col("high") == F.col("stored"))
    return x.select("video_id", "stored", "announced", F.coalesce(whole, F.lit(False)).alias("complete"))


def token_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated tokens (a quarter of the characters) and price of embedding each source."""
    t = F.ceil(F.length("text") / 4)
    x = table(spark, folder, "documents", "source", "text").groupBy("source").agg(F.sum(t).alias("tokens"), F.count_if(t > TOKEN_LIMIT).alias("too_long"), F.count("*").alias("n"))
    return x.select("source", "tokens", "too_long", F.ceil(F.col("n") / 100).alias("batches"), F.round(F.col("tokens") / 1e6 * USD_PER_MILLION_TOKENS, 6).alias("usd"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each source by a public tokenizer, and texts over the limit of one embedding request."""
    t = table(spark, folder, "documents", "source", "text").select("source", n_tokens(F.col("text")).alias("n"))
    return t.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.max("n").alias("most"), F.count_if(F.col("n") > TOKEN_LIMIT).alias("too_long"))


def question_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Running ids for questions, in the order of those they have."""
    q = numbered(records(spark, folder, "questions", "question_id"), ["question_id"], "n")
    return q.select("question_id", F.format_string("q_%03d", "n").alias("running_id"))


def _dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """One row a question and category (the place in ``dimensions_used``)."""
    q = records(spark, folder, "questions", "question_id", "dimensions_used")
    return q.select("question_id", F.posexplode("dimensions_used").alias("category", "d")).select("question_id", "category", F.col("d.dimension").alias("value"), F.size("d.examples").alias("examples"))


def dimension_stats(spark: SparkSession, folder: str) -> DataFrame:
    x = _dimensions(spark, folder).groupBy("category", "value").agg(F.count("*").alias("n"), F.max("examples").alias("examples"))
    all_ = F.sum("n").over(Window.partitionBy("category"))
    return x.withColumn("share", F.round(100.0 * F.col("n") / all_, 1))


def dimension_values(spark: SparkSession, folder: str) -> DataFrame:
    return _dimensions(spark, folder).groupBy("category").agg(F.count_distinct("value").alias("values"), F.count("*").alias("n"))


def _combinations(spark: SparkSession, folder: str) -> DataFrame:
    q = records(spark, folder, "questions", "question_id", "question", "dimensions_used")
    return q.select("question_id", "question", F.expr("array_join(transform(dimensions_used, d -> coalesce(d.dimension, '')), ' | ')").alias("combination"))


def combo_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by combination of dimensions: how many, and the first by id, shortened."""
    q = _combinations(spark, folder)
    short = F.when(F.length("question") > 100, F.concat(F.substring("question", 1, 100), F.lit("..."))).otherwise(F.col("question"))
    return q.groupBy("combination").agg(F.count("*").alias("n"), F.min("question_id").alias("first_id"), F.min_by(short, "question_id").alias("first_question"))


def combo_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    g = _combinations(spark, folder).groupBy("combination").agg(F.count("*").alias("n"))
    x = g.agg(F.count("*").alias("combinations"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_repeated"), F.sum("n").alias("questions"))
    return x.withColumn("uniqueness", F.round(F.try_divide(100.0 * (F.col("questions") - F.col("in_repeated")), F.col("questions")), 1))


def dimension_combos(spark: SparkSession, folder: str) -> DataFrame:
    """All combinations of the values seen in the categories, one of each, numbered in order.

    The values of a category are a short closed list; more than a hundred are refused.
    """
    v = _dimensions(spark, folder).where("value is not null and category < 3").select("category", "value").distinct()
    if v.count() > 300:
        raise ValueError("a category of dimensions has too many values to combine")
    of = lambda c: v.where(F.col("category") == c).select(F.col("value").alias(f"value_{c}"))
    x = of(0).crossJoin(of(1)).crossJoin(of(2))
    return x.withColumn("combo_no", F.row_number().over(Window.orderBy("value_0", "value_1", "value_2")) - 1)


def combo_cycle(spark: SparkSession, folder: str) -> DataFrame:
    """Two combinations an insight, going round: the insight's number decides where to start."""
    c = dimension_combos(spark, folder)
    n = c.agg(F.count("*").alias("of"))
    i = table(spark, folder, "insights", "insight_id").where("insight_id is not null").distinct()
    i = i.withColumn("no", F.regexp_extract("insight_id", r"(\d+)$", 1).cast("long")).withColumn("q", F.explode(F.array(F.lit(1), F.lit(2))))
    i = i.crossJoin(n).withColumn("combo_no", F.pmod(2 * (F.col("no") - 1) + F.col("q") - 1, F.col("of")).cast("int"))
    return i.join(c, "combo_no").select("insight_id", "q", "combo_no", "value_0", "value_1", "value_2")


def insight_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Insights with their questions, numbered in order, and those without."""
    i = records(spark, folder, "insights", "insight_id", "prompt_version")
    q = records(spark, folder, "questions", "question_id", "insight_id", "difficulty").where("insight_id is not null")
    q = q.withColumn("no", F.row_number().over(Window.partitionBy("insight_id").orderBy("question_id")))
    return i.join(q, "insight_id", "left").select("insight_id", "prompt_version", F.coalesce("no", F.lit(0)).alias("no"), "question_id", F.coalesce("difficulty", F.lit("medium")).alias("difficulty"))


def quote_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Insights by number of quotes, and whether that is within two to four."""
    i = table(spark, folder, "insights", "insight_id").distinct()
    q = records(spark, folder, "insight_quotes", "quote_id", "insight_id").groupBy("insight_id").agg(F.count("*").alias("quotes"))
    x = i.join(q, "insight_id", "left").select(F.coalesce("quotes", F.lit(0)).alias("quotes"))
    return x.groupBy("quotes").agg(F.count("*").alias("insights")).withColumn("allowed", F.col("quotes").between(2, 4))


QUERIES = {f.__name__: f for f in (
    embedding_quality, null_counts, length_stats, count_match, token_cost, token_counts, question_numbers, dimension_stats, dimension_values, combo_groups, combo_duplicates, dimension_combos, combo_cycle, insight_questions, quote_counts,
)}

_D = """
WITH q AS (SELECT DISTINCT question_id, question, dimensions_used FROM questions),
d AS (SELECT question_id, u.i - 1 AS category, dimensions_used[u.i].dimension AS value, len(dimensions_used[u.i].examples) AS examples FROM q, unnest(range(1, len(dimensions_used) + 1)) AS u(i))
"""
_G = _D + ", g AS (SELECT question_id, question, array_to_string(list_transform(dimensions_used, lambda x: coalesce(x.dimension, '')), ' | ') AS combination FROM q)"
_C = _D + """,
v AS (SELECT DISTINCT category, value FROM d WHERE value IS NOT NULL),
c AS (SELECT a.value AS value_0, b.value AS value_1, c.value AS value_2, CAST(row_number() OVER (ORDER BY a.value, b.value, c.value) - 1 AS INT) AS combo_no FROM v a, v b, v c WHERE a.category = 0 AND b.category = 1 AND c.category = 2)
"""
SQL = {
    "embedding_quality": "SELECT count(*) AS rows, CAST(min(len(embedding)) AS INT) AS least, CAST(max(len(embedding)) AS INT) AS most, round(avg(len(embedding)), 6) AS mean, count(*) FILTER (embedding IS NULL) AS missing, count(DISTINCT label) AS labels FROM embeddings",
    "null_counts": "SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS no_text, count(*) FILTER (title IS NULL) AS no_title, count(*) FILTER (embedding IS NULL) AS no_embedding, count(*) FILTER (created_at IS NULL) AS no_created_at, count(*) FILTER (trim(title) = '') AS blank_title FROM fixed_chunks",
    "length_stats": "SELECT source, count(*) AS n, CAST(min(length(text)) AS INT) AS shortest, CAST(max(length(text)) AS INT) AS longest, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median FROM documents GROUP BY source",
    "count_match": """
WITH c AS (SELECT DISTINCT chunk_id, video_id, chunk_index, total_chunks FROM chunks),
x AS (SELECT video_id, count(*) AS stored, max(total_chunks) AS announced, count(DISTINCT chunk_index) AS numbers, min(chunk_index) AS low, max(chunk_index) AS high FROM c GROUP BY video_id)
SELECT video_id, stored, announced, coalesce(stored = announced AND numbers = stored AND low = 1 AND high = stored, false) AS complete FROM x
""",
    "token_cost": "SELECT source, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, count(*) FILTER (ceil(length(text) / 4.0) > 8192) AS too_long, CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches, round(sum(ceil(length(text) / 4.0)) / CAST(1e6 AS DOUBLE) * CAST(0.13 AS DOUBLE), 6) AS usd FROM documents GROUP BY source",
    "question_numbers": "SELECT question_id, printf('q_%03d', row_number() OVER (ORDER BY question_id)) AS running_id FROM (SELECT DISTINCT question_id FROM questions)",
    "dimension_stats": _D + "SELECT CAST(category AS INT) AS category, value, count(*) AS n, CAST(max(examples) AS INT) AS examples, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY category), 1) AS share FROM d GROUP BY category, value",
    "dimension_values": _D + "SELECT CAST(category AS INT) AS category, count(DISTINCT value) AS values, count(*) AS n FROM d GROUP BY category",
    "combo_groups": _G + "SELECT combination, count(*) AS n, min(question_id) AS first_id, arg_min(CASE WHEN length(question) > 100 THEN left(question, 100) || '...' ELSE question END, question_id) AS first_question FROM g GROUP BY combination",
    "combo_duplicates": _G + """, n AS (SELECT combination, count(*) AS n FROM g GROUP BY combination),
x AS (SELECT count(*) AS combinations, count(*) FILTER (n > 1) AS repeated, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_repeated, CAST(sum(n) AS BIGINT) AS questions FROM n)
SELECT *, round(100.0 * (questions - in_repeated) / questions, 1) AS uniqueness FROM x""",
    "dimension_combos": _C + "SELECT * FROM c",
    "combo_cycle": _C + """,
i AS (SELECT DISTINCT insight_id, CAST(regexp_extract(insight_id, '(\\d+)$', 1) AS BIGINT) AS no FROM insights WHERE insight_id IS NOT NULL),
z AS (SELECT insight_id, CAST(q AS INT) AS q, (2 * (no - 1) + q - 1) % (SELECT count(*) FROM c) AS k FROM i, (VALUES (1), (2)) AS t(q))
SELECT insight_id, q, combo_no, value_0, value_1, value_2 FROM z JOIN c ON c.combo_no = z.k
""",
    "insight_questions": """
WITH i AS (SELECT DISTINCT insight_id, prompt_version FROM insights), q AS (SELECT DISTINCT question_id, insight_id, difficulty FROM questions WHERE insight_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY insight_id ORDER BY question_id) AS no FROM q)
SELECT i.insight_id, prompt_version, CAST(coalesce(no, 0) AS INT) AS no, question_id, coalesce(difficulty, 'medium') AS difficulty FROM i LEFT JOIN n ON n.insight_id = i.insight_id
""",
    "quote_counts": """
WITH i AS (SELECT DISTINCT insight_id FROM insights), q AS (SELECT insight_id, count(*) AS n FROM (SELECT DISTINCT quote_id, insight_id FROM insight_quotes) GROUP BY insight_id),
x AS (SELECT coalesce(n, 0) AS quotes FROM i LEFT JOIN q ON q.insight_id = i.insight_id)
SELECT quotes, count(*) AS insights, quotes BETWEEN 2 AND 4 AS allowed FROM x GROUP BY quotes
""",
}
