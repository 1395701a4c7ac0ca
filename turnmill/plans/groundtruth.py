"""Queries on quotes, the chunks they come from, and the questions that expect them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions.text import normalized
from turnmill.operators import groundtruth as G
from turnmill.sources.tables import records, table


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "insight_quotes", "quote_id", "insight_id", "quoted_text", "transcript_title")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "fixed_chunks", "id", "text", "title")


def quote_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes that stand in a chunk as a whole, but for spaces and case."""
    q = _quotes(spark, folder).select("quote_id", normalized(F.col("quoted_text")).alias("q"))
    c = _chunks(spark, folder).select("id", normalized(F.col("text")).alias("t"))
    return G.located(q, "quote_id", "q", c, "id", "t").toDF("quote_id", "id")


def quote_start_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return G.chunks_of_quotes(_quotes(spark, folder), _chunks(spark, folder))


def expected_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with the sorted ids of the chunks that their insight's quotes come from."""
    q = records(spark, folder, "questions", "question_id", "insight_id")
    hits = _quotes(spark, folder).select("quote_id", "insight_id").join(quote_start_chunks(spark, folder), "quote_id")
    by_insight = hits.groupBy("insight_id").agg(F.array_sort(F.collect_set("id")).alias("expected"))
    return q.join(by_insight, "insight_id", "left").select("question_id", "insight_id", "expected")


def questions_mapped(spark: SparkSession, folder: str) -> DataFrame:
    return expected_chunks(spark, folder).where("expected is not null").select("question_id", F.to_json("expected").alias("expected"))


def questions_unmapped(spark: SparkSession, folder: str) -> DataFrame:
    return expected_chunks(spark, folder).where("expected is null").select("question_id", "insight_id")


def mapping_stats(spark: SparkSession, folder: str) -> DataFrame:
    x = expected_chunks(spark, folder).agg(F.count("*").alias("questions"), F.count("expected").alias("mapped"), F.coalesce(F.sum(F.size("expected")), F.lit(0)).alias("chunks"))
    return x.withColumn("chunks_per_question", F.round(F.try_divide("chunks", "mapped"), 6))


def title_resolution(spark: SparkSession, folder: str) -> DataFrame:
    typed = _quotes(spark, folder).select("transcript_title").unionByName(_chunks(spark, folder).select(F.col("title").alias("transcript_title")))
    return G.resolved_titles(typed, "transcript_title", table(spark, folder, "transcript_titles"), "title_id", "title")


def quote_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return G.graded_quotes(_quotes(spark, folder), "quote_id", "quoted_text", _chunks(spark, folder), "text")


def quote_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes by how they are found, with their share and the grade of the whole."""
    x = quote_ladder(spark, folder)
    all_ = x.agg(F.count("*").alias("of"), F.count_if("found").alias("ok"), F.count_if(F.col("match_type") == "exact").alias("exact"))
    by = x.groupBy("match_type", "confidence").agg(F.count("*").alias("n")).crossJoin(all_)
    rate = 100.0 * F.col("ok") / F.col("of")
    grade = F.when((rate >= 95) & (100.0 * F.col("exact") / F.col("of") >= 80), "excellent").when(rate >= 95, "very good").when(rate >= 85, "good").when(rate >= 70, "fair").otherwise("poor")
    return by.select("match_type", "confidence", "n", F.round(100.0 * F.col("n") / F.col("of"), 1).alias("share"), F.round(rate, 1).alias("success"), grade.alias("grade"))


def questions_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Of each question: its insight's quotes, how many are found, and whether all are."""
    q = records(spark, folder, "questions", "question_id", "insight_id").where("insight_id is not null")
    f = _quotes(spark, folder).select("quote_id", "insight_id").join(quote_ladder(spark, folder), "quote_id")
    f = f.groupBy("insight_id").agg(F.count("*").alias("quotes"), F.count_if("found").alias("found"), F.bool_and("found").alias("all_found"))
    return q.join(f, "insight_id").select("question_id", "quotes", "found", "all_found")


def word_overlap_80(spark: SparkSession, folder: str) -> DataFrame:
    """Quote and chunk where at least four fifths of the quote's different words are in the chunk."""
    return G.word_overlaps(_quotes(spark, folder), "quote_id", "quoted_text", _chunks(spark, folder), "id", "text").toDF("quote_id", "id", "overlap")



QUERIES = {f.__name__: f for f in (
    quote_exact, quote_start_chunks, questions_mapped, questions_unmapped, mapping_stats, title_resolution, quote_ladder, quote_summary, questions_verified, word_overlap_80,
)}

_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_T = "trim(replace(replace(lower({}), ':', ''), '  ', ' '))"
_Q = f"""
WITH q AS (SELECT quote_id, insight_id, transcript_title, {_NORM.format('quoted_text')} AS q, {_T.format('transcript_title')} AS t FROM (SELECT DISTINCT quote_id, insight_id, quoted_text, transcript_title FROM insight_quotes)),
c AS (SELECT id, {_NORM.format('text')} AS c, {_T.format('title')} AS t FROM (SELECT DISTINCT id, text, title FROM fixed_chunks))
"""
_M = _Q + """,
m AS (SELECT quote_id, insight_id, id FROM q JOIN c ON q.t <> '' AND c.t <> '' AND (contains(q.t, c.t) OR contains(c.t, q.t)) AND q <> '' AND contains(c, array_to_string(list_slice(string_split(q, ' '), 1, 10), ' '))),
e AS (SELECT insight_id, list_sort(list(DISTINCT id)) AS expected FROM m GROUP BY insight_id),
x AS (SELECT question_id, k.insight_id, expected FROM (SELECT DISTINCT question_id, insight_id FROM questions) k LEFT JOIN e ON e.insight_id = k.insight_id)
"""
_LIKE = "lower(replace(replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '–', '-'), '—', '-'))"
_ONE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_LADDER = rf"""
WITH q AS (SELECT DISTINCT quote_id, {_LIKE.format('quoted_text')} AS s FROM insight_quotes),
t AS (SELECT row_number() OVER () AS n, x FROM (SELECT DISTINCT {_LIKE.format('text')} AS x FROM fixed_chunks WHERE text IS NOT NULL)),
a AS (SELECT quote_id, s, string_split(s, ' ') AS w, {_ONE.format(r"regexp_replace(s, '\.{3,}|…', '', 'g')")} AS plain,
             list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(s, '^(?:…|\.\.\.)', '')), '\.{{3,}}|…'), lambda p: {_ONE.format('p')}), lambda p: len(string_split(p, ' ')) >= 5) AS parts,
             list_filter(list_transform(string_split(s, '.'), lambda p: trim(p)), lambda p: length(p) > 10) AS sentences FROM q WHERE s <> ''),
b AS (SELECT *, list_transform(parts, lambda p: string_split(p, ' ')) AS pw FROM a),
f AS (SELECT quote_id, 1 AS tier, 0 AS place, 'high' AS grade, s AS phrase FROM b
      UNION ALL SELECT quote_id, 2, 0, 'high', plain FROM b WHERE length(plain) > 20
      UNION ALL SELECT quote_id, 3, 3 * i + k, CASE WHEN k = 2 AND length(phrase) > 50 THEN 'high' ELSE 'medium' END, phrase
                FROM (SELECT quote_id, i, k, len(pw[i]) AS n, array_to_string(list_slice(pw[i], 1, 10 + 5 * k), ' ') AS phrase FROM (SELECT *, unnest(range(1, len(pw) + 1)) AS i FROM b), range(3) AS r(k)) WHERE n >= 10 + 5 * k AND length(phrase) > 20
      UNION ALL SELECT quote_id, 3, 10000 + i, CASE WHEN length(parts[i]) > 50 THEN 'high' ELSE 'medium' END, parts[i] FROM (SELECT *, unnest(range(1, len(pw) + 1)) AS i FROM b) WHERE length(parts[i]) BETWEEN 21 AND 200
      UNION ALL SELECT quote_id, 3, 20000 + i, 'medium', phrase FROM (SELECT quote_id, i, array_to_string(list_slice(pw[i], len(pw[i]) // 4 + 1, len(pw[i]) // 4 + 15), ' ') AS phrase FROM (SELECT *, unnest(range(1, len(pw) + 1)) AS i FROM b) WHERE len(pw[i]) >= 20) WHERE length(phrase) > 20
      UNION ALL SELECT quote_id, 5, i, 'medium', phrase FROM (SELECT quote_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM b WHERE length(s) BETWEEN 20 AND 100)) WHERE NOT contains(phrase, '...')
      UNION ALL SELECT quote_id, 6, 0, 'low', unnest(regexp_extract_all(s, '"[^"]{{10,}}"')) FROM b),
h AS (SELECT quote_id, tier, place, grade FROM f WHERE EXISTS (SELECT 1 FROM t WHERE contains(x, phrase))
      UNION ALL SELECT DISTINCT quote_id, 4, 0, 'medium' FROM (SELECT quote_id, t.n, any_value(k) AS k, count(*) AS c FROM (SELECT quote_id, len(sentences) AS k, {_ONE.format("regexp_replace(unnest(sentences), '…', '', 'g')")} AS p FROM b WHERE length(s) > 100) z JOIN t ON length(p) > 10 AND contains(x, p) GROUP BY quote_id, t.n) WHERE c >= 0.7 * k),
m AS (SELECT quote_id, min({{'tier': tier, 'place': place, 'grade': grade}}) AS b FROM h GROUP BY quote_id),
l AS (SELECT q.quote_id, b IS NOT NULL AS found, CASE WHEN b IS NULL THEN 'not_found' WHEN b.tier = 1 THEN 'exact' ELSE 'partial' END AS match_type, coalesce(b.grade, 'low') AS confidence FROM (SELECT DISTINCT quote_id FROM q) q LEFT JOIN m ON m.quote_id = q.quote_id)
"""
SQL = {
    "quote_ladder": _LADDER + "SELECT * FROM l",
    "quote_summary": _LADDER + """,
o AS (SELECT count(*) AS n, 100.0 * count(*) FILTER (found) / count(*) AS rate, 100.0 * count(*) FILTER (match_type = 'exact') / count(*) AS exact FROM l)
SELECT match_type, confidence, count(*) AS n, round(100.0 * count(*) / any_value(o.n), 1) AS share, round(any_value(rate), 1) AS success,
       any_value(CASE WHEN rate >= 95 AND exact >= 80 THEN 'excellent' WHEN rate >= 95 THEN 'very good' WHEN rate >= 85 THEN 'good' WHEN rate >= 70 THEN 'fair' ELSE 'poor' END) AS grade FROM l, o GROUP BY match_type, confidence
""",
    "questions_verified": _LADDER + """
SELECT question_id, quotes, found, all_found FROM (SELECT DISTINCT question_id, insight_id FROM questions WHERE insight_id IS NOT NULL) k
JOIN (SELECT insight_id, count(*) AS quotes, count(*) FILTER (found) AS found, bool_and(found) AS all_found FROM l JOIN (SELECT DISTINCT quote_id, insight_id FROM insight_quotes) i ON i.quote_id = l.quote_id GROUP BY insight_id) g ON g.insight_id = k.insight_id
""",
    "word_overlap_80": f"""
WITH q AS (SELECT DISTINCT quote_id, list_distinct(string_split({_NORM.format('quoted_text')}, ' ')) AS a FROM insight_quotes WHERE trim(quoted_text) <> ''),
c AS (SELECT DISTINCT id, list_distinct(string_split({_NORM.format('text')}, ' ')) AS b FROM fixed_chunks WHERE text IS NOT NULL)
SELECT quote_id, id, overlap FROM (SELECT quote_id, id, round(100.0 * len(list_intersect(a, b)) / len(a), 1) AS overlap FROM q, c) WHERE overlap >= 80
""",
    "quote_exact": _Q + "SELECT DISTINCT quote_id, id FROM q JOIN c ON contains(c, q) WHERE q <> ''",
    "quote_start_chunks": _M + "SELECT DISTINCT quote_id, id FROM m",
    "questions_mapped": _M + "SELECT question_id, '[' || array_to_string(expected, ',') || ']' AS expected FROM x WHERE expected IS NOT NULL",
    "questions_unmapped": _M + "SELECT question_id, insight_id FROM x WHERE expected IS NULL",
    "mapping_stats": _M + "SELECT count(*) AS questions, count(expected) AS mapped, CAST(coalesce(sum(len(expected)), 0) AS BIGINT) AS chunks, round(sum(len(expected)) / count(expected), 6) AS chunks_per_question FROM x",
    "title_resolution": r"""
WITH v AS (SELECT DISTINCT value FROM (SELECT transcript_title AS value FROM insight_quotes UNION ALL SELECT title FROM fixed_chunks) WHERE trim(value) <> ''),
n AS (SELECT value, lower(regexp_replace(trim(regexp_replace(value, '\s+', ' ', 'g')), '^TRANSCRIPT \d+: ', '')) AS v FROM v),
j AS (SELECT value, min({'o': lower(title) <> v, 'i': title_id}) FILTER (title_id IS NOT NULL) AS b FROM n LEFT JOIN transcript_titles ON contains(v, lower(title)) OR contains(lower(title), v) GROUP BY value)
SELECT value, b.i AS title_id, CASE WHEN b IS NULL THEN 'transcript_not_found' WHEN b.o THEN 'partial' ELSE 'exact' END AS how FROM j
""",
}
