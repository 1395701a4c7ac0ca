"""Search and fusion over stored chunks and vectors; the queries are the rows whose id is
divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions.metrics import BUILT_IN, EVALUATORS
from turnmill.functions.text import lexemes
from turnmill.operators import search as S
from turnmill.plans import groundtruth
from turnmill.plans.groundtruth import expected_chunks
from turnmill.sources.tables import records, table

MATCHES = 20  # results a query; each branch of a fusion gives twice as many


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", "embedding", "label")


def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    found = S.vector_topk(v.where("vec_id % 20 = 0"), "vec_id", "embedding", v, "vec_id", "embedding", 11)
    best = S.ranked(found.where("query_id <> id").drop("rank"), "query_id", "similarity", "id", 10)
    return best.select("query_id", F.col("id").alias("vec_id"), "similarity", "rank")


def semantic_by_cells(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    centres = S.cells(v, "embedding", S.cells_for(v.count()))
    found = S.vector_topk_by_cells(v.where("vec_id % 20 = 0"), "vec_id", "embedding", v, "vec_id", "embedding", 10, centres, probes=max(1, len(centres) // 3))
    return found.select("query_id", F.col("id").alias("vec_id"), "similarity", "rank")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder, "fixed_chunks", "id", "text", "title", "cue_start", "cue_end", "embedding")


def _query_text(text: Column) -> Column:
    """A search-box query out of a text: a phrase and a word but not the last word, or two others."""
    w = lexemes(text)
    at = lambda i: F.coalesce(F.try_element_at(w, F.lit(i)), F.lit(""))
    return F.concat(F.lit('"'), at(2), F.lit(" "), at(3), F.lit('" '), at(5), F.lit(" -"), at(-1), F.lit(" OR "), at(8), F.lit(" "), at(9))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).where("id % 20 = 0").withColumn("query", _query_text(F.col("text")))


def _text_hits(spark: SparkSession, folder: str) -> DataFrame:
    return S.text_matches(_asked(spark, folder), "id", "query", _chunks(spark, folder), "id", "text")


def fts_matches(spark: SparkSession, folder: str) -> DataFrame:
    return _text_hits(spark, folder)


def _plain_text(text: Column) -> Column:
    """Three words out of a text."""
    w = lexemes(text)
    return F.concat_ws(" ", *[F.coalesce(F.try_element_at(w, F.lit(i)), F.lit("")) for i in (2, 3, 5)])


def _plain_hits(spark: SparkSession, folder: str, english: bool = False) -> DataFrame:
    asked = _chunks(spark, folder).where("id % 20 = 0").withColumn("query", _plain_text(F.col("text")))
    return S.text_matches(asked, "id", "query", _chunks(spark, folder), "id", "text", S.plain_query, english)


def fts_plain(spark: SparkSession, folder: str) -> DataFrame:
    return _plain_hits(spark, folder)


def fts_english(spark: SparkSession, folder: str) -> DataFrame:
    """Search-box queries by stems."""
    return S.text_matches(_asked(spark, folder), "id", "query", _chunks(spark, folder), "id", "text", english=True)


def fts_topk(spark: SparkSession, folder: str) -> DataFrame:
    return S.ranked(_text_hits(spark, folder), "query_id", "cover_score", "id", 2 * MATCHES).select("query_id", "id", "cover_score", "rank")


def fts_competition_rank(spark: SparkSession, folder: str) -> DataFrame:
    w = S.Window.partitionBy("query_id").orderBy(F.col("tf_score").desc())
    return _text_hits(spark, folder).withColumn("place", F.rank().over(w)).select("query_id", "id", "tf_score", "place")


def term_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Of every word of the corpus: in how many documents, how often, where first."""
    d = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.posexplode(lexemes(F.col("text"))).alias("pos", "lexeme"))
    per_doc = d.groupBy("lexeme", "doc_id").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    return per_doc.groupBy("lexeme").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"), F.min("first").cast("long").alias("earliest"))


def _branches(spark: SparkSession, folder: str, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = _chunks(spark, folder)
    v = S.vector_topk(c.where("id % 20 = 0"), "id", "embedding", c, "id", "embedding", 2 * MATCHES)
    return v, S.ranked(hits, "query_id", "tf_score", "id", 2 * MATCHES)


def _with_chunk(spark: SparkSession, folder: str, hits: DataFrame, *columns: str) -> DataFrame:
    """Titles and texts come last, for the few rows that are left."""
    return hits.join(_chunks(spark, folder).select("id", "title", *columns), "id")


def _hybrid(spark: SparkSession, folder: str, most: int = MATCHES) -> DataFrame:
    return S.hybrid_search(_asked(spark, folder), "id", "query", "embedding", _chunks(spark, folder), "id", "text", "embedding", most)


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _with_chunk(spark, folder, _hybrid(spark, folder))


def hybrid_pseudo_rank(spark: SparkSession, folder: str) -> DataFrame:
    return S.fuse_pseudo_ranks(*_branches(spark, folder, _plain_hits(spark, folder)), "tf_score", MATCHES)


def hybrid_weighted(spark: SparkSession, folder: str) -> DataFrame:
    return S.fuse_weighted(*_branches(spark, folder, _text_hits(spark, folder)), "tf_score", MATCHES)


def hybrid_english(spark: SparkSession, folder: str) -> DataFrame:
    """Like hybrid_rrf, with stems in the text branch."""
    c = _chunks(spark, folder)
    return _with_chunk(spark, folder, S.hybrid_search(_asked(spark, folder), "id", "query", "embedding", c, "id", "text", "embedding", MATCHES, english=True))


def search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """The five best hits of each query as readable text."""
    x = _with_chunk(spark, folder, _hybrid(spark, folder).where("rank <= 5"), "text", "cue_start", "cue_end")
    score = lambda c: F.round(c, 4)
    hit = S.formatted_hit(F.col("rank"), F.col("title"), F.col("text"), F.round("cue_start", 1), F.round("cue_end", 1), score("similarity_score"), score("fts_score"), score("hybrid_score"))
    return x.select("query_id", "rank", hit.alias("hit"))


RETRIEVED = 30  # hits that are judged a query


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """Each query's hits against the chunks of its title (null titles are one group). A query
    without hits has measures of 0.

    The measures of :data:`EVALUATORS` that are there from the start need no list of what is
    expected, only its length, so that a title may have any number of chunks; measures registered
    besides get both lists.
    """
    hits = _hybrid(spark, folder, RETRIEVED).groupBy("query_id").agg(F.expr("transform(array_sort(collect_list(struct(rank, id))), x -> x.id)").alias("retrieved"))
    asked = _chunks(spark, folder).where("id % 20 = 0").select(F.col("id").alias("query_id"), "title")
    expected = _chunks(spark, folder).select("title", "id")
    # Only what was retrieved can be relevant and found; what was not counts by number alone.
    flat = hits.select("query_id", F.posexplode("retrieved").alias("pos", "id")).join(expected.withColumnRenamed("title", "hit_title"), "id")
    sizes = expected.groupBy("title").agg(F.count("*").alias("n_expected"))
    flat = flat.join(asked, "query_id").withColumn("hit", F.col("title").eqNullSafe(F.col("hit_title")))
    per = flat.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.col("pos") + 1)).alias("first"))
    per = asked.join(per, "query_id", "left")
    per = per.join(sizes, per["title"].eqNullSafe(sizes["title"])).select(
        "query_id",
        per["title"],
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce("hits", F.lit(0)) / F.col("n_expected"), 6).alias("recall"),
        F.round(F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)), 6).alias("precision"),
    )
    more = {m: f for m, f in EVALUATORS.items() if m not in BUILT_IN}
    if more:
        lists = expected.groupBy("title").agg(F.collect_list("id").alias("expected"))
        both = asked.join(hits, "query_id", "left").join(lists.withColumnRenamed("title", "_t"), F.col("title").eqNullSafe(F.col("_t")))
        per = per.join(both.select("query_id", *[F.round(f(F.coalesce("retrieved", F.array().cast("array<bigint>")), F.col("expected")), 6).alias(m) for m, f in more.items()]), "query_id")
    return per


def metrics_per_query(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder)


def _means(*by: str):
    def aggregate(df: DataFrame) -> DataFrame:
        out = []
        for m in EVALUATORS:
            out += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 6).alias(f"{m}_std")]
        return df.groupBy(*by).agg(F.count("*").alias("queries"), *out)

    return aggregate


def metrics_overall(spark: SparkSession, folder: str) -> DataFrame:
    return _means()(_evaluated(spark, folder))


def metrics_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return _means("title")(_evaluated(spark, folder))


def metrics_by_difficulty(spark: SparkSession, folder: str) -> DataFrame:
    """Of the questions of each difficulty: how well the chunks that they expect are searched from."""
    expected = expected_chunks(spark, folder).select("question_id", F.explode("expected").alias("query_id"))
    q = records(spark, folder, "questions", "question_id", "difficulty")
    x = expected.join(_evaluated(spark, folder), "query_id").join(q, "question_id")
    return x.groupBy("difficulty").agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr_mean"), F.round(F.avg("recall"), 6).alias("recall_mean"))


def metrics_described(spark: SparkSession, folder: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and most of each measure."""
    x = _evaluated(spark, folder).select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in EVALUATORS])))
    quartile = lambda p: F.round(F.percentile("x", F.lit(p)), 6)
    return x.groupBy("measure").agg(
        F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("least"),
        quartile(0.25).alias("lower"), quartile(0.5).alias("middle"), quartile(0.75).alias("upper"), F.max("x").alias("most"),
    )


def metrics_dry_run(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of the first three queries, as a look before a whole run."""
    return _evaluated(spark, folder).orderBy("query_id").limit(3)


QUERIES = {f.__name__: f for f in (
    semantic_topk, semantic_by_cells, fts_matches, fts_plain, fts_english, fts_topk, fts_competition_rank, term_postings, hybrid_rrf, hybrid_pseudo_rank, hybrid_weighted, hybrid_english, search_hits,
    metrics_per_query, metrics_overall, metrics_by_group, metrics_by_difficulty, metrics_described, metrics_dry_run,
)}

_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "]"
_CHUNKS = """
c AS (SELECT DISTINCT id, text, title, cue_start, cue_end, embedding FROM fixed_chunks),
"""
_WORDS = _CHUNKS + "w AS (SELECT id, coalesce(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), []) AS words FROM c),"
_NEEDS = f"list_filter(list_sort(list_distinct([words[2], words[3], words[5]])), lambda x: NOT list_contains({_STOP}, x)) AS needs"
_WEB = f"""
q AS (SELECT id AS query_id, 1 AS alt, {_NEEDS}, ' ' || words[2] || ' ' || words[3] || ' ' AS phrase, words[-1] AS bar FROM w WHERE id % 20 = 0
      UNION ALL
      SELECT id, 2, list_filter(list_sort(list_distinct([words[8], words[9]])), lambda x: NOT list_contains({_STOP}, x)), '', NULL FROM w WHERE id % 20 = 0),
"""
_PLAIN = f"q AS (SELECT id AS query_id, 1 AS alt, {_NEEDS}, '' AS phrase, NULL AS bar FROM w WHERE id % 20 = 0),"
_MATCHED = """
m AS (SELECT query_id, id, needs, words, list_filter(range(1, len(words) + 1), lambda i: list_contains(needs, words[i])) AS places
      FROM q JOIN w ON list_has_all(words, needs) AND contains(' ' || array_to_string(words, ' ') || ' ', phrase) AND (bar IS NULL OR NOT list_contains(words, bar))
      WHERE len(needs) > 0),
e AS (SELECT query_id, id, needs, u.e AS e, list_min(list_transform(needs, lambda x: list_max(list_filter(places, lambda i: i <= u.e AND words[i] = x)))) AS o,
             len(list_filter(needs, lambda x: len(list_filter(places, lambda i: i <= u.e AND words[i] = x)) > 0)) = len(needs) AS complete
      FROM m, unnest(places) AS u(e)),
k AS (SELECT query_id, id, needs, o, min(e) AS e FROM e WHERE complete GROUP BY query_id, id, needs, o),
s AS (SELECT query_id, id, needs, round(sum(0.1 / (1 + greatest(e - o - (len(needs) - 1), 0))), 6) AS cover FROM k GROUP BY query_id, id, needs),
h AS (SELECT m.query_id, m.id, max(round(len(places) / len(words), 6)) AS tf_score, max(cover) AS cover_score
      FROM m JOIN s ON s.query_id = m.query_id AND s.id = m.id AND s.needs = m.needs GROUP BY m.query_id, m.id)
"""
_HITS = _WORDS + _WEB + _MATCHED


def _branches_sql(hits: str, score: str, most: int) -> str:
    return "WITH " + hits + f""",
p AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM c a, c b WHERE a.id % 20 = 0),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) WHERE rank <= {2 * most}),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rank FROM h) WHERE rank <= {2 * most}),
"""


def _rrf_sql(most: int) -> str:
    return _branches_sql(_HITS, "cover_score", most) + f"""
b AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id, coalesce(similarity, 0) AS similarity_score, coalesce(cover_score, 0) AS fts_score,
             round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + t.rank), 0), 9) AS hybrid_score
      FROM v FULL OUTER JOIN t ON v.query_id = t.query_id AND v.id = t.id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) AS rank FROM b) WHERE rank <= {most})
"""


_RRF = _rrf_sql(MATCHES)
_PER_QUERY = _rrf_sql(RETRIEVED) + """,
x AS (SELECT r.query_id, r.rank, hc.title IS NOT DISTINCT FROM qc.title AS hit FROM r JOIN c qc ON qc.id = r.query_id JOIN c hc ON hc.id = r.id),
n AS (SELECT title, count(*) AS n FROM c GROUP BY title),
g AS (SELECT query_id, min(CASE WHEN hit THEN rank END) AS first, count(*) FILTER (hit) AS hits, count(*) AS n FROM x GROUP BY query_id),
y AS (SELECT c.id AS query_id, c.title, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(hits, 0) / n.n, 6) AS recall, round(coalesce(hits / g.n, 0), 6) AS precision
      FROM c LEFT JOIN g ON g.query_id = c.id JOIN n ON n.title IS NOT DISTINCT FROM c.title WHERE c.id % 20 = 0)
"""
_MEANS = "count(*) AS queries, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in ("mrr", "recall", "precision"))

SQL = {
    "semantic_topk": """
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
           FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10
""",
    "fts_matches": f"WITH {_HITS} SELECT * FROM h",
    "fts_plain": f"WITH {_WORDS + _PLAIN + _MATCHED} SELECT * FROM h",
    "fts_topk": f"WITH {_HITS} SELECT query_id, id, cover_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cover_score DESC, id) AS rank FROM h) WHERE rank <= {2 * MATCHES}",
    "fts_competition_rank": f"WITH {_HITS} SELECT query_id, id, tf_score, CAST(rank() OVER (PARTITION BY query_id ORDER BY tf_score DESC) AS INT) AS place FROM h",
    "term_postings": r"""
WITH d AS (SELECT doc_id, unnest(l) AS lexeme, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS l FROM documents)),
p AS (SELECT lexeme, doc_id, count(*) AS tf, min(pos) AS first FROM d GROUP BY lexeme, doc_id)
SELECT lexeme, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most, min(first) AS earliest FROM p GROUP BY lexeme
""",
    "hybrid_rrf": _RRF + "SELECT r.id, query_id, similarity_score, fts_score, hybrid_score, CAST(rank AS INT) AS rank, title FROM r JOIN c ON c.id = r.id",
    "hybrid_pseudo_rank": _branches_sql(_WORDS + _PLAIN + _MATCHED, "tf_score", MATCHES) + f"""
u AS (SELECT query_id, id, similarity, NULL AS fts FROM v UNION ALL SELECT query_id, id, NULL, tf_score FROM t),
g AS (SELECT query_id, id, max(coalesce(similarity, 0)) AS similarity_score, max(coalesce(fts, 0)) AS fts_score FROM u GROUP BY query_id, id),
z AS (SELECT *, 1 + (SELECT count(*) FROM g g2 WHERE g2.query_id = g.query_id AND g2.fts_score > g.fts_score) AS place FROM g),
f AS (SELECT query_id, id, similarity_score, fts_score, round(1.0 / (60 + CASE WHEN similarity_score > 0 THEN 1 + (1 - similarity_score) * {2 * MATCHES - 1} ELSE {2 * MATCHES} END)
             + 1.0 / (60 + CASE WHEN fts_score > 0 THEN place ELSE {2 * MATCHES} END), 9) AS hybrid_score FROM z)
SELECT query_id, id, similarity_score, fts_score, hybrid_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) AS rank FROM f) WHERE rank <= {MATCHES}
""",
    "hybrid_weighted": _branches_sql(_HITS, "tf_score", MATCHES) + f"""
b AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id, coalesce(similarity, 0) AS similarity_score, coalesce(tf_score, 0) AS fts_score
      FROM v FULL OUTER JOIN t ON v.query_id = t.query_id AND v.id = t.id),
f AS (SELECT *, round(CAST(0.7 AS DOUBLE) * similarity_score + (1 - CAST(0.7 AS DOUBLE)) * fts_score, 9) AS hybrid_score FROM b)
SELECT query_id, id, similarity_score, fts_score, hybrid_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) AS rank FROM f) WHERE rank <= {MATCHES}
""",
    "search_hits": _RRF + """
SELECT query_id, CAST(rank AS INT) AS rank, printf('%d. %s', rank, coalesce(title, 'untitled')) || E'\\nTime: ' || printf('%.1fs - %.1fs', round(cue_start, 1), round(cue_end, 1))
       || E'\\nScores: ' || printf('hybrid %.4f, similarity %.4f, text %.4f', round(hybrid_score, 4), round(similarity_score, 4), round(CAST(fts_score AS DOUBLE), 4))
       || E'\\n' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS hit FROM r JOIN c ON c.id = r.id WHERE rank <= 5
""",
    "metrics_by_difficulty": f"""
WITH measured AS ({_PER_QUERY} SELECT * FROM y), asked AS ({groundtruth.SQL['questions_mapped'].partition("SELECT question_id, '['")[0]} SELECT question_id, unnest(expected) AS query_id FROM x WHERE expected IS NOT NULL)
SELECT difficulty, count(*) AS n, round(avg(mrr), 6) AS mrr_mean, round(avg(recall), 6) AS recall_mean
FROM asked a JOIN measured m ON m.query_id = a.query_id JOIN (SELECT DISTINCT question_id, difficulty FROM questions) d ON d.question_id = a.question_id GROUP BY difficulty
""",
    "metrics_described": _PER_QUERY + """,
u AS (SELECT 'mrr' AS measure, mrr AS x FROM y UNION ALL SELECT 'recall', recall FROM y UNION ALL SELECT 'precision', precision FROM y)
SELECT measure, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS least, round(quantile_cont(x, 0.25), 6) AS lower, round(quantile_cont(x, 0.5), 6) AS middle,
       round(quantile_cont(x, 0.75), 6) AS upper, max(x) AS most FROM u GROUP BY measure
""",
    "metrics_dry_run": _PER_QUERY + "SELECT * FROM y ORDER BY query_id LIMIT 3",
    "metrics_per_query": _PER_QUERY + "SELECT * FROM y",
    "metrics_overall": _PER_QUERY + f"SELECT {_MEANS} FROM y",
    "metrics_by_group": _PER_QUERY + f"SELECT title, {_MEANS} FROM y GROUP BY title",
}
