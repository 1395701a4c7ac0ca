"""SQL that states the results of problems 4, 5 and 7, for small tables: it compares everything
with everything and is no way to compute them."""

P4_FOUND = """
WITH r AS (SELECT DISTINCT 'quote' AS record_kind, quote_id AS record_id, quoted_text AS t FROM insight_quotes UNION SELECT DISTINCT 'chunk', id, text FROM fixed_chunks),
w AS (SELECT record_kind, record_id, p, substring(t, p + 1, 120) AS run FROM (SELECT *, unnest(range(0, length(t) - 119)) AS p FROM r WHERE length(t) >= 120)),
s AS (SELECT run FROM w GROUP BY run HAVING count(DISTINCT record_kind || record_id) > 1),
h AS (SELECT record_kind, record_id, p FROM w WHERE run IN (SELECT run FROM s)),
n AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY record_kind, record_id ORDER BY p) + 120 THEN 0 ELSE 1 END AS fresh FROM h),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY record_kind, record_id ORDER BY p) AS island FROM n)
SELECT record_kind, record_id, CAST(min(p) AS INT) AS span_start, CAST(max(p) + 120 AS INT) AS span_end FROM g GROUP BY record_kind, record_id, island
"""

P4_SHARED_PART = f"""
WITH f AS ({P4_FOUND}),
t AS (SELECT DISTINCT 'quote' AS record_kind, quote_id AS record_id, length(quoted_text) AS n FROM insight_quotes UNION SELECT DISTINCT 'chunk', id, length(text) FROM fixed_chunks)
SELECT f.record_kind, f.record_id, CAST(n AS INT) AS text_length, CAST(sum(span_end - span_start) AS BIGINT) AS shared_length, round(sum(span_end - span_start) / n, 6) AS shared_part
FROM f JOIN t ON t.record_kind = f.record_kind AND t.record_id = f.record_id GROUP BY f.record_kind, f.record_id, n
"""

_NOTES = r"[\(\[<]?\b\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\b[\)\]>]?|\(\([^()]*\)\)|\([^()\d]*\)|\[[^\[\]\d]*\]|<[^<>\d]*>|\*[^*\d]+\*|♪[^♪]*♪|♪+"
_LABEL = r"(?i)^(?:>>|-)?\s*(?:\[\s*(?:speaker|spk|s)[ _#-]*(\d+)(?:\.0+)?\s*\]\s*:?|(?:speaker|spk|s)[ _#-]*(\d+)(?:\.0+)?\s*(?::|\s-\s))"
P5_FOUND = rf"""
WITH c AS (SELECT DISTINCT segment_id, video_id, cue_start, lower(trim(vimeo_generated_speaker)) AS f, trim(regexp_replace(text, '{_NOTES}', ' ', 'g'), E' \t\n\r') AS b FROM segments WHERE text IS NOT NULL),
l AS (SELECT *, coalesce(nullif(regexp_extract(b, '{_LABEL}', 1), ''), nullif(regexp_extract(b, '{_LABEL}', 2), ''), nullif(regexp_extract(f, '^(?:(?:speaker|spk|s)[ _#-]*)?(\d+)(?:\.0+)?$', 1), ''),
             CAST(nullif(list_position(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], regexp_extract(f, '^speaker ([a-z]+)$', 1)), 0) - 1 AS VARCHAR)) AS named,
             list_filter(regexp_extract_all(lower(regexp_replace(b, '{_LABEL}', ' ')), '[\p{{L}}\p{{N}}]+'), lambda w: NOT regexp_full_match(w, 'u+h+m*|u+m+|h+m+|e+r+m*|a+h+m+')) AS said FROM c),
k AS (SELECT video_id, segment_id, cue_start, last_value(CAST(named AS INT) IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY cue_start NULLS FIRST, segment_id) AS s FROM l WHERE len(said) > 0),
n AS (SELECT *, CASE WHEN lag(segment_id) OVER w IS NOT NULL AND lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY video_id ORDER BY cue_start NULLS FIRST, segment_id)),
t AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY video_id ORDER BY cue_start NULLS FIRST, segment_id) AS INT) AS turn_no FROM n)
SELECT video_id, turn_no, any_value(s) AS speaker_no, arg_min(segment_id, (cue_start, segment_id)) AS first_segment_id, arg_max(segment_id, (cue_start, segment_id)) AS last_segment_id FROM t GROUP BY video_id, turn_no
"""

P7_FOUND = r"""
WITH d AS (SELECT doc_id AS k, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
e AS (SELECT item_id AS k, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items)),
x AS (SELECT k, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
y AS (SELECT k, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING))
SELECT DISTINCT x.k AS doc_id, y.k AS item_id FROM x JOIN y ON x.run = y.run WHERE x.n = 13 AND y.n = 13
"""

P7_PASSAGES = r"""
WITH t AS (SELECT doc_id AS k, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
u AS (SELECT k, unnest(w) AS part, unnest(range(0, len(w))) AS n FROM t),
o AS (SELECT k, part, sum(length(part)) OVER (PARTITION BY k ORDER BY n) AS until FROM u),
d AS (SELECT k, lower(part) AS word, until - length(part) AS a, until AS z, row_number() OVER (PARTITION BY k ORDER BY until) AS i FROM o WHERE regexp_matches(part, '^[\p{L}\p{N}]')),
e AS (SELECT item_id AS k, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items)),
x AS (SELECT k, i, a, last_value(z) OVER w AS z, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
y AS (SELECT k, string_agg(word, ' ') OVER w AS run, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
h AS (SELECT DISTINCT x.k AS doc_id, y.k AS item_id, x.i, x.a, x.z FROM x JOIN y ON x.run = y.run WHERE x.n = 13 AND y.n = 13),
f AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) + 12 THEN 0 ELSE 1 END AS fresh FROM h),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS island FROM f)
SELECT doc_id, item_id, CAST(min(a) AS INT) AS start, CAST(max(z) AS INT) AS "end" FROM g GROUP BY doc_id, item_id, island
"""

SQL = {"p7_passages": P7_PASSAGES, "p4_found": P4_FOUND, "p4_shared_part": P4_SHARED_PART, "p5_found": P5_FOUND, "p7_found": P7_FOUND}
