"""Queries over chunks and their lines, and allocation over topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import allocate as A
from studyloom.operators import chunking as K
from studyloom.operators import layout as L
from studyloom.operators import performance as P
from studyloom.plans.performance import GRADED, _counters
from studyloom.plans.registry import query
from studyloom.session import table

LINES = """l0 AS (SELECT DISTINCT source_file, chunk_id, chunk_index, text FROM chunk),
l AS (SELECT source_file, chunk_id, chunk_index, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) - 1 AS line_no, UNNEST(STRING_SPLIT(text, chr(10))) AS text FROM l0)
"""
ORDER = ["chunk_index", "chunk_id", "line_no"]


def _chunks(spark, d):
    return table(spark, d, "chunk")


def _lines(spark, d):
    return L.chunk_lines(_chunks(spark, d))


@query(f"WITH {LINES} SELECT source_file, COUNT(*) AS lines, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars FROM l GROUP BY 1")
def book_sizes(spark, d):
    return _lines(spark, d).groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query(
    f"""WITH {LINES}, n AS (SELECT source_file, chunk_id, REGEXP_REPLACE(LOWER(text), '[^\\p{{L}}]', '', 'g') AS letters FROM l)
SELECT source_file, letters, COUNT(DISTINCT chunk_id) AS chunks FROM n WHERE LENGTH(letters) BETWEEN 4 AND 60 GROUP BY 1, 2 HAVING COUNT(DISTINCT chunk_id) >= 2"""
)
def running_headers(spark, d):
    return L.repeated_lines(_lines(spark, d))


@query(
    f"""WITH {LINES}, n AS (SELECT *, SUM(REGEXP_MATCHES(text, '^\\s*(?:Q\\s*)?\\d{{1,2}}[.)]\\s+\\S')::INT) OVER (PARTITION BY source_file ORDER BY chunk_index, chunk_id, line_no ROWS UNBOUNDED PRECEDING) AS item FROM l)
SELECT source_file, CAST(item AS BIGINT) AS item, STRING_AGG(text, ' ' ORDER BY chunk_index, chunk_id, line_no) AS text, COUNT(*) AS lines FROM n WHERE item > 0 GROUP BY ALL"""
)
def numbered_items(spark, d):
    return L.question_groups(_lines(spark, d), ORDER)


@query(
    f"""WITH RECURSIVE {LINES}, o AS (SELECT source_file, chunk_id, line_no, LENGTH(text) AS n FROM l),
f AS (SELECT source_file, chunk_id, 0 AS line_no, n AS used, 0 AS piece FROM o WHERE line_no = 0
UNION ALL SELECT o.source_file, o.chunk_id, o.line_no::INT, CASE WHEN f.used > 0 AND f.used + o.n > 2000 THEN o.n ELSE f.used + o.n END,
f.piece + (f.used > 0 AND f.used + o.n > 2000)::INT FROM f JOIN o ON o.chunk_id = f.chunk_id AND o.source_file = f.source_file AND o.line_no = f.line_no + 1)
SELECT chunk_id, piece, COUNT(*) AS lines, CAST(SUM(n) AS BIGINT) AS chars FROM f JOIN o USING (source_file, chunk_id, line_no) GROUP BY 1, 2"""
)
def chunk_paragraphs(spark, d):
    p = K.packed(_lines(spark, d), ["source_file", "chunk_id"], ["line_no"])
    return p.groupBy("chunk_id", "piece").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query(
    """WITH s AS (SELECT chunk_id, REGEXP_REPLACE(text, '\\s+', ' ', 'g') AS text FROM (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunk)),
x AS (SELECT chunk_id, STRING_SPLIT(REGEXP_REPLACE(REPLACE(text, 'Fig.', 'Fig' || chr(2)), '([.!?])\\s+', '\\1' || chr(3), 'g'), chr(3)) AS parts FROM s),
y AS (SELECT chunk_id, GENERATE_SUBSCRIPTS(parts, 1)::INT - 1 AS pos, REPLACE(UNNEST(parts), chr(2), '.') AS sentence FROM x)
SELECT chunk_id, pos, sentence FROM y WHERE REGEXP_MATCHES(LOWER(sentence), 'as shown (in|below|above)|shown in (the )?figure|in the figure (below|above)|the diagram illustrates|figure\\s+\\d+\\.\\d+\\s+shows|in the (above|below) (figure|diagram)|the (figure|diagram) (below|above) shows')"""
)
def figure_sentences(spark, d):
    return K.figure_sentences(_chunks(spark, d).dropDuplicates(["chunk_id"]))


@query(
    """WITH r AS (SELECT DISTINCT ON (chunk_id) source_file, chunk_id, chunk_index, text, images FROM chunk),
f AS (SELECT DISTINCT source_file, i.image_file AS image_file, i.caption AS caption FROM (SELECT source_file, UNNEST(images) AS i FROM r)),
j AS (SELECT f.source_file, f.image_file, c.chunk_id, c.chunk_index FROM f LEFT JOIN r c ON c.source_file = f.source_file AND CONTAINS(REGEXP_REPLACE(LOWER(c.text), '\\s+', ' ', 'g'), LOWER(f.caption)))
SELECT source_file, image_file, ARG_MIN(chunk_id, ROW(chunk_index, chunk_id)) AS chunk_id FROM j GROUP BY 1, 2"""
)
def substring_link(spark, d):
    return K.figures_in_chunks(_chunks(spark, d))


@query(
    f"""WITH {LINES}, t AS (SELECT DISTINCT chunk_id, line_no, text FROM l WHERE REGEXP_MATCHES(text, '^\\s*\\|.*\\|\\s*$') AND NOT REGEXP_MATCHES(text, '^[\\s|:-]+$')),
c AS (SELECT chunk_id, line_no, LIST_TRANSFORM(STRING_SPLIT(REGEXP_REPLACE(TRIM(text), '^\\||\\|$', '', 'g'), '|'), lambda x: TRIM(x)) AS cells FROM t)
SELECT chunk_id, CAST(line_no AS INT) AS line_no, ARRAY_TO_STRING(cells, ';') AS cells, LEN(cells)::INT AS width FROM c"""
)
def table_rows(spark, d):
    return K.tables_in_chunks(_chunks(spark, d))


@query(
    """WITH r AS (SELECT chunk_id, repair_id, before, COALESCE(after, '') AS after, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY repair_id, before, after) AS k FROM (SELECT DISTINCT * FROM source_repairs WHERE chunk_id IS NOT NULL AND before <> '')),
c AS (SELECT DISTINCT chunk_id, text FROM chunk WHERE chunk_id IN (SELECT chunk_id FROM r)), m AS (SELECT chunk_id, MAX(k) AS m FROM r GROUP BY 1),
s AS (WITH RECURSIVE s AS (SELECT chunk_id, text AS t0, text, 0::BIGINT AS k FROM c UNION ALL SELECT s.chunk_id, t0, REPLACE(s.text, r.before, r.after), r.k FROM s JOIN r ON r.chunk_id = s.chunk_id AND r.k = s.k + 1) SELECT * FROM s)
SELECT chunk_id, text, text <> t0 AS changed FROM s JOIN m USING (chunk_id) WHERE k = m"""
)
def source_repair(spark, d):
    return K.repaired(_chunks(spark, d), table(spark, d, "source_repairs"))


@query(
    """WITH k AS (SELECT chunk_id, source_file, CASE WHEN LOWER(TRIM(chapter)) NOT IN ('unknown', '') THEN chapter END AS chapter FROM chunk),
v AS (SELECT source_file, chapter, COUNT(*) AS n FROM k WHERE chapter IS NOT NULL GROUP BY ALL), b AS (SELECT source_file, ARG_MAX(chapter, ROW(n, chapter)) AS book_chapter FROM v GROUP BY 1)
SELECT chunk_id, COALESCE(chapter, book_chapter, 'Unknown') AS chapter, chapter IS NULL AS patched FROM (SELECT DISTINCT * FROM k) LEFT JOIN b USING (source_file)"""
)
def metadata_patch(spark, d):
    return K.titled(_chunks(spark, d))


@query("SELECT class, subject, LOWER(topic) AS title, COUNT(DISTINCT source_file) AS books FROM chunk GROUP BY ALL HAVING COUNT(DISTINCT source_file) >= 2")
def recurring_titles(spark, d):
    return K.recurring_titles(_chunks(spark, d))


@query(
    """WITH r AS (SELECT DISTINCT ON (chunk_id) source_file, topic_number, topic, chunk_index, chunk_id FROM chunk)
SELECT source_file, chunk_id, CAST(SUM((chunk_index = 0)::INT) OVER (PARTITION BY source_file ORDER BY LIST_TRANSFORM(REGEXP_EXTRACT_ALL(COALESCE(topic_number, ''), '\\d+'), lambda x: CAST(x AS INT)), topic, chunk_index, chunk_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS ordinal FROM r"""
)
def topic_ordinals(spark, d):
    return K.topic_ordinals(_chunks(spark, d))


@query(
    """SELECT COALESCE(chunk_id, '') AS chunk_id, COALESCE(class, '') AS class, COALESCE(subject, '') AS subject, COALESCE(source_file, '') AS source_file, COALESCE(chapter, '') AS chapter, COALESCE(CAST(chapter_number AS VARCHAR), '') AS chapter_number,
COALESCE(topic, '') AS topic, COALESCE(topic_number, '') AS topic_number, COALESCE(CAST(chunk_index AS VARCHAR), '') AS chunk_index, COALESCE(has_table, FALSE) AS has_table,
'[' || ARRAY_TO_STRING(LIST_TRANSFORM(figure_dependent_spans, lambda s: TO_JSON(s)::VARCHAR), ',') || ']' AS spans,
'[' || ARRAY_TO_STRING(LIST_TRANSFORM(images, lambda i: '{"image_file":' || COALESCE(TO_JSON(i.image_file)::VARCHAR, 'null') || ',"caption":' || COALESCE(TO_JSON(i.caption)::VARCHAR, 'null') || '}'), ',') || ']' AS images FROM chunk"""
)
def flat_metadata(spark, d):
    return K.flat_metadata(_chunks(spark, d))


@query(
    """WITH c AS (SELECT DISTINCT source_file FROM chunk WHERE class <> '12'), a AS (SELECT DISTINCT source_file FROM chunk) SELECT source_file FROM a ANTI JOIN c USING (source_file)"""
)
def resume_antijoin(spark, d):
    """Books that are still to do when those of the other classes are done."""
    c = _chunks(spark, d).select("source_file", "class")
    return c.select("source_file").distinct().join(c.where("class <> '12'").select("source_file").distinct(), "source_file", "left_anti")


@query(
    """WITH u AS (SELECT DISTINCT class || '/' || subject || '/' || chapter AS scope, topic FROM chunk WHERE topic IS NOT NULL),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scope ORDER BY topic) - 1 AS pos, COUNT(*) OVER (PARTITION BY scope) AS n FROM u)
SELECT scope, topic, CAST(pos AS INT) AS pos, CAST(25 // n + (((pos - 2) % n + n) % n < 25 % n)::INT AS INT) AS share FROM p"""
)
def alloc_round_robin(spark, d):
    units = _chunks(spark, d).where("topic IS NOT NULL").select(F.concat_ws("/", "class", "subject", "chapter").alias("scope"), "topic").distinct()
    return A.equal_shares(units, "scope", "topic", 25, start=2)


@query(
    GRADED
    + """, b AS (SELECT user_id, class || '/' || subject || '/' || chapter || '/' || topic AS unit, SUM(correct_count) AS k, SUM(total_count) AS n FROM c GROUP BY ALL),
w AS (SELECT user_id, unit, ROUND(COALESCE(GREATEST(0.0, 1 - CASE WHEN n >= 3 THEN k::DOUBLE / n END), 0.5), 6) AS weight FROM b),
x AS (SELECT *, CASE WHEN weight > 0 THEN ROUND(-LN(GREATEST(('0x' || SUBSTR(SHA256('11|' || user_id || '|' || unit), 1, 13))::BIGINT / POW(16, 13), 1e-300)) / weight, 9) END AS draw FROM w)
SELECT user_id, unit, weight, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY draw IS NULL, draw, unit) AS INT) AS rank FROM x QUALIFY rank <= 5"""
)
def alloc_weighted(spark, d):
    w = P.accuracy_weight(_counters(spark, d))
    units = w.select("user_id", F.concat_ws("/", "class", "subject", "chapter", "topic").alias("unit"), "weight")
    return A.weighted_sample(units, "user_id", "unit", "weight", 5).select("user_id", "unit", "weight", "rank")


@query("SELECT class, subject, COUNT(DISTINCT chapter) AS chapters, COUNT(DISTINCT topic) AS topics FROM chunk GROUP BY ALL")
def subject_counts(spark, d):
    return _chunks(spark, d).groupBy("class", "subject").agg(F.countDistinct("chapter").alias("chapters"), F.countDistinct("topic").alias("topics"))
