"""Queries over page layout: detectors, segments, titles, styles. The tables hold no pages, so a book's chunks stand in for them, in order; sizes,
styles and positions are made from a line's length, the same way in the SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import chunking as K
from studyloom.operators import detectors as D
from studyloom.operators import layout as L
from studyloom.operators import names as N
from studyloom.plans.registry import query
from studyloom.session import ship, table

PAGES = """l0 AS (SELECT DISTINCT source_file AS doc, chunk_id, chunk_index, text FROM chunk),
l1 AS (SELECT doc, DENSE_RANK() OVER (PARTITION BY doc ORDER BY chunk_index, chunk_id)::INT - 1 AS page, chunk_id, text FROM l0),
l2 AS (SELECT doc, page, chunk_id, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1)::INT - 1 AS part, UNNEST(STRING_SPLIT(text, chr(10))) AS text FROM l1),
lines AS (SELECT doc, page, ROW_NUMBER() OVER (PARTITION BY doc, page ORDER BY chunk_id, part, text)::INT - 1 AS line_no, text FROM l2),
p AS (SELECT *, line_no // 4 AS block, 10.0::DOUBLE + LENGTH(text) % 7 AS size, LENGTH(text) % 2 = 0 AS bold, 'f' || (LENGTH(text) % 3) AS font, (LENGTH(text) % 4)::INT AS color, 60.0::DOUBLE * (LENGTH(text) % 5) AS x0, 60.0::DOUBLE * (LENGTH(text) % 5) + 100 AS x1 FROM lines)
"""
HEAD = "'^\\s*(\\d{1,2}(?:\\.\\d{1,2})+)\\.?\\s+(\\S.*)$'"


def pages(spark, d):
    n = F.length("text")
    rows = table(spark, d, "chunk").select(F.col("source_file").alias("doc"), "chunk_id", "chunk_index", "text").distinct()
    rows = rows.withColumn("page", F.dense_rank().over(Window.partitionBy("doc").orderBy("chunk_index", "chunk_id")) - 1)
    lines = rows.select("doc", "page", "chunk_id", F.posexplode(F.split("text", "\n")).alias("part", "text"))
    by = Window.partitionBy("doc", "page").orderBy("chunk_id", "part", "text")
    return lines.withColumn("line_no", F.row_number().over(by) - 1).select(
        "doc", "page", "line_no", "text", F.floor(F.col("line_no") / 4).cast("int").alias("block"), (F.lit(10.0) + n % 7).alias("size"), (n % 2 == 0).alias("bold"),
        F.concat(F.lit("f"), (n % 3).cast("string")).alias("font"), (n % 4).cast("int").alias("color"), (60.0 * (n % 5)).alias("x0"), (60.0 * (n % 5) + 100).alias("x1"),
    )


def fragment(t: str) -> str:
    words = f"LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(TRIM({t}), '\\s+'), lambda w: w <> '')"
    long_ = f"LIST_FILTER({words}, lambda w: LENGTH(w) > 3)"
    big = f"LIST_FILTER({long_}, lambda w: REGEXP_MATCHES(w, '^\\p{{Lu}}'))"
    return f"((UPPER({t}) = {t} AND REGEXP_MATCHES({t}, '\\p{{L}}')) OR (LEN({words}) <= 6 AND REGEXP_MATCHES(TRIM({t}), '^\\p{{Lu}}')) OR (LEN({long_}) > 0 AND LEN({big}) >= 0.8 * LEN({long_})))"


def plausible(t: str) -> str:
    return f"(REGEXP_MATCHES({t}, '^\\p{{L}}') AND LENGTH(REGEXP_REPLACE({t}, '[^\\p{{L}}]', '', 'g')) * 2 >= LENGTH({t}) AND {fragment(t)} AND NOT REGEXP_MATCHES({t}, '[.;:,]$'))"


NUMBERED = f"""n0 AS (SELECT *, REGEXP_EXTRACT(text, {HEAD}, 1) AS number, TRIM(REGEXP_EXTRACT(text, {HEAD}, 2)) AS name FROM p WHERE REGEXP_MATCHES(text, {HEAD})),
n1 AS (SELECT *, CAST(SPLIT_PART(number, '.', 1) AS INT) AS major, CAST(SPLIT_PART(number, '.', 2) AS INT) AS minor FROM n0 WHERE {plausible('name')}),
top AS (SELECT doc, MAX(size) AS heading_size FROM n1 GROUP BY 1),
votes AS (SELECT doc, heading_size, major, COUNT(*) AS v, MIN(ROW(page, line_no)) AS seen FROM n1 JOIN top USING (doc) WHERE size >= heading_size - 0.5 GROUP BY ALL),
cal AS (SELECT doc, heading_size, ARG_MIN(major, ROW(-v, seen)) AS major FROM votes GROUP BY ALL),
cand AS (SELECT n1.*, size >= heading_size - 0.5 AS sure FROM n1 JOIN cal USING (doc, major) QUALIFY ROW_NUMBER() OVER (PARTITION BY doc, number ORDER BY page, line_no) = 1),
seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY page, line_no) AS k FROM cand),
fold AS (WITH RECURSIVE f AS (SELECT doc, k, page, line_no, number, name, TRUE AS kept, minor AS last FROM seq WHERE k = 1
UNION ALL SELECT s.doc, s.k, s.page, s.line_no, s.number, s.name, s.sure OR s.minor > f.last, CASE WHEN s.sure OR s.minor > f.last THEN GREATEST(f.last, s.minor) ELSE f.last END FROM f JOIN seq s ON s.doc = f.doc AND s.k = f.k + 1) SELECT * FROM f)
"""


@query(f"WITH {PAGES}, {NUMBERED} SELECT doc, heading_size, major FROM cal")
def layout_calibration(spark, d):
    return D.calibration(pages(spark, d))


@query(f"WITH {PAGES}, {NUMBERED} SELECT doc, page, line_no, number, name FROM fold WHERE kept")
def layout_numbered(spark, d):
    ship(spark)
    return D.numbered(pages(spark, d))


KEY = "REGEXP_REPLACE(UPPER(text), '[^\\p{L}]', '', 'g')"
RUNNING = f"""pg AS (SELECT doc, COUNT(DISTINCT page) AS pages FROM p GROUP BY 1), ks AS (SELECT doc, page, {KEY} AS key FROM p),
run AS (SELECT doc, key FROM (SELECT doc, key, COUNT(DISTINCT page) AS n FROM ks WHERE key <> '' GROUP BY ALL) JOIN pg USING (doc) WHERE n >= GREATEST(2, pages // 4))
"""


@query(f"WITH {PAGES}, {RUNNING} SELECT doc, key FROM run")
def layout_running(spark, d):
    return D.running(pages(spark, d))


CAPS = f"""ends AS (SELECT doc, MIN(ROW(page, line_no)) AS stop FROM p WHERE REGEXP_MATCHES(text, '(?i)^\\s*(summary|exercises?|what you have learnt|key ?words|let us recall)\\b') GROUP BY 1),
c0 AS (SELECT p.*, {KEY} AS key FROM p LEFT JOIN ends USING (doc) WHERE UPPER(text) = text AND LENGTH({KEY}) >= 4 AND NOT REGEXP_MATCHES(text, '(?i)^\\s*(table|fig(ure)?)\\b|\\d{{3,}}') AND NOT REGEXP_MATCHES(text, '[.:;]$') AND (stop IS NULL OR ROW(page, line_no) < stop)),
c1 AS (SELECT doc, page, block, MIN(line_no) AS line_no, LIST(TRIM(text) ORDER BY line_no) AS l FROM c0 ANTI JOIN run USING (doc, key) GROUP BY ALL),
c2 AS (SELECT doc, page, line_no, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(LOWER(ARRAY_TO_STRING(l, ' ')), '\\s+'), lambda w: w <> '') AS w FROM c1)
"""
CORE = "REGEXP_REPLACE(w[i], '^[.,:;!?()''\"]+|[.,:;!?()''\"]+$', '', 'g')"
MINOR = "[" + ", ".join(f"'{m}'" for m in T.MINOR) + "]"
HEADLINE = f"ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(1, LEN(w) + 1), lambda i: CASE WHEN i > 1 AND LIST_CONTAINS({MINOR}, {CORE}) THEN w[i] ELSE UPPER(w[i][1]) || w[i][2:] END), ' ')"


@query(
    f"""WITH {PAGES}, {RUNNING}, {CAPS}, c3 AS (SELECT doc, page, line_no, {HEADLINE} AS name FROM c2)
SELECT doc, page, line_no, NULL::VARCHAR AS number, name FROM c3 QUALIFY ROW_NUMBER() OVER (PARTITION BY doc, name ORDER BY page, line_no) = 1"""
)
def layout_capitals(spark, d):
    return D.all_caps(pages(spark, d).withColumn("text", F.col("text")))


@query(f"WITH w0 AS (SELECT DISTINCT topic, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(LOWER(topic), '\\s+'), lambda w: w <> '') AS w FROM chunk WHERE topic IS NOT NULL) SELECT topic, {HEADLINE} AS title FROM w0")
def headline_titles(spark, d):
    return table(spark, d, "chunk").where("topic IS NOT NULL").select("topic").distinct().select("topic", T.headline("topic").alias("title"))


OWN = "'^\\s*(\\d+(?:\\.\\d+)*)[.)]?\\s+\\S'"


@query(
    f"""WITH {PAGES} SELECT doc, page, line_no, NULLIF(REGEXP_EXTRACT(text, {OWN}, 1), '') AS number, TRIM(REGEXP_REPLACE(text, '^\\s*\\d+(?:\\.\\d+)*[.)]?\\s+', '')) AS name, CASE WHEN size BETWEEN 15.5 AND 16.5 THEN 1 ELSE 2 END AS tier
FROM p WHERE (size BETWEEN 15.5 AND 16.5 OR size BETWEEN 13.5 AND 14.5) AND LENGTH(TRIM(text)) > 2"""
)
def layout_size_tiers(spark, d):
    return D.size_tiers(pages(spark, d), (15.5, 16.5), (13.5, 14.5))


@query(
    f"""WITH {PAGES} SELECT doc, page, line_no, REGEXP_EXTRACT(text, {OWN}, 1) AS number, TRIM(REGEXP_REPLACE(text, '^\\s*\\d+(?:\\.\\d+)*[.)]?\\s+', '')) AS name, CASE WHEN size BETWEEN 13 AND 16 THEN 1 ELSE 2 END AS tier
FROM p WHERE size BETWEEN 10 AND 16 AND LENGTH(TRIM(text)) > 2 AND REGEXP_EXTRACT(text, {OWN}, 1) <> ''"""
)
def layout_numbered_tiers(spark, d):
    return D.size_tiers(pages(spark, d), (13.0, 16.0), (10.0, 12.5), own_number=True)


@query(
    f"""WITH {PAGES}, {NUMBERED}, h AS (SELECT doc, page, line_no, number, name, 1 AS head FROM fold WHERE kept),
m AS (SELECT p.doc, p.page, p.line_no, p.text, h.number, h.name, head, COALESCE(SUM(head) OVER (PARTITION BY p.doc ORDER BY p.page, p.line_no ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS ordinal FROM p LEFT JOIN h USING (doc, page, line_no)),
s AS (SELECT doc, ordinal, MAX(number) AS number, COALESCE(MAX(name), 'Introduction') AS name, COALESCE(STRING_AGG(CASE WHEN head IS NULL THEN text END, chr(10) ORDER BY page, line_no), '') AS text FROM m GROUP BY ALL)
SELECT * FROM s WHERE ordinal > 0 OR LENGTH(TRIM(text)) >= 80"""
)
def layout_segments(spark, d):
    """The text under each numbered heading of a book."""
    ship(spark)
    lines = pages(spark, d)
    return D.segments(lines, D.numbered(lines))


@query(
    f"""WITH {PAGES}, b AS (SELECT *, REGEXP_MATCHES(text, '^Activity ') AS starts FROM p),
s AS (SELECT *, SUM(starts::INT) OVER w AS box, LAST_VALUE(CASE WHEN starts THEN size END IGNORE NULLS) OVER w AS box_size FROM b WINDOW w AS (PARTITION BY doc, page ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, MAX(CASE WHEN NOT starts AND ABS(size - box_size) > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, box ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS gone FROM s)
SELECT doc, page, line_no, text FROM g WHERE box = 0 OR gone = 1"""
)
def layout_without_boxes(spark, d):
    return D.without_boxes(pages(spark, d), "^Activity ").select("doc", "page", "line_no", "text")


@query(
    """WITH r AS (SELECT DISTINCT source AS doc, id, REGEXP_REPLACE(question, '[\\n\\r]', ' ', 'g') AS question, REGEXP_REPLACE(COALESCE(answer, ''), '[\\n\\r]', ' ', 'g') AS answer FROM reference_corpus WHERE question IS NOT NULL AND source IS NOT NULL),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY id, question, answer) AS q FROM r)
SELECT doc, q, TRIM(REGEXP_REPLACE(question, '(?i)^\\s*(q\\s*\\d+[.)]|ans(wer)?[.:])', '')) AS question, TRIM(REGEXP_REPLACE(answer, '^\\s+', '')) AS answer FROM k
WHERE TRIM(answer) <> '' AND NOT REGEXP_MATCHES(question, '^\\s*Q\\s*\\d+[.)]') AND NOT REGEXP_MATCHES(question, '(?i)^\\s*ans(wer)?[.:]')"""
)
def layout_questions(spark, d):
    """Questions and answers printed one under another, and read again."""
    one = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\n\r]", " ").alias(c)
    r = table(spark, d, "reference_corpus").where("question IS NOT NULL AND source IS NOT NULL").select(F.col("source").alias("doc"), "id", one("question"), one("answer")).distinct()
    k = r.withColumn("q", F.row_number().over(Window.partitionBy("doc").orderBy("id", "question", "answer")))
    printed = F.array(F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(". "), "question"), F.concat(F.lit("Ans. "), "answer"))
    lines = k.select("doc", F.lit(0).alias("page"), "q", F.posexplode(printed).alias("part", "text")).select("doc", "page", (F.col("q") * 2 + F.col("part")).cast("int").alias("line_no"), "text")
    told = D.questions_answers(lines)
    plain = ~F.col("question").rlike(r"^\s*Q\s*\d+[.)]") & ~F.col("question").rlike(r"(?i)^\s*ans(wer)?[.:]")
    return told.where(plain).select("doc", F.col("q").cast("long").alias("q"), "question", "answer")


def titled(t: str) -> str:
    words = f"LEN(REGEXP_SPLIT_TO_ARRAY(TRIM({t}), '\\s+'))"
    return f"""(LENGTH(TRIM({t})) BETWEEN 2 AND 80 AND REGEXP_MATCHES(TRIM({t}), '^\\p{{Lu}}') AND NOT REGEXP_MATCHES(TRIM({t}), '[.,;:?!]$') AND {words} <= 8 AND NOT ({words} = 1 AND LENGTH(TRIM({t})) >= 20)
AND NOT REGEXP_MATCHES(TRIM({t}), '(?i)^(fig(ure)?|table|activity|unit|readings)\\b') AND NOT REGEXP_MATCHES(TRIM({t}), '(?i)\\s(a|an|and|of|the|in|on|to|with)$'))"""


COLORS = "body AS (SELECT doc, ARG_MAX(color, ROW(n, color)) AS body FROM (SELECT doc, color, SUM(LENGTH(text)) AS n FROM p GROUP BY ALL) GROUP BY 1)"


@query(f"WITH {PAGES}, {COLORS} SELECT doc, body AS color FROM body")
def layout_body_color(spark, d):
    return L.dominant_color(pages(spark, d))


@query(
    f"""WITH {PAGES}, {COLORS} SELECT doc, text AS title FROM p JOIN body USING (doc) WHERE page = 0 AND size > 13 AND color <> body AND {titled('text')} AND NOT REGEXP_MATCHES(text, '(?i)^unit\\b')
QUALIFY ROW_NUMBER() OVER (PARTITION BY doc ORDER BY size DESC, LENGTH(text) DESC, text) = 1"""
)
def layout_banner(spark, d):
    return D.banner(pages(spark, d))


@query(f"WITH {PAGES} SELECT size, bold, font, COUNT(*) AS n, ARG_MIN(text, ROW(page, line_no, doc, text)) AS sample FROM p GROUP BY ALL")
def layout_styles(spark, d):
    spans = pages(spark, d).withColumn("pos", F.struct("line_no", "doc", "text"))
    return L.style_histogram(spans)


@query(
    f"""WITH {PAGES}, m AS (SELECT *, (MIN(x0) OVER (PARTITION BY doc, page) + MAX(x1) OVER (PARTITION BY doc, page)) / 2 AS middle, AVG((x0 + x1) / 2) OVER (PARTITION BY doc, page, block) AS centre, MIN(line_no) OVER (PARTITION BY doc, page, block) AS first FROM p)
SELECT doc, page, line_no, ROW_NUMBER() OVER (PARTITION BY doc, page ORDER BY (centre >= middle)::INT, first, block, line_no)::INT AS place FROM m"""
)
def layout_columns(spark, d):
    return L.two_columns(pages(spark, d)).select("doc", "page", "line_no", "place")


RANGES = f"""hd AS (SELECT doc, page, LAST_VALUE(CASE WHEN REGEXP_MATCHES(text, {HEAD}) AND {plausible(f"TRIM(REGEXP_EXTRACT(text, {HEAD}, 2))")} THEN REGEXP_EXTRACT(text, {HEAD}, 1) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS heading FROM p),
ranges AS (SELECT doc, heading, MIN(page) AS first_page, MAX(page) AS last_page FROM hd WHERE heading IS NOT NULL GROUP BY ALL)
"""


def _ranges(lines):
    return L.page_ranges(L.with_current_heading(lines, ["page", "line_no"], "doc"))


@query(f"WITH {PAGES}, {RANGES} SELECT * FROM ranges")
def layout_page_ranges(spark, d):
    return _ranges(pages(spark, d))


@query(
    f"""WITH {PAGES}, {RANGES}, t AS (SELECT DISTINCT doc || '/' || page AS table_id, doc, page FROM p WHERE REGEXP_MATCHES(text, '^\\s*\\|.*\\|\\s*$'))
SELECT table_id, t.doc, t.page, heading FROM t LEFT JOIN ranges r ON r.doc = t.doc AND t.page BETWEEN first_page AND last_page QUALIFY ROW_NUMBER() OVER (PARTITION BY table_id ORDER BY first_page, heading) = 1"""
)
def layout_table_topics(spark, d):
    lines = pages(spark, d)
    t = lines.where(F.col("text").rlike(r"^\s*\|.*\|\s*$")).select(F.concat("doc", F.lit("/"), F.col("page").cast("string")).alias("table_id"), "doc", "page").distinct()
    return L.table_topics(t, _ranges(lines))


@query(
    f"""WITH {PAGES}, m AS (SELECT doc, page, line_no FROM p WHERE REGEXP_MATCHES(text, '^(Activity|Readings|Chapter)\\b')),
g AS (SELECT *, LEAST(page - LAG(page) OVER w, LEAD(page) OVER w - page) AS gap FROM m WINDOW w AS (PARTITION BY doc ORDER BY page, line_no))
SELECT doc, MIN(page) AS end_page FROM g WHERE page >= 2 AND gap <= 3 GROUP BY 1"""
)
def layout_chapter_end(spark, d):
    return L.chapter_end(pages(spark, d).where(F.col("text").rlike(r"^(Activity|Readings|Chapter)\b")).select("doc", "page", "line_no"))


@query(
    f"""WITH {PAGES}, c AS (SELECT doc, text AS title, LEAST(page, 3) AS tier, size AS score, page, line_no FROM p)
SELECT doc, title, tier, score, page, line_no FROM c WHERE {titled('title')} QUALIFY ROW_NUMBER() OVER (PARTITION BY doc ORDER BY tier, score DESC, title, page, line_no) = 1"""
)
def layout_chapter_titles(spark, d):
    c = pages(spark, d).select("doc", F.col("text").alias("title"), F.least("page", F.lit(3)).alias("tier"), F.col("size").alias("score"), "page", "line_no")
    return L.chapter_titles(c)


@query(
    f"""WITH {PAGES}, k AS (SELECT doc, REGEXP_EXTRACT(text, '^\\s*(\\d{{1,2}})[. ]', 1)::INT AS n, MIN(ROW(page, line_no)) AS seen, COUNT(*) AS votes FROM p WHERE REGEXP_MATCHES(text, '^\\s*\\d{{1,2}}[. ]') GROUP BY ALL)
SELECT doc, ARG_MIN(n, ROW(-votes, seen)) AS number, MAX(votes) AS votes FROM k GROUP BY 1"""
)
def layout_leading_numbers(spark, d):
    """The number most lines of a book begin with, the first seen among equals."""
    return L.leading_number(pages(spark, d))


@query(f"WITH {PAGES} SELECT doc, page, block, MIN(size) AS smallest, COUNT(*) AS lines FROM p WHERE TRIM(text) <> '' GROUP BY ALL")
def layout_block_sizes(spark, d):
    return L.block_sizes(pages(spark, d))


@query(f"""WITH {PAGES}, b AS (SELECT doc, page, block, MAX(x1) - MIN(x0) AS width, 12.0::DOUBLE * COUNT(*) AS height FROM p GROUP BY ALL) SELECT doc, page, block FROM b WHERE width < 120 AND height > 20 AND height > 0.1 * width""")
def layout_vertical_blocks(spark, d):
    """Blocks much higher than wide, by limits that fit the made positions."""
    b = pages(spark, d).groupBy("doc", "page", "block").agg((F.max("x1") - F.min("x0")).alias("width"), (12.0 * F.count(F.lit(1))).alias("height"))
    return L.vertical_blocks(b, 120, 20, 0.1).select("doc", "page", "block")


@query(
    """WITH s AS (SELECT DISTINCT chunk_id, REGEXP_REPLACE(text, '\\s+', ' ', 'g') AS text FROM (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunk)),
x AS (SELECT chunk_id, STRING_SPLIT(REGEXP_REPLACE(REPLACE(text, 'Fig.', 'Fig' || chr(2)), '([.!?])\\s+', '\\1' || chr(3), 'g'), chr(3)) AS parts FROM s),
y AS (SELECT chunk_id, GENERATE_SUBSCRIPTS(parts, 1)::INT - 1 AS pos, REPLACE(UNNEST(parts), chr(2), '.') AS sentence FROM x)
SELECT chunk_id, pos, sentence FROM y WHERE REGEXP_MATCHES(LOWER(sentence), 'as shown (in|below|above)|shown in (the )?figure|in the figure (below|above)|the diagram illustrates|figure\\s+\\d+\\.\\d+\\s+shows|in the (above|below) (figure|diagram)|the (figure|diagram) (below|above) shows|fig')"""
)
def sentences_of_figures(spark, d):
    """Sentences that need a figure, or name one."""
    chunks = table(spark, d, "chunk").dropDuplicates(["chunk_id"])
    return K.figure_sentences(chunks, "fig")


@query(
    f"""WITH l0 AS (SELECT DISTINCT source_file, chunk_id, chunk_index, text FROM chunk), l AS (SELECT chunk_id, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1)::INT - 1 AS line_no, UNNEST(STRING_SPLIT(text, chr(10))) AS text FROM l0),
h AS (SELECT chunk_id, line_no, REGEXP_EXTRACT(text, {HEAD}, 1) AS number, REGEXP_EXTRACT(text, {HEAD}, 2) AS raw FROM l WHERE REGEXP_MATCHES(text, {HEAD})) SELECT chunk_id, line_no, number, TRIM(raw) AS title FROM h WHERE {plausible('TRIM(raw)')}"""
)
def heading_lines(spark, d):
    return L.headings(L.chunk_lines(table(spark, d, "chunk"))).select("chunk_id", "line_no", "number", "title")


@query(
    f"""WITH l0 AS (SELECT DISTINCT source_file, chunk_id, chunk_index, text FROM chunk), l AS (SELECT source_file, chunk_id, chunk_index, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) - 1 AS line_no, UNNEST(STRING_SPLIT(text, chr(10))) AS text FROM l0),
f AS (SELECT source_file, text, LAST_VALUE(CASE WHEN REGEXP_MATCHES(text, {HEAD}) AND {plausible(f"TRIM(REGEXP_EXTRACT(text, {HEAD}, 2))")} THEN REGEXP_EXTRACT(text, {HEAD}, 1) END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY chunk_index, chunk_id, line_no ROWS UNBOUNDED PRECEDING) AS heading FROM l)
SELECT source_file, heading, COUNT(*) AS lines, CAST(SUM(LENGTH(text)) AS BIGINT) AS chars FROM f WHERE heading IS NOT NULL GROUP BY ALL"""
)
def heading_sizes(spark, d):
    """Lines and characters under each heading number of a book."""
    filled = L.with_current_heading(L.chunk_lines(table(spark, d, "chunk")), ["chunk_index", "chunk_id", "line_no"])
    return filled.where("heading IS NOT NULL").groupBy("source_file", "heading").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


ALIAS_ROWS = [("water", "water"), ("water", "H2O"), ("cobalt", "Co"), ("carbon monoxide", "CO"), ("magnesium oxide", "MgO"), ("salt", "salt"), ("iron", "iron"), ("iron", "Fe")]


@query(
    """WITH a(identity, alias) AS (VALUES """ + ", ".join(f"('{i}', '{a}')" for i, a in ALIAS_ROWS) + """),
w AS (SELECT DISTINCT UNNEST(STRING_SPLIT(REGEXP_REPLACE(text, '[^A-Za-z0-9]+', ' ', 'g'), ' ')) AS term FROM chunk UNION SELECT DISTINCT payload->>'$.answer' FROM questions WHERE type = 'fill_in_blank'),
f AS (SELECT *, REGEXP_FULL_MATCH(alias, '([A-Z][a-z]?\\d*)+') AND alias <> 'CO2' AS formula FROM a),
e AS (SELECT alias, MIN(identity) AS i, COUNT(DISTINCT identity) AS n FROM f GROUP BY 1), m AS (SELECT LOWER(alias) AS low, MIN(identity) AS i FROM f WHERE NOT formula GROUP BY 1),
s AS (SELECT LOWER(alias) AS low, MIN(identity) AS i, COUNT(DISTINCT identity) AS n FROM f WHERE formula GROUP BY 1)
SELECT term, COALESCE(CASE WHEN e.n = 1 THEN e.i END, m.i, CASE WHEN s.n = 1 AND term = LOWER(term) THEN s.i END) AS identity FROM w LEFT JOIN e ON e.alias = term LEFT JOIN m ON m.low = LOWER(term) LEFT JOIN s ON s.low = LOWER(term)
WHERE COALESCE(CASE WHEN e.n = 1 THEN e.i END, m.i, CASE WHEN s.n = 1 AND term = LOWER(term) THEN s.i END) IS NOT NULL"""
)
def named_substances(spark, d):
    """Words of the chunks and answers that name one of a few substances."""
    words = table(spark, d, "chunk").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z0-9]+", " "), " ")).alias("term"))
    answers = table(spark, d, "questions").where("type = 'fill_in_blank'").select(F.get_json_object("payload", "$.answer").alias("term"))
    return N.identities(words.union(answers).distinct(), spark.createDataFrame(ALIAS_ROWS, "identity string, alias string")).where("identity IS NOT NULL")


PARTS = f"""w0 AS (SELECT *, REGEXP_EXTRACT(text, {HEAD}, 1) AS number, TRIM(REGEXP_EXTRACT(text, {HEAD}, 2)) AS name FROM p WHERE REGEXP_MATCHES(text, {HEAD})),
w1 AS (SELECT *, SPLIT_PART(number, '.', 1)::INT AS major, SPLIT_PART(number, '.', 2)::INT AS minor, UPPER(name) = name AS sure FROM w0 WHERE REGEXP_MATCHES(name, '^\\p{{L}}'))
"""


def _rising(source: str) -> str:
    return f"""seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc ORDER BY page, line_no) AS k FROM (SELECT * FROM {source} QUALIFY ROW_NUMBER() OVER (PARTITION BY doc, number ORDER BY page, line_no) = 1)),
fold AS (WITH RECURSIVE f AS (SELECT doc, k, page, line_no, number, minor, name, sure OR minor > -1 AS kept, minor AS last FROM seq WHERE k = 1
UNION ALL SELECT s.doc, s.k, s.page, s.line_no, s.number, s.minor, s.name, s.sure OR s.minor > f.last, CASE WHEN s.sure OR s.minor > f.last THEN GREATEST(f.last, s.minor) ELSE f.last END FROM f JOIN seq s ON s.doc = f.doc AND s.k = f.k + 1) SELECT * FROM f)
"""


@query(
    f"""WITH {PAGES.replace("FROM lines)", "FROM (SELECT doc, page, line_no, CASE WHEN line_no % 3 = 0 THEN UPPER(text) ELSE text END AS text FROM lines))")}, {PARTS},
v AS (SELECT doc, major, COUNT(*) AS n, MIN(ROW(page, line_no)) AS seen FROM w1 WHERE sure GROUP BY ALL), top AS (SELECT doc, ARG_MIN(major, ROW(-n, seen)) AS major FROM v GROUP BY 1),
own AS (SELECT w1.* FROM w1 JOIN top USING (doc, major) WHERE sure OR {fragment('name')}), {_rising("own")} SELECT doc, page, line_no, number, name FROM fold WHERE kept"""
)
def layout_capitals_numbered(spark, d):
    """Every third line of a page is put in capitals."""
    ship(spark)
    return D.capitals_numbered(pages(spark, d).withColumn("text", F.when(F.col("line_no") % 3 == 0, F.upper("text")).otherwise(F.col("text"))))


@query(
    f"""WITH {PAGES}, {PARTS}, c AS (SELECT doc, MAX(major) AS major FROM w1 GROUP BY 1), own AS (SELECT w1.* EXCLUDE (sure), FALSE AS sure FROM w1 JOIN c USING (doc, major) WHERE LENGTH(name) <= 60),
{_rising("own")} SELECT doc, page, line_no, number, name FROM fold WHERE kept"""
)
def layout_chapter_numbered(spark, d):
    """Headings of the highest chapter number that a book's lines have; names over 60 characters stand for garbled ones."""
    ship(spark)
    lines = pages(spark, d)
    return D.chapter_numbered(lines, D.highest_major(lines), F.length("name") > 60)


@query(
    f"""WITH {PAGES}, b AS (SELECT *, REGEXP_MATCHES(text, '^Activity ') AS starts FROM p),
s AS (SELECT *, SUM(starts::INT) OVER w AS box, LAST_VALUE(CASE WHEN starts THEN size END IGNORE NULLS) OVER w AS box_size FROM b WINDOW w AS (PARTITION BY doc, page ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, MAX(CASE WHEN NOT starts AND ABS(size - box_size) > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, box ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS gone FROM s),
l AS (SELECT doc, page, line_no, text, size FROM g WHERE (box = 0 OR gone = 1) AND TRIM(text) <> ''),
e AS (SELECT doc, MIN(CASE WHEN REGEXP_MATCHES(text, '(?i)^\\s*(chapter|readings)\\b') AND page > 3 THEN ROW(page, line_no) END) AS stop, MIN(CASE WHEN REGEXP_MATCHES(text, '(?i)^\\s*readings\\b') AND page > 3 THEN ROW(page, line_no) END) AS task FROM l GROUP BY 1),
t AS (SELECT l.*, CASE WHEN REGEXP_MATCHES(text, '^\\s*[a-z]\\)\\s') THEN 2 WHEN size BETWEEN 15.5 AND 16.5 THEN 1 WHEN size BETWEEN 13.5 AND 14.5 THEN 2 END AS tier FROM l JOIN e USING (doc) WHERE (stop IS NULL OR ROW(page, line_no) < stop) AND (task IS NULL OR ROW(page, line_no) < task)),
o AS (SELECT *, SUM((tier IS NOT NULL)::INT) OVER (PARTITION BY doc ORDER BY page, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS ordinal FROM t)
SELECT doc, CASE WHEN MAX(tier) = 1 THEN 'topic' ELSE 'sub-topic' END AS kind, ordinal, MAX(CASE WHEN tier IS NOT NULL THEN TRIM(text) END) AS name, COALESCE(STRING_AGG(CASE WHEN tier IS NULL THEN text END, chr(10) ORDER BY page, line_no), '') AS text FROM o WHERE ordinal > 0 GROUP BY doc, ordinal
UNION ALL SELECT doc, 'exercise', ROW_NUMBER() OVER (PARTITION BY doc ORDER BY page, line_no), NULL, TRIM(text) FROM l JOIN e USING (doc) WHERE task IS NOT NULL AND ROW(page, line_no) > task"""
)
def layout_revised(spark, d):
    """Books by sizes; readings after the fourth page stand for exercises."""
    lines = pages(spark, d).withColumn("text", F.when((F.col("page") <= 3) & F.col("text").rlike(r"(?i)^\s*(chapter|readings)\b"), F.concat(F.lit("\u200b"), "text")).otherwise(F.col("text")))
    told = D.revised(lines, (15.5, 16.5), (13.5, 14.5), "^Activity ", r"(?i)^\s*(chapter|readings)\b", r"(?i)^\s*readings\b")
    return told.select("doc", "kind", "ordinal", *(F.replace(c, F.lit("\u200b"), F.lit("")).alias(c) for c in ("name", "text")))


@query(
    f"""WITH {PAGES}, {NUMBERED}, {RUNNING}, {CAPS}, c3 AS (SELECT doc, page, line_no, {HEADLINE} AS name FROM c2), caps AS (SELECT doc, page, line_no, NULL::VARCHAR AS number, name FROM c3 QUALIFY ROW_NUMBER() OVER (PARTITION BY doc, name ORDER BY page, line_no) = 1),
r AS (SELECT DISTINCT doc, CASE WHEN doc LIKE 'phys%' THEN 'all_caps' WHEN doc LIKE 'math%' THEN 'sizes' ELSE 'numbered' END AS detector FROM p), num AS (SELECT doc, page, line_no, number, name FROM fold WHERE kept)
SELECT num.* FROM num JOIN r USING (doc) WHERE detector = 'numbered' UNION ALL SELECT caps.* FROM caps JOIN r USING (doc) WHERE detector = 'all_caps' OR (detector = 'numbered' AND doc NOT IN (SELECT doc FROM num))
UNION ALL SELECT p.doc, page, line_no, NULLIF(REGEXP_EXTRACT(text, {OWN}, 1), ''), TRIM(REGEXP_REPLACE(text, '^\\s*\\d+(?:\\.\\d+)*[.)]?\\s+', '')) FROM p JOIN r USING (doc) WHERE detector = 'sizes' AND (size BETWEEN 15.5 AND 16.5 OR size BETWEEN 13.5 AND 14.5) AND LENGTH(TRIM(text)) > 2"""
)
def layout_routed(spark, d):
    """Each book by the detector of its rule: capitals for physics, sizes for mathematics, numbers for the rest, capitals where there are none."""
    ship(spark)
    lines = pages(spark, d)
    kind = F.when(F.col("doc").startswith("phys"), "all_caps").when(F.col("doc").startswith("math"), "sizes")
    rules = lines.select("doc", kind.alias("detector")).distinct().where("detector IS NOT NULL")
    return D.routed(lines, rules, topic=(15.5, 16.5), sub=(13.5, 14.5))


RUNS = f"""{COLORS}, s0 AS (SELECT doc, line_no, text, size, color, x0, x1, 14.0::DOUBLE * line_no AS y0 FROM p JOIN body USING (doc) WHERE page = 0 AND size > 13 AND color <> body),
s1 AS (SELECT *, LAG(y0) OVER w AS py, LAG(x1) OVER w AS px, LAG(size) OVER w AS ps, LAG(text) OVER w AS pt FROM s0 WINDOW w AS (PARTITION BY doc, color ORDER BY y0, x0, line_no)),
s2 AS (SELECT *, COALESCE(ABS(y0 - py) <= 0.3 * size AND x0 - px <= size, FALSE) AS same_row, COALESCE(y0 - py BETWEEN 0 AND 1.6 * GREATEST(size, ps) AND ABS(size - ps) <= 0.15 * ps, FALSE) AS below FROM s1),
s3 AS (SELECT *, SUM((NOT (same_row OR below))::INT) OVER (PARTITION BY doc, color ORDER BY y0, x0, line_no ROWS UNBOUNDED PRECEDING) AS run, same_row AND x0 - px < 0.15 * size AND REGEXP_MATCHES(TRIM(pt), '^\\p{{Lu}}$') AS cap FROM s2),
runs AS (SELECT doc, color, run::BIGINT AS run, TRIM(STRING_AGG(CASE WHEN cap THEN TRIM(text) ELSE ' ' || TRIM(text) END, '' ORDER BY y0, x0, line_no)) AS text, MAX(size) AS size FROM s3 GROUP BY ALL)
"""


def _spans(spark, d):
    return pages(spark, d).withColumn("y0", 14.0 * F.col("line_no"))


@query(f"WITH {PAGES}, {RUNS} SELECT * FROM runs")
def layout_banner_runs(spark, d):
    return D.banner_runs(_spans(spark, d))


@query(
    f"""WITH {PAGES}, {RUNS}, t AS (SELECT *, COUNT(*) OVER w AS n, MAX(size) OVER w AS big, MIN(size) OVER w AS small FROM runs WHERE {titled('text')} AND NOT REGEXP_MATCHES(text, '(?i)^unit\\b') WINDOW w AS (PARTITION BY doc, color))
SELECT doc, ARG_MIN(text, ROW(-size, -LENGTH(text), text)) AS title FROM t WHERE n = 1 OR (n = 2 AND big > small AND size = big) GROUP BY 1"""
)
def layout_banner_titles(spark, d):
    return D.banner_title(D.banner_runs(_spans(spark, d)))
