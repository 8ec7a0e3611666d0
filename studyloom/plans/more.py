"""Queries over intake, dashboards, catalogs, rules, tables, figures and titles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import answers as A
from studyloom.operators import catalog as C
from studyloom.operators import chunking as K
from studyloom.operators import dedup as D
from studyloom.operators import detectors as H
from studyloom.operators import layout as L
from studyloom.operators import performance as P
from studyloom.operators import retrieval as R
from studyloom.operators import validate as V
from studyloom.plans import bank as _bank  # noqa: F401 - its SQL is used below
from studyloom.plans import extras as _extras  # noqa: F401
from studyloom.plans import registry
from studyloom.plans.bank import FORMULA, GRADES, KNOWN, NEAR, PAIRS, sql_substance
from studyloom.plans.layout import NUMBERED, PAGES, pages
from studyloom.plans.registry import query
from studyloom.session import ship, table
from studyloom.sources import tables as S

TOPIC = ["class", "subject", "chapter", "topic"]


def _q(spark, d):
    return table(spark, d, "questions")


@query(
    f"""WITH RECURSIVE {PAIRS}, j AS (SELECT i.question_id, FIRST_VALUE(i.question_id) OVER (PARTITION BY i.class, i.subject, i.chapter, i.topic, identity ORDER BY q.batch_no, i.created_at, i.question_id) AS first FROM i JOIN questions q USING (question_id)),
a AS (SELECT questions.* FROM questions JOIN j USING (question_id) WHERE first = question_id),
g AS (SELECT question_id, class, topic, difficulty, type = 'matching' AS m, created_at, CAST(embedding AS DOUBLE[384]) AS v FROM a WHERE LEN(embedding) = 384 AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0 AND LEN(LIST_FILTER(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.question_id AS id, b.question_id AS parent, ROUND(ARRAY_COSINE_SIMILARITY(a.v, b.v), 9) AS s FROM g a JOIN g b ON a.class = b.class AND a.topic = b.topic AND a.difficulty = b.difficulty AND a.m = b.m AND ROW(b.created_at, b.question_id) < ROW(a.created_at, a.question_id)),
p AS (SELECT id, parent FROM s WHERE s >= 0.9 QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY s DESC, parent) = 1),
c AS (SELECT question_id, question_id AS cluster FROM a WHERE question_id NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, c.cluster FROM p JOIN c ON p.parent = c.question_id)
SELECT j.question_id, CASE WHEN first = j.question_id THEN 'accepted' ELSE 'exact_duplicate' END AS reason, c.cluster FROM j LEFT JOIN c USING (question_id)"""
)
def intake_clusters(spark, d):
    """The whole intake: duplicates turned away, the accepted rows clustered among themselves."""
    ship(spark)
    return R.intake(_q(spark, d), clustered=True).select("question_id", "reason", "cluster")


@query(
    f"""WITH {NEAR} SELECT t, SUM((same_text AND similarity >= t)::INT)::BIGINT AS caught, SUM((NOT same_text AND similarity >= t)::INT)::BIGINT AS merged FROM n, (VALUES (0.85::DOUBLE), (0.867::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) v(t) GROUP BY 1"""
)
def fixed_thresholds(spark, d):
    """What fixed thresholds would catch and wrongly merge."""
    return D.at_thresholds(D.neighbours_in_topic(_q(spark, d)), F.col("same_text"), (0.85, 0.867, 0.9, 0.95))


@query(
    f"""WITH {NEAR}, r AS (SELECT question_id, before, similarity, same_text, ROW_NUMBER() OVER (PARTITION BY same_text ORDER BY CASE WHEN same_text THEN similarity ELSE -similarity END, question_id)::INT AS place FROM n) SELECT * FROM r WHERE place <= 10"""
)
def similarity_extremes(spark, d):
    """The ten least similar pairs of equal texts and the ten most similar of different ones."""
    n = D.neighbours_in_topic(_q(spark, d))
    by = Window.partitionBy("same_text").orderBy(F.when(F.col("same_text"), F.col("similarity")).otherwise(-F.col("similarity")), "question_id")
    return n.select("question_id", "before", "similarity", "same_text", F.row_number().over(by).alias("place")).where("place <= 10")


@query(
    """WITH c AS (SELECT class, subject, chapter, topic, chunk_id, ROW_NUMBER() OVER (PARTITION BY class, subject, chapter, topic ORDER BY chunk_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY class, subject, chapter, topic) AS n FROM (SELECT DISTINCT class, subject, chapter, topic, chunk_id FROM chunk WHERE topic IS NOT NULL)),
t AS (SELECT DISTINCT class, subject, chapter, topic, n, UNNEST([0, 1, 2, 3]) AS i FROM c),
d AS (SELECT *, FLOOR((('0x' || SUBSTR(SHA256('31|' || class || '|' || subject || '|' || chapter || '|' || topic || '|' || i), 1, 13))::BIGINT / POW(16, 13)) * n)::BIGINT AS pos FROM t)
SELECT d.class, d.subject, d.chapter, d.topic, i::INT AS i, chunk_id FROM d JOIN c USING (class, subject, chapter, topic, pos)"""
)
def chunk_draws(spark, d):
    """Four chunks of each topic, drawn with replacement."""
    by = Window.partitionBy(*TOPIC)
    c = table(spark, d, "chunk").where("topic IS NOT NULL").select(*TOPIC, "chunk_id").distinct()
    c = c.withColumn("pos", (F.row_number().over(by.orderBy("chunk_id")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(by))
    draws = c.select(*TOPIC, "n").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    u = T.uniform(F.lit("31"), *TOPIC, F.col("i").cast("string"))
    return draws.withColumn("pos", F.floor(u * F.col("n"))).join(c.drop("n"), [*TOPIC, "pos"]).select(*TOPIC, "i", "chunk_id")


@query(
    """WITH u AS (SELECT DISTINCT attempt_id, class, subject, UNNEST(CAST(scope->'$.sub_units' AS VARCHAR[])) AS chapter FROM quiz_attempts), n AS (SELECT class, subject, chapter, COUNT(DISTINCT topic) AS topics FROM chunk GROUP BY ALL)
SELECT attempt_id, COUNT(*) AS chapters, SUM(topics)::BIGINT AS topics FROM u JOIN n USING (class, subject, chapter) GROUP BY 1"""
)
def coverage_counts(spark, d):
    """How many topics the chapters have that an attempt names."""
    units = C.requested_units(table(spark, d, "quiz_attempts")).select("attempt_id", "class", "subject", F.col("unit").alias("chapter")).distinct()
    n = C.counts(table(spark, d, "chunk")).select("class", "subject", "chapter", "topics")
    return units.join(n, ["class", "subject", "chapter"]).groupBy("attempt_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum("topics").alias("topics"))


@query(
    """WITH t AS (SELECT DISTINCT * FROM quiz_attempts), w AS (SELECT *, DATE_TRUNC('week', created_at) = MAX(DATE_TRUNC('week', created_at)) OVER (PARTITION BY user_id) AS last FROM t),
s AS (SELECT user_id, SUM(score_correct) AS c, SUM(score_total) AS n, SUM(score_correct) FILTER (difficulty = 'hard') AS hc, SUM(score_total) FILTER (difficulty = 'hard') AS hn, SUM(score_correct) FILTER (last) AS wc, SUM(score_total) FILTER (last) AS wn FROM w GROUP BY 1)
SELECT user_id, COALESCE(FLOOR(100.0::DOUBLE * c / NULLIF(n, 0) + 0.5), 0)::INT AS overall, COALESCE(FLOOR(100.0::DOUBLE * hc / NULLIF(hn, 0) + 0.5), 0)::INT AS hard, COALESCE(FLOOR(100.0::DOUBLE * wc / NULLIF(wn, 0) + 0.5), 0)::INT AS week FROM s"""
)
def progress_card(spark, d):
    """Per cent right of all, of the hard ones, and of the user's last week; halves go up, 0 where there is nothing."""
    return P.progress_card(table(spark, d, "quiz_attempts"))


@query(
    """WITH e AS (SELECT DISTINCT ON (id) class, subject, chapter, id, source FROM reference_corpus WHERE COALESCE(TRIM(question), '') <> '')
SELECT class, subject, chapter, ARG_MIN(id, ROW(source IS DISTINCT FROM 'ncert_activity', SHA256('9|' || id))) AS id FROM e GROUP BY ALL"""
)
def wording_example(spark, d):
    """An entry of each chapter to show its wording, of activities if there are any."""
    e = table(spark, d, "reference_corpus").where("coalesce(trim(question), '') <> ''").dropDuplicates(["id"])
    first = F.struct(~F.col("source").eqNullSafe(F.lit("ncert_activity")), T.order_key("9", F.col("id")))
    return e.groupBy("class", "subject", "chapter").agg(F.min_by("id", first).alias("id"))


@query(
    """WITH u AS (SELECT DISTINCT user_id, class FROM quiz_attempts), s AS (SELECT DISTINCT class, subject FROM chunk), t AS (SELECT user_id, class, subject, SUM(score_correct) AS correct, SUM(score_total) AS total FROM (SELECT DISTINCT * FROM quiz_attempts) GROUP BY ALL)
SELECT user_id, class, subject, COALESCE(correct, 0)::BIGINT AS correct, COALESCE(total, 0)::BIGINT AS total FROM u JOIN s USING (class) LEFT JOIN t USING (user_id, class, subject)"""
)
def home_cards(spark, d):
    """A card for each subject of a user's classes, also of those without an attempt."""
    a = table(spark, d, "quiz_attempts").dropDuplicates(["attempt_id"])
    sums = a.groupBy("user_id", "class", "subject").agg(F.sum("score_correct").alias("correct"), F.sum("score_total").alias("total"))
    cards = a.select("user_id", "class").distinct().join(table(spark, d, "chunk").select("class", "subject").distinct(), "class")
    return cards.join(sums, ["user_id", "class", "subject"], "left").fillna(0, ["correct", "total"])


@query(
    """WITH a AS (SELECT DISTINCT class, subject, chapter, topic FROM questions), b AS (SELECT DISTINCT class, subject, chapter, topic, TRUE AS there FROM chunk)
SELECT class, subject, chapter, COUNT(*) AS expected, COUNT(*) FILTER (there IS NULL) AS missing, COUNT(*) FILTER (there IS NULL) = 0 AS all_present FROM a LEFT JOIN b USING (class, subject, chapter, topic) GROUP BY ALL"""
)
def topics_present(spark, d):
    """Whether the books have every topic that the bank asks about."""
    have = table(spark, d, "chunk").select(*TOPIC).distinct().withColumn("there", F.lit(True))
    gone = F.count_if(F.col("there").isNull())
    j = _q(spark, d).select(*TOPIC).distinct().join(have, TOPIC, "left")
    return j.groupBy("class", "subject", "chapter").agg(F.count(F.lit(1)).alias("expected"), gone.alias("missing"), (gone == 0).alias("all_present"))


@query(
    """SELECT 'leak' AS rule, COUNT(*) FILTER (subject <> 'Biology' OR class <> '9') AS found, TRUE AS none_wanted FROM chunk WHERE class = '9' AND subject = 'Biology'
UNION ALL SELECT 'contradiction', COUNT(*), TRUE FROM chunk WHERE class = '9' AND class = '10'
UNION ALL SELECT 'tables', COUNT(*), FALSE FROM chunk WHERE has_table
UNION ALL SELECT 'no answer', COUNT(*), TRUE FROM reference_corpus WHERE COALESCE(TRIM(answer), '') = '' AND source IS DISTINCT FROM 'ncert_activity'"""
)
def retrieval_gate(spark, d):
    """Rules that a filled store is held against, with the rows that each finds."""
    scoped = S.scan(spark, d, "chunk", **{"class": "9", "subject": "Biology"})
    rules = (
        ("leak", scoped.where("subject <> 'Biology' OR class <> '9'"), True),
        ("contradiction", S.scan(spark, d, "chunk", **{"class": "9"}).where("class = '10'"), True),
        ("tables", S.scan(spark, d, "chunk", has_table=True), False),
        ("no answer", table(spark, d, "reference_corpus").where("coalesce(trim(answer), '') = '' AND NOT source <=> 'ncert_activity'"), True),
    )
    return R.gate_counts(rules)


LISTS = ", ".join(f"('{name}', {[name, *aliases]!r})" for name, aliases in A.SUBSTANCES.items())
GROUP_LISTS = ", ".join(f"('{term}', {list(group)!r})" for term, group in A.TERM_LISTS.items())
SYMBOLS = r"(?i)[\^*/=()×÷]|[²³]|\w[×]\w|\w x \w"


@query(
    f"""WITH known AS (SELECT name, alias, {FORMULA.format(c='alias')} AS formula FROM (VALUES {KNOWN}) t(name, alias)), lists(name, items) AS (VALUES {LISTS}), terms(term, items) AS (VALUES {GROUP_LISTS}),
q AS (SELECT question_id, TRIM(REGEXP_REPLACE(payload->>'$.answer', '\\s+', ' ', 'g')) AS answer, COALESCE(CAST(payload->'$.accepted_answers' AS VARCHAR[]), []) AS al FROM questions WHERE type = 'fill_in_blank'),
u AS (SELECT question_id, UNNEST(al) AS v FROM q), s AS (SELECT v, {sql_substance("v")} AS substance FROM (SELECT DISTINCT v FROM u WHERE v IS NOT NULL)), n AS (SELECT answer, {sql_substance("answer")} AS substance FROM (SELECT DISTINCT answer FROM q WHERE answer IS NOT NULL)),
f AS (SELECT question_id, BOOL_OR(COALESCE(TRIM(u.v), '') = '' OR LENGTH(u.v) > 80) AS size, BOOL_OR(substance IS NULL AND (LEN(REGEXP_SPLIT_TO_ARRAY(TRIM(u.v), '\\s+')) > 4 OR REGEXP_MATCHES(u.v, '[.!?;]'))) AS long, BOOL_OR(substance IS NULL AND REGEXP_MATCHES(u.v, '{SYMBOLS}')) AS symbols FROM u LEFT JOIN s ON s.v = u.v GROUP BY 1)
SELECT q.question_id, CASE WHEN LEN(al) > 8 THEN 'too many aliases' WHEN COALESCE(size, FALSE) THEN 'alias length' WHEN COALESCE(long, FALSE) THEN 'alias not a term' WHEN COALESCE(symbols, FALSE) THEN 'alias a formula' ELSE '' END AS reason,
COALESCE(ARRAY_TO_STRING(LIST_FILTER(COALESCE(lists.items, terms.items), lambda v: v <> q.answer), '|'), '') AS reviewed FROM q LEFT JOIN f USING (question_id) LEFT JOIN n ON n.answer = q.answer LEFT JOIN lists ON lists.name = n.substance LEFT JOIN terms ON terms.term = LOWER(q.answer)"""
)
def alias_rules(spark, d):
    return V.alias_rules(_q(spark, d).where("type = 'fill_in_blank'"), SYMBOLS)


@query(
    """WITH a AS (SELECT DISTINCT attempt_id, class, subject, scope->>'$.scope_type' AS kind, UNNEST(CAST(scope->'$.sub_units' AS VARCHAR[])) AS unit FROM quiz_attempts),
s AS (SELECT DISTINCT class, subject FROM questions), c AS (SELECT DISTINCT class, subject, chapter AS unit FROM questions), t AS (SELECT DISTINCT class, subject, topic AS unit FROM questions)
SELECT attempt_id, a.unit AS unit, CASE WHEN s.class IS NULL THEN 'no chapters' WHEN kind <> 'topic' AND c.unit IS NULL THEN 'unknown chapter' WHEN kind = 'topic' AND t.unit IS NULL THEN 'unknown topic' ELSE '' END AS reason
FROM a LEFT JOIN s ON s.class = a.class AND s.subject = a.subject LEFT JOIN c ON c.class = a.class AND c.subject = a.subject AND c.unit = a.unit LEFT JOIN t ON t.class = a.class AND t.subject = a.subject AND t.unit = a.unit"""
)
def scope_reasons(spark, d):
    """Of each named unit: whether its class and subject have chapters at all, and whether it is a chapter or a topic of theirs, as the scope says."""
    return C.scope_reasons(table(spark, d, "quiz_attempts"), _q(spark, d))


@query(
    """WITH r0 AS (SELECT DISTINCT chunk_id, repair_id, before, COALESCE(after, '') AS after FROM source_repairs WHERE chunk_id IS NOT NULL AND before <> ''),
r1 AS (SELECT chunk_id, repair_id, 0 AS v, before, after FROM r0 UNION ALL SELECT chunk_id, repair_id, 1, REGEXP_REPLACE(before, '\\(\\d+\\.\\d+\\)', '', 'g'), REGEXP_REPLACE(after, '\\(\\d+\\.\\d+\\)', '', 'g') FROM r0 WHERE REGEXP_MATCHES(before, '\\(\\d+\\.\\d+\\)')),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY repair_id, v, before, after) AS k FROM r1 WHERE before <> ''), m AS (SELECT chunk_id, MAX(k) AS m FROM r GROUP BY 1),
s AS (WITH RECURSIVE s AS (SELECT chunk_id, text AS t0, text, 0::BIGINT AS k FROM (SELECT DISTINCT chunk_id, text FROM chunk WHERE chunk_id IN (SELECT chunk_id FROM r)) UNION ALL SELECT s.chunk_id, t0, REPLACE(s.text, r.before, r.after), r.k FROM s JOIN r ON r.chunk_id = s.chunk_id AND r.k = s.k + 1) SELECT * FROM s)
SELECT chunk_id, text, text <> t0 AS changed FROM s JOIN m USING (chunk_id) WHERE k = m"""
)
def repaired_equations(spark, d):
    """Repairs that also hold where the printed equation numbers are missing."""
    return K.repaired(table(spark, d, "chunk"), table(spark, d, "source_repairs"), equations=True)


@query(
    """WITH c AS (SELECT chunk_id, MIN(topic) AS topic FROM chunk GROUP BY 1)
SELECT question_id, CASE WHEN COALESCE(TRIM(explanation), '') <> '' THEN explanation WHEN c.topic IS NOT NULL THEN 'See ' || c.topic ELSE '' END AS explanation, COALESCE(TRIM(explanation), '') = '' AND c.topic IS NOT NULL AS updated FROM questions LEFT JOIN c ON chunk_id = source_chunk_id"""
)
def explanation_update(spark, d):
    """Stored explanations stay, missing ones are taken from a second table (here made of the chunks' topics)."""
    new = table(spark, d, "chunk").groupBy("chunk_id").agg(F.min("topic").alias("topic"))
    made = _q(spark, d).select("question_id", "source_chunk_id").join(new, F.col("chunk_id") == F.col("source_chunk_id")).where("topic IS NOT NULL").select("question_id", F.concat(F.lit("See "), "topic").alias("made"))
    return R.explained(_q(spark, d), made)


@query(
    """WITH p AS (SELECT user_id, ARG_MAX(event_type, ROW(ts, event_id)) AS default_class FROM events GROUP BY 1) SELECT c_custkey AS user_id, default_class, default_class IS NOT NULL AS stored FROM customer LEFT JOIN p ON p.user_id = c_custkey"""
)
def profile_read(spark, d):
    """Every customer's profile, NULL where none is stored."""
    p = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("default_class"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(p, "user_id", "left").withColumn("stored", F.col("default_class").isNotNull())


@query(
    """WITH r AS (SELECT DISTINCT ON (chunk_id) source_file, topic_number, chunk_index, chunk_id, has_table, images FROM chunk),
i AS (SELECT source_file, topic_number, chunk_index, LIST(DISTINCT x.image_file) AS files FROM (SELECT source_file, topic_number, chunk_index, UNNEST(images) AS x FROM r WHERE topic_number <> '') GROUP BY ALL)
SELECT chunk_id, COALESCE(has_table, FALSE) AS has_table, COALESCE(ARRAY_TO_STRING(LIST_SORT(files), ','), '') AS images FROM r LEFT JOIN i USING (source_file, topic_number, chunk_index)"""
)
def images_by_number(spark, d):
    """Images joined to chunks by printed topic number and chunk number: two topics of one number share theirs."""
    return K.images_by_number(table(spark, d, "chunk"))


@query(
    """WITH r AS (SELECT DISTINCT ON (chunk_id) source_file, topic, chunk_id, chunk_index, text FROM chunk WHERE topic IS NOT NULL),
l AS (SELECT source_file, topic, chunk_id AS table_id, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1)::INT - 1 AS line_no, UNNEST(STRING_SPLIT(text, chr(10))) AS line FROM r),
t AS (SELECT source_file, topic, table_id, line_no, LIST_TRANSFORM(STRING_SPLIT(REGEXP_REPLACE(TRIM(line), '^\\||\\|$', '', 'g'), '|'), lambda x: TRIM(x)) AS cells FROM l WHERE REGEXP_MATCHES(line, '^\\s*\\|.*\\|\\s*$') AND NOT REGEXP_MATCHES(line, '^[\\s|:-]+$')),
c AS (SELECT source_file, topic, table_id, line_no, GENERATE_SUBSCRIPTS(cells, 1) AS pos, UNNEST(cells) AS cell FROM t),
m AS (SELECT c.table_id, ARG_MIN(r.chunk_id, ROW(c.line_no, c.pos, r.chunk_index, r.chunk_id)) AS hit FROM c JOIN r ON r.source_file = c.source_file AND r.topic = c.topic AND c.cell <> '' AND CONTAINS(r.text, c.cell) GROUP BY 1),
f AS (SELECT source_file, topic, ARG_MIN(chunk_id, ROW(chunk_index, chunk_id)) AS first FROM r GROUP BY ALL)
SELECT DISTINCT table_id, COALESCE(hit, first) AS chunk_id FROM t JOIN f USING (source_file, topic) LEFT JOIN m USING (table_id)"""
)
def table_chunks(spark, d):
    """The chunk of a table's topic that holds the table's first cell found in any, else the topic's first chunk."""
    return K.table_chunks(table(spark, d, "chunk"))


@query(
    """WITH k AS (SELECT DISTINCT chunk_id, class, subject, source_file, chapter FROM chunk), v AS (SELECT source_file, chapter, COUNT(*) AS n FROM chunk WHERE LOWER(TRIM(chapter)) NOT IN ('unknown', '') GROUP BY ALL),
b AS (SELECT source_file, ARG_MAX(chapter, ROW(n, chapter)) AS title FROM v GROUP BY 1), x AS (SELECT class, subject, source_file, COUNT(*) AS rows, COUNT(*) FILTER (chapter IS DISTINCT FROM title) AS differing FROM k JOIN b USING (source_file) GROUP BY ALL)
SELECT class, subject, source_file, rows, differing, CASE WHEN differing > 0 THEN rows ELSE 0 END AS rewritten FROM x"""
)
def patch_counts(spark, d):
    """A dry run of titles over the chunks of each book: rows, those that differ, and those that would be written (all of a book, if any differs)."""
    chunks = table(spark, d, "chunk")
    known = chunks.where("lower(trim(chapter)) NOT IN ('unknown', '')").groupBy("source_file", "chapter").agg(F.count(F.lit(1)).alias("n"))
    titles = known.groupBy("source_file").agg(F.max_by("chapter", F.struct("n", "chapter")).alias("title"))
    return K.patch_counts(chunks, titles)


@query(
    f"""WITH {PAGES}, c AS (SELECT *, REGEXP_MATCHES(text, '^\\s*Fig(?:ure|\\.)\\s*\\d+\\.\\d+') AS starts FROM p),
n AS (SELECT *, SUM(starts::INT) OVER (PARTITION BY doc, page, block ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS k FROM c)
SELECT doc, page, block, k::BIGINT AS k, REGEXP_EXTRACT(MIN(CASE WHEN starts THEN text END), '(\\d+\\.\\d+)', 1) AS number, STRING_AGG(TRIM(text), ' ' ORDER BY line_no) AS caption FROM n WHERE k > 0 AND TRIM(text) <> '' GROUP BY ALL"""
)
def figure_captions(spark, d):
    """Captions with the lines that follow them in their block."""
    return L.captions(pages(spark, d))


@query(
    f"""WITH {PAGES}, k AS (SELECT DISTINCT doc, page, REGEXP_REPLACE(UPPER(text), '[^\\p{{L}}]', '', 'g') AS key FROM p), g AS (SELECT doc, key, LIST(page) AS on_pages FROM k WHERE LENGTH(key) >= 6 GROUP BY ALL),
r AS (SELECT doc, key, on_pages FROM g WHERE LEN(on_pages) >= 2), w AS (SELECT a.doc, a.key, a.on_pages, COALESCE((SELECT ARG_MAX(b.key, ROW(LENGTH(b.key), b.key)) FROM r b WHERE b.doc = a.doc AND STARTS_WITH(b.key, a.key)), a.key) AS full_key FROM r a)
SELECT doc, full_key AS key, COUNT(DISTINCT page) AS pages FROM (SELECT doc, full_key, UNNEST(on_pages) AS page FROM w) GROUP BY ALL"""
)
def merged_headers(spark, d):
    """Repeated lines of a book by their letters; a clipped one counts with the fullest that begins like it."""
    return H.merged_headers(pages(spark, d))


@query(
    """WITH t AS (SELECT DISTINCT * FROM quiz_attempts) SELECT attempt_id, CASE WHEN difficulty = 'easy' THEN 0 ELSE COUNT(*) FILTER (difficulty <> 'easy') OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) END AS used FROM t"""
)
def quota_open(spark, d):
    """Rolling use without the requests that are free of it (here the easy ones)."""
    a = table(spark, d, "quiz_attempts").dropDuplicates(["attempt_id"])
    counted = P.rolling_use(a.where("difficulty <> 'easy'")).select("attempt_id", "used")
    return counted.union(a.where("difficulty = 'easy'").select("attempt_id", F.lit(0).cast("long")))


@query("""WITH s AS (SELECT DISTINCT user_id, subject FROM quiz_attempts) SELECT user_id, STRING_AGG(subject, '|' ORDER BY subject) AS labels FROM s GROUP BY 1""")
def sorted_labels(spark, d):
    return table(spark, d, "quiz_attempts").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("subject")), "|").alias("labels"))


@query(f"WITH {PAGES}, c AS (SELECT doc, page, block, line_no, RTRIM(text, ' ') AS text FROM p WHERE TRIM(text, ' ') <> '' AND REGEXP_MATCHES(text, '^[ -~]+$')) SELECT doc, page, block, text, COUNT(*) AS n FROM c GROUP BY ALL")
def lines_of_glyphs(spark, d):
    """Lines set as characters and put together again; repeated characters on one place (a bold print) count once."""
    ship(spark)
    lines = pages(spark, d).where(F.col("text").rlike("^[ -~]+$") & (F.trim("text") != ""))
    chars = lines.select("doc", "page", "block", "line_no", F.posexplode(F.split(F.rtrim("text"), "")).alias("pos", "c")).where("c <> ''")
    x, y = F.col("pos") * 6.0, F.col("line_no") * 14.0
    twice = F.explode(F.when(F.col("line_no") % 3 == 0, F.array(F.lit(0.0), F.lit(0.5))).otherwise(F.array(F.lit(0.0)))).alias("shift")
    glyphs = chars.select("doc", "page", "block", "pos", "c", x.alias("x"), y.alias("y0"), twice).select(
        "doc", "page", "block", "pos", "c", (F.col("x") + F.col("shift")).alias("x0"), (F.col("x") + F.col("shift") + 5).alias("x1"), "y0", (F.col("y0") + 10).alias("y1"), F.lit(10.0).alias("size")
    )
    return L.glyph_lines(glyphs).groupBy("doc", "page", "block", "text").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT DISTINCT NULLIF(source_chunk_id, '') AS chunk_id FROM questions), b AS (SELECT a.chunk_id, text FROM a LEFT JOIN (SELECT chunk_id, ARG_MIN(text, ROW(chunk_index, text)) AS text FROM chunk GROUP BY 1) t USING (chunk_id)),
r0 AS (SELECT DISTINCT chunk_id, repair_id, before, COALESCE(after, '') AS after FROM source_repairs WHERE chunk_id IS NOT NULL AND before <> ''),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY repair_id, before, after) AS k FROM r0), m AS (SELECT chunk_id, MAX(k) AS m FROM r GROUP BY 1),
s AS (WITH RECURSIVE s AS (SELECT chunk_id, text, 0::BIGINT AS k FROM b WHERE chunk_id IN (SELECT chunk_id FROM r) AND text IS NOT NULL UNION ALL SELECT s.chunk_id, REPLACE(s.text, r.before, r.after), r.k FROM s JOIN r ON r.chunk_id = s.chunk_id AND r.k = s.k + 1) SELECT * FROM s)
SELECT b.chunk_id, COALESCE(s.text, b.text) AS text FROM b LEFT JOIN m USING (chunk_id) LEFT JOIN s ON s.chunk_id = b.chunk_id AND s.k = m.m"""
)
def chunk_text_repaired(spark, d):
    """The text of each asked chunk as it reads with its repairs."""
    asked = _q(spark, d).select(F.nullif(F.col("source_chunk_id"), F.lit("")).alias("chunk_id"))
    return K.with_repairs(R.chunk_text(asked, table(spark, d, "chunk")), table(spark, d, "source_repairs"))


@query(
    """WITH o AS (SELECT chunk_id, text FROM chunk WHERE chunk_id IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY LENGTH(text) DESC, text) = 1),
n AS (SELECT DISTINCT chunk_id, 'new ' || chunk_id AS text FROM chunk WHERE chunk_index = 0 UNION ALL SELECT DISTINCT 'x' || chunk_id, 'added' FROM chunk WHERE chunk_index = 1)
SELECT * FROM n WHERE chunk_id IS NOT NULL UNION ALL SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n WHERE chunk_id IS NOT NULL)"""
)
def chunk_upsert(spark, d):
    """Chunks with new texts for first chunks and some that are added: new rows win."""
    c = table(spark, d, "chunk").where("chunk_id IS NOT NULL")
    old = D.latest(c, ["chunk_id"], F.desc(F.length("text")), F.col("text")).select("chunk_id", "text")
    first = c.where("chunk_index = 0").select("chunk_id", F.concat(F.lit("new "), "chunk_id").alias("text")).distinct()
    added = c.where("chunk_index = 1").select(F.concat(F.lit("x"), "chunk_id").alias("chunk_id"), F.lit("added").alias("text")).distinct()
    return S.upserted(old, first.union(added), ["chunk_id"])


@query("SELECT user_id, ARG_MAX(event_type, ROW(ts, event_id)) AS default_class, MIN(ts) AS created_at, MAX(ts) AS updated_at FROM events GROUP BY 1")
def profile_merge(spark, d):
    """Stored profiles (events of even number) with updates (odd ones): the last value, the first time and the last time stay."""
    e = table(spark, d, "events")
    key = F.struct("ts", "event_id")
    stored, new = (
        e.where(f"event_id % 2 = {n}").groupBy("user_id").agg(F.max_by("event_type", key).alias("default_class"), F.max(key).alias("last"), F.min("ts").alias("created_at")) for n in (0, 1)
    )
    both = stored.unionByName(new).groupBy("user_id")
    return both.agg(F.max_by("default_class", "last").alias("default_class"), F.min("created_at").alias("created_at"), F.max("last.ts").alias("updated_at"))


@query(
    f"""WITH gate AS ({registry._SQL["draft_gate"]}), rules AS ({registry._SQL["payload_rules"]})
SELECT question_id, CASE WHEN batch_no <> 0 THEN 'not approved' WHEN gate.reason <> '' THEN gate.reason ELSE rules.reason END AS reason FROM questions JOIN gate USING (question_id) JOIN rules USING (question_id)"""
)
def draft_rules(spark, d):
    """Drafts by all rules: approved (here: of the first batch), in scope and unchanged, payload in order."""
    q = _q(spark, d)
    gate = R.gate(q, table(spark, d, "chunk")).withColumnRenamed("reason", "gate")
    rules = V.payload_rules(q).select("question_id", F.col("reason").alias("rule"))
    told = F.when(F.col("batch_no") != 0, "not approved").when(F.col("gate") != "", F.col("gate")).otherwise(F.col("rule"))
    return q.select("question_id", "batch_no").join(gate, "question_id").join(rules, "question_id").select("question_id", told.alias("reason"))


@query(
    f"""WITH {PAGES}, {NUMBERED}, loose AS (SELECT doc, number, MAX(size) AS size FROM n0 GROUP BY ALL), found AS (SELECT doc, number FROM fold WHERE kept)
SELECT COALESCE(l.doc, f.doc) AS doc, COALESCE(l.number, f.number) AS number, CASE WHEN f.number IS NOT NULL THEN 'found' WHEN size < heading_size - 0.5 THEN 'small' ELSE 'missing' END AS side
FROM loose l FULL JOIN found f ON f.doc = l.doc AND f.number = l.number LEFT JOIN (SELECT DISTINCT doc, heading_size FROM cal) c ON c.doc = COALESCE(l.doc, f.doc)"""
)
def layout_compare(spark, d):
    """Lines shaped like headings against those the detector takes: found, left out for their small size, or missing."""
    ship(spark)
    return H.compared(pages(spark, d))


@query(
    f"""WITH t AS (SELECT DISTINCT TRIM(payload->>'$.answer') AS term FROM questions WHERE type = 'fill_in_blank' UNION SELECT DISTINCT UNNEST(STRING_SPLIT(REGEXP_REPLACE(text, '[^A-Za-z0-9()]+', ' ', 'g'), ' ')) FROM chunk)
SELECT term FROM t WHERE {FORMULA.format(c='term')}"""
)
def formula_terms(spark, d):
    """Answers and words of the chunks that have the shape of a formula."""
    from studyloom.operators.names import is_formula

    words = table(spark, d, "chunk").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z0-9()]+", " "), " ")).alias("term"))
    answers = _q(spark, d).where("type = 'fill_in_blank'").select(F.trim(F.get_json_object("payload", "$.answer")).alias("term"))
    return words.union(answers).distinct().where(is_formula(F.col("term")))


@query(
    f"""WITH v AS ({GRADES}), s AS (SELECT attempt_id, COUNT(*) FILTER (verdict) AS correct, COUNT(*) AS total FROM v GROUP BY 1), t AS (SELECT DISTINCT attempt_id, score_correct FROM quiz_attempts)
SELECT attempt_id, correct, total, score_correct AS stored, correct = score_correct AS same FROM s JOIN t USING (attempt_id)"""
)
def submission_grades(spark, d):
    """Attempts graded anew, against their stored scores."""
    from studyloom.operators import grading as G

    v = G.graded(table(spark, d, "attempt_answers"), _q(spark, d)).groupBy("attempt_id").agg(F.count_if("verdict").alias("correct"), F.count(F.lit(1)).alias("total"))
    stored = table(spark, d, "quiz_attempts").select("attempt_id", F.col("score_correct").alias("stored")).distinct()
    return v.join(stored, "attempt_id").withColumn("same", F.col("correct") == F.col("stored"))


@query(
    """WITH l AS (SELECT DISTINCT chunk_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line FROM chunk), w AS (SELECT chunk_id, line, UNNEST(REGEXP_EXTRACT_ALL(LOWER(line), '[a-z]{2,}')) AS word FROM l),
k AS (SELECT word FROM w GROUP BY 1 HAVING COUNT(DISTINCT chunk_id) >= 3)
SELECT chunk_id, line, COUNT(*) AS words, COUNT(k.word) AS known FROM w LEFT JOIN k USING (word) GROUP BY ALL HAVING COUNT(*) >= 4 AND COUNT(k.word) < 0.35 * COUNT(*)"""
)
def garbled_lines(spark, d):
    """Lines of four words or more of which fewer than 35 % stand in three chunks or more."""
    from studyloom.operators.names import garbled_lines as found

    lines = table(spark, d, "chunk").select("chunk_id", F.explode(F.split("text", "\n")).alias("line")).distinct()
    words = lines.select("chunk_id", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("([a-z]{2,})"), F.lit(1))).alias("word"))
    known = words.groupBy("word").agg(F.countDistinct("chunk_id").alias("n")).where("n >= 3").select("word")
    return found(lines, known)


@query(
    """WITH l0 AS (SELECT DISTINCT source_file, chunk_id, chunk_index, text FROM chunk), l AS (SELECT chunk_id, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1)::INT - 1 AS line_no, UNNEST(STRING_SPLIT(text, chr(10))) AS text FROM l0),
t AS (SELECT DISTINCT chunk_id, line_no, LIST_TRANSFORM(STRING_SPLIT(REGEXP_REPLACE(TRIM(text), '^\\||\\|$', '', 'g'), '|'), lambda x: TRIM(x)) AS cells FROM l WHERE REGEXP_MATCHES(text, '^\\s*\\|.*\\|\\s*$') AND NOT REGEXP_MATCHES(text, '^[\\s|:-]+$')),
r AS (SELECT chunk_id, line_no, '| ' || ARRAY_TO_STRING(cells, ' | ') || ' |' AS line, cells FROM t), g AS (SELECT chunk_id, LIST(line ORDER BY line_no) AS ls, FIRST(LEN(cells) ORDER BY line_no) AS width, MAX(LIST_MAX(LIST_TRANSFORM(cells, lambda c: LENGTH(c)))) AS longest FROM r GROUP BY 1)
SELECT chunk_id, ls[1] || chr(10) || '|' || REPEAT(' --- |', width) || CASE WHEN LEN(ls) > 1 THEN chr(10) || ARRAY_TO_STRING(ls[2:], chr(10)) ELSE '' END AS markdown FROM g WHERE longest <= 20"""
)
def table_markdown(spark, d):
    """The tables of the chunks, those without a long cell, as Markdown."""
    rows = K.tables_in_chunks(table(spark, d, "chunk")).distinct()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "cells"))), lambda r: F.split(r["cells"], ";", -1))
    tables = rows.groupBy("chunk_id").agg(listed.alias("rows")).withColumn("area", F.lit(0.1))
    return K.markdown(K.real_tables(tables, most_chars=20)).select("chunk_id", "markdown")
