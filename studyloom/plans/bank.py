"""Queries over the bank: catalog, lookup, duplicates, grading, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import answers as A
from studyloom.operators import bank as B
from studyloom.operators import catalog as C
from studyloom.operators import dedup as D
from studyloom.operators import grading as G
from studyloom.operators import retrieval as R
from studyloom.operators import validate as V
from studyloom.plans.registry import query
from studyloom.session import ship, table

SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_normal(c: str) -> str:
    return f"REGEXP_REPLACE(REGEXP_REPLACE(LOWER({c}), '{SPACE}', ' ', 'g'), '^ | $', '', 'g')"


def _q(spark, d):
    return table(spark, d, "questions")


@query(
    """WITH n AS (SELECT class, subject, chapter, topic, ARG_MIN(ROW(NULLIF(topic_number, '')), ROW(source_file, chunk_index, chunk_id)) AS w FROM chunk WHERE topic IS NOT NULL GROUP BY ALL),
m AS (SELECT * EXCLUDE (w), w[1] AS number FROM n)
SELECT *, ROW_NUMBER() OVER (PARTITION BY class, subject, chapter ORDER BY number IS NULL,
 LIST_TRANSFORM(REGEXP_EXTRACT_ALL(number, '\\d+'), lambda x: CAST(x AS INT)), topic)::INT AS place FROM m"""
)
def catalog_topics(spark, d):
    return C.topics(table(spark, d, "chunk"))


@query("SELECT class, subject, chapter, COUNT(DISTINCT topic) AS topics, COUNT(DISTINCT chunk_id) AS chunks FROM chunk GROUP BY ALL")
def catalog_counts(spark, d):
    return C.counts(table(spark, d, "chunk"))


@query(
    """WITH n AS (SELECT class, subject, chapter, COUNT(DISTINCT topic) AS topics, COUNT(DISTINCT chunk_id) AS chunks FROM chunk GROUP BY ALL)
SELECT *, ARRAY_TO_STRING(LIST_FILTER([5, 10, 15, 20, 25], lambda c: topics >= 25 OR c > topics), ',') AS options FROM n"""
)
def count_options(spark, d):
    return C.count_options(C.counts(table(spark, d, "chunk")))


@query(
    """WITH a AS (SELECT DISTINCT attempt_id, class, LOWER(TRIM(subject)) AS subject, scope FROM quiz_attempts),
u AS (SELECT attempt_id, class, subject, scope->>'$.scope_type' AS scope_type, UNNEST(CAST(scope->'$.sub_units' AS VARCHAR[])) AS unit FROM a),
h AS (SELECT DISTINCT class, LOWER(TRIM(subject)) AS subject, UNNEST([chapter, topic]) AS unit FROM questions)
SELECT class, subject, unit, attempt_id, scope_type FROM u ANTI JOIN h USING (class, subject, unit)"""
)
def scope_violations(spark, d):
    return C.violations(table(spark, d, "quiz_attempts"), _q(spark, d))


@query(
    """WITH a AS (SELECT DISTINCT class, subject, chapter, topic FROM questions), b AS (SELECT DISTINCT class, subject, chapter, topic FROM chunk)
SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def set_two_sided(spark, d):
    return C.two_sided(_q(spark, d), table(spark, d, "chunk"), "class", "subject", "chapter", "topic")


@query("SELECT DISTINCT class, chapter FROM questions EXCEPT SELECT DISTINCT class, chapter FROM chunk")
def set_difference(spark, d):
    return _q(spark, d).select("class", "chapter").subtract(table(spark, d, "chunk").select("class", "chapter"))


@query("SELECT topic FROM questions UNION SELECT topic FROM chunk")
def set_union_distinct(spark, d):
    return _q(spark, d).select("topic").union(table(spark, d, "chunk").select("topic")).distinct()


@query("SELECT class, topic FROM questions INTERSECT SELECT class, topic FROM chunk")
def set_intersection(spark, d):
    return _q(spark, d).select("class", "topic").intersect(table(spark, d, "chunk").select("class", "topic"))


@query(
    """SELECT question_id FROM questions WHERE type <> 'matching' OR (
LEN(CAST(payload->'$.left_items' AS VARCHAR[])) = LEN(LIST_DISTINCT(CAST(payload->'$.left_items' AS VARCHAR[])))
AND LEN(CAST(payload->'$.right_items' AS VARCHAR[])) = LEN(LIST_DISTINCT(CAST(payload->'$.right_items' AS VARCHAR[]))))"""
)
def matching_wellformed(spark, d):
    return B.wellformed_matching(_q(spark, d)).select("question_id")


@query(
    """SELECT question_id, type, CASE type WHEN 'MCQ' THEN ARRAY_TO_STRING(CAST(payload->'$.options' AS VARCHAR[]), '|')
WHEN 'matching' THEN ARRAY_TO_STRING(CAST(payload->'$.left_items' AS VARCHAR[]), '|') || '||' || ARRAY_TO_STRING(CAST(payload->'$.right_items' AS VARCHAR[]), '|')
WHEN 'fill_in_blank' THEN '' END AS shown FROM questions"""
)
def public_payload(spark, d):
    return B.public_payload(_q(spark, d))


@query(
    """WITH m AS (SELECT question_id, STRING_AGG(e.key || ' -> ' || (e.value->>'$'), '; ' ORDER BY e.id) AS t
FROM questions, JSON_EACH(payload, '$.pairs') e WHERE questions.type = 'matching' GROUP BY 1)
SELECT q.question_id, type, CASE type WHEN 'MCQ' THEN (CAST(payload->'$.options' AS VARCHAR[]))[CAST(payload->>'$.correct_option_index' AS INT) + 1]
WHEN 'matching' THEN m.t ELSE payload->>'$.answer' END AS correct_text FROM questions q LEFT JOIN m USING (question_id)"""
)
def correct_answer_text(spark, d):
    return B.correct_text(_q(spark, d))


REQUESTS = """a AS (SELECT DISTINCT attempt_id, user_id, class, subject, difficulty, scope FROM quiz_attempts),
u AS (SELECT DISTINCT user_id, class, subject, difficulty, UNNEST(CAST(scope->'$.sub_units' AS VARCHAR[])) AS unit FROM a),
s AS (SELECT DISTINCT class, subject, chapter, topic, UNNEST([chapter, topic]) AS unit FROM questions),
r AS (SELECT DISTINCT user_id, class, subject, chapter, topic, difficulty, t.question_type FROM u JOIN s USING (class, subject, unit), (VALUES ('MCQ'), ('fill_in_blank'), ('matching')) t(question_type)),
seen AS (SELECT DISTINCT user_id, question_id FROM attempt_answers JOIN a USING (attempt_id)),
fine AS (SELECT *, COALESCE(concept_cluster_id, question_id) AS cluster, SHA256('7|' || question_id) AS k FROM questions
WHERE (source_chunk_id NOT IN (SELECT chunk_id FROM source_repairs WHERE chunk_id IS NOT NULL) OR COALESCE((payload->>'$.source_revision') = '2', FALSE))
AND (type <> 'matching' OR (LEN(CAST(payload->'$.left_items' AS VARCHAR[])) = LEN(LIST_DISTINCT(CAST(payload->'$.left_items' AS VARCHAR[]))) AND LEN(CAST(payload->'$.right_items' AS VARCHAR[])) = LEN(LIST_DISTINCT(CAST(payload->'$.right_items' AS VARCHAR[])))))),
ex AS (SELECT DISTINCT user_id, COALESCE(concept_cluster_id, question_id) AS cluster FROM attempt_answers JOIN a USING (attempt_id) JOIN questions USING (question_id) WHERE is_correct),
q AS (SELECT question_id, class, subject, chapter, topic, difficulty, type AS question_type, cluster, k, MIN(k) OVER (PARTITION BY class, subject, chapter, topic, difficulty, type, cluster) AS lead FROM fine),
f AS (SELECT r.*, q.question_id, q.cluster, q.k, q.lead FROM r JOIN q USING (class, subject, chapter, topic, difficulty, question_type)
WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = r.user_id AND seen.question_id = q.question_id) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.user_id = r.user_id AND ex.cluster = q.cluster)),
o AS (SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, class, subject, chapter, topic, difficulty, question_type, cluster ORDER BY k) = 1),
p AS (SELECT user_id, class, subject, chapter, topic, difficulty, question_type, question_id, ROW_NUMBER() OVER (PARTITION BY user_id, class, subject, chapter, topic, difficulty, question_type ORDER BY lead)::INT AS pos FROM o QUALIFY pos <= 5)
"""


def _lookup(spark, d):
    """For each user and each topic that an attempt of theirs names (by itself or by its chapter) and each type: five questions that are not
    under review, well formed, not seen, and of no concept the user has answered rightly."""
    attempts, answers, q = table(spark, d, "quiz_attempts"), table(spark, d, "attempt_answers"), _q(spark, d)
    kinds = F.explode(F.array(*(F.lit(k) for k in ("MCQ", "fill_in_blank", "matching")))).alias("question_type")
    requests = C.resolved_units(attempts, q).select("user_id", "class", "subject", "chapter", "topic", "difficulty", kinds).distinct()
    reviewed = R.quarantine(q, table(spark, d, "source_repairs"), "2").where("needs_review IS NULL OR NOT needs_review")
    fine = B.wellformed_matching(q).join(reviewed.select("question_id"), "question_id", "left_semi")
    cluster = F.coalesce("concept_cluster_id", "question_id").alias("cluster")
    known = B.seen_pairs(answers.where("is_correct"), attempts).join(q.select("question_id", cluster), "question_id").select("user_id", "cluster").distinct()
    return requests, B.lookup(requests, fine, B.seen_pairs(answers, attempts), excluded=known)


@query(f"WITH {REQUESTS} SELECT * FROM p")
def bank_lookup(spark, d):
    return _lookup(spark, d)[1]


@query(
    f"""WITH {REQUESTS}, n AS (SELECT user_id, class, subject, chapter, topic, difficulty, question_type, COUNT(*) AS found FROM p GROUP BY ALL)
SELECT r.*, COALESCE(found, 0) AS found, 5 - COALESCE(found, 0) AS shortfall, CASE COALESCE(found, 0) WHEN 5 THEN 'full' WHEN 0 THEN 'empty' ELSE 'partial' END AS outcome
FROM r LEFT JOIN n USING (user_id, class, subject, chapter, topic, difficulty, question_type)"""
)
def bank_shortfall(spark, d):
    return B.shortfall(*_lookup(spark, d))


@query(
    """WITH a AS (SELECT DISTINCT attempt_id, user_id, created_at FROM quiz_attempts), s AS (SELECT DISTINCT user_id, question_id, created_at FROM attempt_answers JOIN a USING (attempt_id))
SELECT DISTINCT user_id, question_id FROM s WHERE created_at >= TIMESTAMP '2025-06-01'
EXCEPT SELECT user_id, question_id FROM s WHERE created_at < TIMESTAMP '2025-06-01'"""
)
def seen_insert_ignore(spark, d):
    attempts, answers = table(spark, d, "quiz_attempts"), table(spark, d, "attempt_answers")
    early = F.col("created_at") < F.lit("2025-06-01").cast("timestamp_ntz")
    return B.insert_absent(B.seen_pairs(answers, attempts.where(early)), B.seen_pairs(answers, attempts.where(~early)), "user_id", "question_id")


@query("SELECT question_id, COALESCE(CASE WHEN TRIM(explanation) <> '' THEN explanation END, '') AS explanation, COALESCE(TRIM(explanation), '') = '' AS pending FROM questions")
def explanation_cache(spark, d):
    return B.explanation_cache(_q(spark, d))


@query(
    """WITH e AS (SELECT *, SHA256('3|' || id) AS k FROM reference_corpus WHERE answer IS NOT NULL AND TRIM(answer) <> ''),
t AS (SELECT class, subject, chapter, topic, ARG_MIN(id, k) AS topic_pick FROM e WHERE topic IS NOT NULL GROUP BY ALL),
c AS (SELECT class, subject, chapter, ARG_MIN(id, k) AS chapter_pick FROM e GROUP BY ALL)
SELECT question_id, COALESCE(topic_pick, chapter_pick) AS reference_id, topic_pick IS NOT NULL AS same_topic FROM questions
LEFT JOIN t USING (class, subject, chapter, topic) LEFT JOIN c USING (class, subject, chapter)"""
)
def style_pick(spark, d):
    return B.style_pick(_q(spark, d), table(spark, d, "reference_corpus"))


PAIRS = f"""m AS (SELECT question_id, '[' || STRING_AGG('[' || TO_JSON(k)::VARCHAR || ',' || TO_JSON(v)::VARCHAR || ']', ',' ORDER BY k, v) || ']' AS pairs FROM (SELECT question_id,
TRIM(REGEXP_REPLACE(e.key, '{SPACE}', ' ', 'g')) AS k, TRIM(REGEXP_REPLACE(e.value->>'$', '{SPACE}', ' ', 'g')) AS v
FROM questions, JSON_EACH(payload, '$.pairs') e WHERE questions.type = 'matching') GROUP BY 1),
i AS (SELECT q.question_id, class, subject, chapter, topic, created_at, CASE WHEN type = 'matching' THEN 'matching-v2:' || SHA256(pairs) ELSE SHA256({sql_normal("text")}) END AS identity
FROM questions q LEFT JOIN m USING (question_id))
"""


@query(f"WITH {PAIRS} SELECT question_id, identity FROM i")
def identity_hash(spark, d):
    return D.identity_hash(_q(spark, d)).select("question_id", "identity")


@query(
    f"""WITH {PAIRS} SELECT question_id, NULLIF(FIRST_VALUE(question_id) OVER (PARTITION BY class, subject, chapter, topic, identity ORDER BY created_at, question_id), question_id) AS duplicate_of FROM i"""
)
def exact_dedup(spark, d):
    return D.exact_duplicates(_q(spark, d))


@query(
    """WITH RECURSIVE g AS (SELECT question_id, class, topic, difficulty, type = 'matching' AS m, created_at, CAST(embedding AS DOUBLE[384]) AS v FROM questions
WHERE LEN(embedding) = 384 AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0 AND LEN(LIST_FILTER(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.question_id AS id, b.question_id AS parent, ROUND(ARRAY_COSINE_SIMILARITY(a.v, b.v), 9) AS s FROM g a JOIN g b
ON a.class = b.class AND a.topic = b.topic AND a.difficulty = b.difficulty AND a.m = b.m AND ROW(b.created_at, b.question_id) < ROW(a.created_at, a.question_id)),
p AS (SELECT id, parent FROM s WHERE s >= 0.9 QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY s DESC, parent) = 1),
c AS (SELECT question_id, question_id AS cluster FROM questions WHERE question_id NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, c.cluster FROM p JOIN c ON p.parent = c.question_id)
SELECT * FROM c"""
)
def forest_clusters(spark, d):
    ship(spark)
    return D.clusters(_q(spark, d))


NEAR = f"""g AS (SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM questions WHERE LEN(embedding) = 384 AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR ISNAN(x))) = 0 AND LEN(LIST_FILTER(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT question_id, LAG(question_id) OVER w AS before, v, LAG(v) OVER w AS e, text, LAG(text) OVER w AS t FROM g WINDOW w AS (PARTITION BY class, subject, chapter, topic ORDER BY created_at, question_id)),
n AS (SELECT question_id, before, ROUND(LIST_COSINE_SIMILARITY(v, e), 6) AS similarity, {sql_normal("text")} IS NOT DISTINCT FROM {sql_normal("t")} AS same_text FROM l WHERE before IS NOT NULL)
"""


@query(f"WITH {NEAR} SELECT * FROM n")
def topic_neighbours(spark, d):
    return D.neighbours_in_topic(_q(spark, d))


@query(
    f"""WITH {NEAR} SELECT COUNT(similarity) AS n, MIN(similarity) AS low, ROUND(QUANTILE_CONT(similarity, 0.25), 6) AS p25, ROUND(QUANTILE_CONT(similarity, 0.5), 6) AS median,
ROUND(QUANTILE_CONT(similarity, 0.75), 6) AS p75, ROUND(QUANTILE_CONT(similarity, 0.95), 6) AS p95, MAX(similarity) AS high FROM n"""
)
def similarity_stats(spark, d):
    return D.spread(D.neighbours_in_topic(_q(spark, d)), "similarity")


@query(
    f"""WITH {NEAR}, b AS (SELECT ROUND(similarity, 3) AS t, SUM(same_text::INT) AS near, SUM((NOT same_text)::INT) AS other FROM n GROUP BY 1),
s AS (SELECT t, CAST(COALESCE(SUM(near) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS missed,
CAST(SUM(other) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS merged FROM b)
SELECT * FROM s ORDER BY missed + merged, t LIMIT 1"""
)
def threshold_sweep(spark, d):
    return D.sweep(D.neighbours_in_topic(_q(spark, d)), F.col("same_text"))


@query(
    """WITH r AS (SELECT DISTINCT chunk_id, class, subject, source_file, COALESCE(topic, '') AS topic, COALESCE(topic_number, '') AS number, chunk_index FROM chunk),
o AS (SELECT *, DENSE_RANK() OVER (PARTITION BY class, subject, source_file ORDER BY LIST_TRANSFORM(REGEXP_EXTRACT_ALL(number, '\\d+'), lambda x: CAST(x AS INT)), topic, number)::INT - 1 AS ordinal FROM r)
SELECT chunk_id, ordinal, SUBSTR(SHA1(class || '|' || subject || '|' || source_file || '|' || ordinal || '|' || chunk_index), 1, 16) AS made_id FROM o"""
)
def chunk_ids(spark, d):
    return D.chunk_ids(table(spark, d, "chunk"))


@query(
    """SELECT chunk_id, topic, chunk_index FROM chunk QUALIFY ROW_NUMBER() OVER (PARTITION BY chunk_id ORDER BY LENGTH(text) DESC, topic, chunk_index) = 1"""
)
def latest_wins(spark, d):
    return D.latest(table(spark, d, "chunk"), ["chunk_id"], F.desc(F.length("text")), F.col("topic"), F.col("chunk_index")).select("chunk_id", "topic", "chunk_index")


NUM = "REGEXP_REPLACE(REGEXP_REPLACE({c}, '[,\\s]', '', 'g'), '[a-zA-Z%°]+$', '')"


def _num(c: str) -> str:
    bare = NUM.format(c=c)
    return f"CASE WHEN REGEXP_MATCHES({bare}, '^-?\\d+(\\.\\d+)?$') THEN {bare} END"


def sql_spaced(c: str) -> str:
    return f"REGEXP_REPLACE(REGEXP_REPLACE({c}, '{SPACE}', ' ', 'g'), '^ | $', '', 'g')"


KNOWN = ", ".join(f"('{name}', '{alias}')" for name, alias in A.ALIASES)
GROUPS = ", ".join(f"('{a}', '{b}')" for group in A.TERMS for a in group for b in group if a != b)
FORMULA = r"REGEXP_FULL_MATCH({c}, '(?:[A-Z][a-z]?\d*|\([A-Za-z0-9]+\)\d*)+') AND LEN(LIST_FILTER(REGEXP_EXTRACT_ALL({c}, '[A-Z][a-z]?'), lambda e: NOT LIST_CONTAINS(STRING_SPLIT('" + " ".join(A.ELEMENTS) + r"', ' '), e))) = 0"


def sql_substance(c: str) -> str:
    """First names and plain aliases in any case, then an alias as it is, then a small-letter formula of one substance."""
    return f"""COALESCE((SELECT MIN(name) FROM known WHERE LOWER({c}) = name OR (NOT formula AND LOWER({c}) = LOWER(alias))),
(SELECT CASE WHEN COUNT(DISTINCT name) = 1 THEN MIN(name) END FROM known WHERE {c} = alias),
(SELECT CASE WHEN COUNT(DISTINCT name) = 1 THEN MIN(name) END FROM known WHERE formula AND {c} = LOWER(alias) AND {c} = LOWER({c})))"""


GRADES = (
    f"""WITH a AS (SELECT DISTINCT attempt_id, question_id, user_answer FROM attempt_answers),
known AS (SELECT name, alias, {FORMULA.format(c='alias')} AS formula FROM (VALUES {KNOWN}) t(name, alias)), groups(one, other) AS (VALUES {GROUPS}),
f AS (SELECT attempt_id, question_id, type, user_answer, payload, {sql_spaced("('{\"a\":' || user_answer || '}')->>'$.a'")} AS given, {sql_spaced("payload->>'$.answer'")} AS key FROM a JOIN questions USING (question_id)),
t AS (SELECT DISTINCT key AS term FROM f WHERE key IS NOT NULL UNION SELECT DISTINCT given FROM f WHERE given IS NOT NULL),
n AS (SELECT term, {sql_substance("term")} AS substance FROM t),
m AS (SELECT attempt_id, question_id, BOOL_AND(COALESCE((MAP_FROM_ENTRIES(LIST_TRANSFORM(JSON_KEYS(user_answer), lambda u: ROW(u, JSON_EXTRACT_STRING(user_answer, '$."' || REPLACE(REPLACE(u, '\\', '\\\\'), '"', '\\"') || '"'))))[e.key]) = (e.value->>'$'), FALSE)) AS ok
FROM f, JSON_EACH(payload, '$.pairs') e WHERE f.type = 'matching' GROUP BY ALL)
SELECT f.attempt_id, f.question_id, type, CASE type WHEN 'MCQ' THEN COALESCE(TRY_CAST(user_answer AS INT) = CAST(payload->>'$.correct_option_index' AS INT), FALSE)
WHEN 'matching' THEN COALESCE(m.ok, FALSE) WHEN 'fill_in_blank' THEN COALESCE(CASE WHEN COALESCE(given, '') = '' THEN FALSE WHEN ({_num("key")}) IS NOT NULL THEN ({_num("key")}) IS NOT DISTINCT FROM ({_num("given")})
WHEN nk.substance IS NOT NULL THEN nk.substance IS NOT DISTINCT FROM ng.substance WHEN {FORMULA.format(c='key')} THEN key = given
ELSE LOWER(key) = LOWER(given) OR EXISTS (SELECT 1 FROM groups WHERE LOWER(one) = LOWER(key) AND LOWER(other) = LOWER(given)) END, FALSE) END AS verdict
FROM f LEFT JOIN m USING (attempt_id, question_id) LEFT JOIN n nk ON nk.term = key LEFT JOIN n ng ON ng.term = given"""
)


@query(GRADES)
def grade_answers(spark, d):
    return G.graded(table(spark, d, "attempt_answers"), _q(spark, d))


@query(GRADES)  # DuckDB has no compatibility form: the same wherever texts are in it already
def grade_answers_unicode(spark, d):
    ship(spark)
    return G.graded(table(spark, d, "attempt_answers"), _q(spark, d), unicode=True)


@query(
    """WITH a AS (SELECT DISTINCT attempt_id, question_id, user_answer FROM attempt_answers),
m AS (SELECT a.* FROM a JOIN questions USING (question_id) WHERE type = 'matching'),
u AS (SELECT attempt_id, question_id, e.key AS k, e.value->>'$' AS v FROM m, JSON_EACH(m.user_answer) e),
p AS (SELECT question_id, e.key AS k, e.value->>'$' AS v FROM questions, JSON_EACH(payload, '$.pairs') e WHERE questions.type = 'matching')
SELECT a.attempt_id, question_id, CAST(SUM((u.v IS NOT NULL)::INT) AS INT) AS right, CAST(COUNT(*) AS INT) AS pairs FROM a JOIN p USING (question_id) LEFT JOIN u USING (attempt_id, question_id, k, v) GROUP BY 1, 2"""
)
def grade_pairs(spark, d):
    return G.pair_results(table(spark, d, "attempt_answers"), _q(spark, d))


LEFT_ITEMS, RIGHT_ITEMS = ("CAST(payload->'$.left_items' AS VARCHAR[])", "CAST(payload->'$.right_items' AS VARCHAR[])")


@query(
    f"""WITH p AS (SELECT question_id, LIST(e.key ORDER BY e.key) AS ks, LIST(e.value->>'$' ORDER BY e.value->>'$') AS vs FROM questions, JSON_EACH(payload, '$.pairs') e WHERE questions.type = 'matching' GROUP BY 1)
SELECT question_id, type, COALESCE(CASE type WHEN 'MCQ' THEN CASE WHEN COALESCE(TRIM(payload->>'$.question'), '') = '' THEN 'no question' WHEN COALESCE(LEN(CAST(payload->'$.options' AS VARCHAR[])), 0) <> 4 THEN 'not four options'
WHEN NOT COALESCE(CAST(payload->>'$.correct_option_index' AS INT) BETWEEN 0 AND 3, FALSE) THEN 'index out of range' END
WHEN 'fill_in_blank' THEN CASE WHEN COALESCE(TRIM(payload->>'$.answer'), '') = '' THEN 'no answer'
WHEN LEN(REGEXP_SPLIT_TO_ARRAY(TRIM(payload->>'$.answer'), '\\s+')) > 4 OR REGEXP_MATCHES(payload->>'$.answer', '[.!?;]') THEN 'not a term'
WHEN REGEXP_MATCHES(payload->>'$.answer', '[\\^*/=()×÷]|[²³]|\\w+ x \\w+') THEN 'a formula' WHEN COALESCE(LEN(CAST(payload->'$.accepted_answers' AS VARCHAR[])), 0) > 8 THEN 'too many aliases' END
ELSE CASE WHEN COALESCE(LEN({LEFT_ITEMS}), 0) < 3 OR COALESCE(LEN({RIGHT_ITEMS}), 0) < 3 THEN 'fewer than three' WHEN LEN({LEFT_ITEMS}) <> LEN({RIGHT_ITEMS}) THEN 'sides differ'
WHEN LEN({LEFT_ITEMS}) <> LEN(LIST_DISTINCT({LEFT_ITEMS})) OR LEN({RIGHT_ITEMS}) <> LEN(LIST_DISTINCT({RIGHT_ITEMS})) THEN 'repeated item'
WHEN ks <> LIST_SORT({LEFT_ITEMS}) OR vs <> LIST_SORT({RIGHT_ITEMS}) THEN 'pairs don''t fit' END END, '') AS reason FROM questions LEFT JOIN p USING (question_id)"""
)
def payload_rules(spark, d):
    return V.payload_rules(_q(spark, d))


@query("SELECT question_id FROM questions WHERE COALESCE(difficulty NOT IN ('easy', 'medium', 'hard'), TRUE) OR COALESCE(type NOT IN ('MCQ', 'fill_in_blank', 'matching'), TRUE)")
def enumerations(spark, d):
    return V.enumerations(_q(spark, d)).select("question_id")
