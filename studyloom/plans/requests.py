"""Queries over quiz requests: their faults, their allocation, access to attempts, answers that can't be graded."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import allocate as A
from studyloom.operators import catalog as C
from studyloom.operators import retrieval as R
from studyloom.plans.registry import query
from studyloom.session import table

KIND = """CASE WHEN scope->>'$.scope_type' = 'subject' THEN 'all_chapters_in_subject' WHEN scope->>'$.scope_type' = 'chapter' THEN 'all_topics_in_chapter' ELSE 'topics' END"""
# units of a request: of a subject its chapters, of chapters their topics, else what it names
REQUESTS = f"""a AS (SELECT attempt_id AS request_id, ANY_VALUE(user_id) AS user_id, ANY_VALUE(class) AS class, ANY_VALUE(subject) AS subject, ANY_VALUE({KIND}) AS scope_type, ANY_VALUE(score_total) AS question_count, ANY_VALUE(scope) AS scope FROM quiz_attempts GROUP BY 1),
h AS (SELECT DISTINCT class, subject, chapter, topic FROM questions),
named AS (SELECT request_id, class, subject, UNNEST(CAST(scope->'$.sub_units' AS VARCHAR[])) AS name FROM a),
parts AS (SELECT DISTINCT request_id, scope_type, COALESCE(CASE scope_type WHEN 'all_topics_in_chapter' THEN h.topic END, name) AS unit
FROM named JOIN a USING (request_id) LEFT JOIN h ON a.scope_type = 'all_topics_in_chapter' AND h.class = named.class AND h.subject = named.subject AND h.chapter = name),
r AS (SELECT request_id, user_id, scope_type, question_count, COALESCE(units, []) AS units, ['MCQ', 'fill_in_blank', 'matching'] AS types FROM a LEFT JOIN (SELECT request_id, LIST(unit ORDER BY unit) AS units FROM parts GROUP BY 1) USING (request_id)),
v AS (SELECT *, CASE WHEN NOT COALESCE(question_count IN (5, 10, 15, 20, 25), FALSE) THEN 'question count' WHEN LEN(units) = 0 THEN 'no units' WHEN scope_type LIKE 'all%' AND LEN(units) < 25 AND question_count <= LEN(units) THEN 'coverage' ELSE '' END AS fault FROM r)
"""
U = "(('0x' || SUBSTR(SHA256({key}), 1, 13))::BIGINT / POW(16, 13))"


def _requests(spark, d):
    attempts, q = table(spark, d, "quiz_attempts"), table(spark, d, "questions")
    kind = F.get_json_object("scope", "$.scope_type")
    a = attempts.dropDuplicates(["attempt_id"]).select(
        F.col("attempt_id").alias("request_id"), "user_id", "class", "subject", F.col("score_total").alias("question_count"),
        F.when(kind == "subject", "all_chapters_in_subject").when(kind == "chapter", "all_topics_in_chapter").otherwise("topics").alias("scope_type"),
    )
    named = C.requested_units(attempts).select(F.col("attempt_id").alias("request_id"), "class", "subject", F.col("unit").alias("name"))
    have = q.select("class", "subject", F.col("chapter").alias("name"), "topic").distinct().withColumn("scope_type", F.lit("all_topics_in_chapter"))
    parts = named.join(a.select("request_id", "scope_type"), "request_id").join(have, ["class", "subject", "name", "scope_type"], "left")
    units = parts.groupBy("request_id").agg(F.array_sort(F.collect_set(F.coalesce("topic", "name"))).alias("units"))
    types = F.array(*(F.lit(k) for k in ("MCQ", "fill_in_blank", "matching")))
    return a.join(units, "request_id", "left").select(
        "request_id", "user_id", "scope_type", "question_count", F.coalesce("units", F.array().cast("array<string>")).alias("units"), types.alias("types")
    )


@query(f"WITH {REQUESTS} SELECT request_id, scope_type, LEN(units)::INT AS units, fault FROM v")
def request_faults(spark, d):
    return A.request_faults(_requests(spark, d)).select("request_id", "scope_type", F.size("units").alias("units"), "fault")


HISTORY = """g AS (SELECT DISTINCT user_id, attempt_id, question_id, is_correct FROM attempt_answers JOIN (SELECT DISTINCT attempt_id, user_id FROM quiz_attempts) USING (attempt_id)),
hist AS (SELECT user_id, unit, SUM(is_correct::INT) AS correct, COUNT(*) AS total FROM (SELECT user_id, is_correct, UNNEST([chapter, topic]) AS unit FROM g JOIN questions USING (question_id)) GROUP BY ALL),
past AS (SELECT request_id, unit, correct, total FROM (SELECT request_id, user_id, UNNEST(units) AS unit FROM v WHERE SUBSTR(request_id, 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7')) JOIN hist USING (user_id, unit))
"""


@query(
    f"""WITH {REQUESTS}, {HISTORY},
u AS (SELECT request_id, question_count, UNNEST(units) AS unit, GENERATE_SUBSCRIPTS(units, 1) - 1 AS unit_no, LEN(units) AS n_units FROM v WHERE fault = ''),
w AS (SELECT u.*, request_id IN (SELECT request_id FROM past) AS known, ROUND(COALESCE(GREATEST(0.0, 1 - CASE WHEN total >= 3 THEN correct::DOUBLE / total END), 0.5), 6) AS weight FROM u LEFT JOIN past USING (request_id, unit)),
d AS (SELECT *, GREATEST({U.format(key="'21a|' || request_id || '|' || unit_no")}, 1e-300) AS u1, GREATEST({U.format(key="'21b|' || request_id || '|' || unit_no")}, 1e-300) AS u2 FROM w),
e AS (SELECT *, CASE WHEN NOT known THEN ROUND(u1, 9) WHEN weight > 0 THEN ROUND(-LN(u1) / weight, 9) END AS a, CASE WHEN NOT known THEN ROUND(u2, 9) WHEN weight > 0 THEN ROUND(-LN(u2) / weight, 9) END AS b FROM d),
k AS (SELECT *, LEAST(n_units, question_count) AS n FROM e QUALIFY n_units <= question_count OR ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY a IS NULL, a, unit_no) <= question_count),
m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY unit_no) - 1 AS pos, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY b IS NULL, b, unit_no) AS by_weight, FLOOR({U.format(key="'21c|' || request_id")} * n)::BIGINT AS start FROM k),
s AS (SELECT request_id, unit_no, unit, question_count // n + (CASE WHEN known THEN by_weight <= question_count % n ELSE ((pos - start) % n + n) % n < question_count % n END)::INT AS share FROM m)
SELECT request_id, unit_no::INT AS unit_no, unit, question_type, (share // 3 + (t < share % 3)::INT)::INT AS count FROM s, (VALUES (0, 'MCQ'), (1, 'fill_in_blank'), (2, 'matching')) x(t, question_type) WHERE share // 3 + (t < share % 3)::INT > 0"""
)
def allocation_lines(spark, d):
    """Requests whose id begins with a digit up to 7 are allocated with their user's history, the others as of a new user."""
    r = _requests(spark, d)
    attempts, answers, q = (table(spark, d, t) for t in ("quiz_attempts", "attempt_answers", "questions"))
    graded = answers.join(attempts.select("attempt_id", "user_id").distinct(), "attempt_id").select("user_id", "attempt_id", "question_id", "is_correct").distinct()
    by_unit = graded.join(q.select("question_id", F.explode(F.array("chapter", "topic")).alias("unit")), "question_id")
    known = by_unit.groupBy("user_id", "unit").agg(F.sum(F.col("is_correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("total"))
    asked = r.where(F.col("request_id").rlike("^[0-7]")).select("request_id", "user_id", F.explode("units").alias("unit"))
    return A.resolved(r, asked.join(known, ["user_id", "unit"]).select("request_id", "unit", "correct", "total"))


@query(
    """WITH o AS (SELECT attempt_id, ANY_VALUE(user_id) AS owner FROM quiz_attempts GROUP BY 1),
c AS (SELECT attempt_id, owner AS caller FROM o UNION ALL SELECT attempt_id, 'somebody else' FROM o UNION ALL SELECT 'x' || attempt_id, owner FROM o)
SELECT attempt_id, caller, CASE WHEN owner IS NULL THEN 'not found' WHEN owner <> caller THEN 'forbidden' ELSE 'ok' END AS access, COUNT(*) AS calls FROM c LEFT JOIN o USING (attempt_id) GROUP BY ALL"""
)
def attempt_access(spark, d):
    """Each attempt is asked for by its user, by another one, and under an id that doesn't exist."""
    o = table(spark, d, "quiz_attempts").dropDuplicates(["attempt_id"]).select("attempt_id", F.col("user_id").alias("owner"))
    own = o.select("attempt_id", F.col("owner").alias("caller"))
    calls = own.union(o.select("attempt_id", F.lit("somebody else"))).union(own.select(F.concat(F.lit("x"), "attempt_id"), "caller"))
    return R.access(calls, o).groupBy("attempt_id", "caller", "access").agg(F.count(F.lit(1)).alias("calls"))


@query(
    """WITH q AS (SELECT question_id, class FROM questions WHERE class <> '12'), a AS (SELECT DISTINCT attempt_id, question_id, is_correct FROM attempt_answers)
SELECT attempt_id, COUNT(*) AS answers, COUNT(*) FILTER (q.question_id IS NULL) AS unknown, COALESCE(SUM(is_correct::INT) FILTER (q.question_id IS NOT NULL), 0)::BIGINT AS correct FROM a LEFT JOIN q USING (question_id) GROUP BY 1"""
)
def submission_gaps(spark, d):
    """Answers against a bank without class 12: those whose question is missing are reported, not dropped."""
    return R.submitted(table(spark, d, "attempt_answers"), table(spark, d, "questions").where("class <> '12'"))


@query("SELECT DISTINCT attempt_id, question_id, CASE WHEN is_correct THEN 'right' ELSE 'wrong' END AS shown FROM attempt_answers WHERE is_correct IS NOT NULL")
def answers_by_verdict(spark, d):
    a = table(spark, d, "attempt_answers").dropDuplicates(["attempt_id", "question_id"])
    return a.where("is_correct IS NOT NULL").select("attempt_id", "question_id", F.when(F.col("is_correct"), "right").otherwise("wrong").alias("shown"))
