"""Queries over attempts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyloom.operators import performance as P
from studyloom.plans.registry import query
from studyloom.session import table

GRADED = """WITH a AS (SELECT DISTINCT attempt_id, question_id, is_correct FROM attempt_answers),
t AS (SELECT DISTINCT attempt_id, user_id, created_at FROM quiz_attempts),
g AS (SELECT a.attempt_id, a.question_id, a.is_correct, t.user_id, q.class, q.subject, q.chapter, q.topic, q.type AS question_type
      FROM a JOIN t USING (attempt_id) JOIN questions q USING (question_id)),
c AS (SELECT user_id, class, subject, chapter, topic, question_type, CAST(SUM(is_correct::INT) AS BIGINT) AS correct_count, COUNT(*) AS total_count
      FROM g GROUP BY ALL)
"""
ACC = "ROUND(CAST(SUM(correct_count) AS DOUBLE) / NULLIF(SUM(total_count), 0), 6) AS accuracy"
SUMS = "CAST(SUM(correct_count) AS BIGINT) AS correct, CAST(SUM(total_count) AS BIGINT) AS total"


def _graded(spark, d):
    return P.graded(table(spark, d, "attempt_answers"), table(spark, d, "quiz_attempts"), table(spark, d, "questions"))


def _counters(spark, d):
    return P.counters(_graded(spark, d))


@query(GRADED + "SELECT * FROM c")
def counters_build(spark, d):
    return _counters(spark, d)


@query(GRADED + f"SELECT {SUMS}, {ACC} FROM c")
def dash_overall(spark, d):
    return P.bucket(_counters(spark, d))


@query(GRADED + f"SELECT subject, {SUMS}, {ACC} FROM c GROUP BY subject")
def dash_by_subject(spark, d):
    return P.bucket(_counters(spark, d), "subject")


@query(GRADED + f"SELECT subject || ' / ' || chapter AS label, {SUMS}, {ACC} FROM c GROUP BY 1")
def dash_by_chapter(spark, d):
    c = _counters(spark, d).withColumn("label", F.concat_ws(" / ", "subject", "chapter"))
    return P.bucket(c, "label")


@query(GRADED + f"SELECT question_type, {SUMS}, {ACC} FROM c GROUP BY question_type")
def dash_by_type(spark, d):
    return P.bucket(_counters(spark, d), "question_type")


@query(
    GRADED
    + f"""SELECT subject, chapter, question_type, CAST(GROUPING_ID(subject, chapter, question_type) AS INT) AS level, {SUMS}, {ACC}
FROM c GROUP BY GROUPING SETS ((), (subject), (subject, chapter), (question_type))"""
)
def dash_grouping_sets(spark, d):
    return P.grouping_sets(_counters(spark, d))


@query(
    """SELECT user_id, difficulty, CAST(SUM(score_correct) AS BIGINT) AS correct, CAST(SUM(score_total) AS BIGINT) AS total,
ROUND(CAST(SUM(score_correct) AS DOUBLE) / NULLIF(SUM(score_total), 0), 6) AS accuracy FROM (SELECT DISTINCT * FROM quiz_attempts) GROUP BY ALL"""
)
def dash_by_difficulty(spark, d):
    return P.by_difficulty(table(spark, d, "quiz_attempts"))


LATEST = """WITH t AS (SELECT DISTINCT * FROM quiz_attempts),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at DESC, attempt_id) AS rank FROM t)
"""


@query(
    LATEST
    + """SELECT user_id, STRFTIME(DATE_TRUNC('week', created_at), '%Y-%m-%d') AS week_start, CAST(SUM(score_correct) AS BIGINT) AS correct,
CAST(SUM(score_total) AS BIGINT) AS total, COUNT(*) AS attempts FROM r WHERE rank <= 200 GROUP BY 1, 2"""
)
def dash_weekly(spark, d):
    return P.weekly(table(spark, d, "quiz_attempts"))


@query(LATEST + "SELECT user_id, attempt_id, score_correct, score_total, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def recent_attempts(spark, d):
    return P.latest(table(spark, d, "quiz_attempts"), 20).select("user_id", "attempt_id", "score_correct", "score_total", "rank")


@query(
    GRADED
    + f""", b AS (SELECT user_id, subject, chapter, {SUMS}, {ACC} FROM c GROUP BY ALL HAVING SUM(total_count) >= 3)
SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY accuracy, subject, chapter) AS r FROM b) WHERE r = 1"""
)
def weakest_chapter(spark, d):
    return P.weakest_chapter(_counters(spark, d))


@query(
    GRADED
    + f""", b AS (SELECT user_id, subject, {SUMS}, {ACC} FROM c GROUP BY ALL)
SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY COALESCE(accuracy, 0) DESC, subject) AS r FROM b) WHERE r = 1"""
)
def best_subject(spark, d):
    return P.best_subject(_counters(spark, d))


@query(
    GRADED
    + """, b AS (SELECT user_id, class, subject, chapter, topic, CAST(SUM(correct_count) AS BIGINT) AS correct, CAST(SUM(total_count) AS BIGINT) AS total
FROM c GROUP BY ALL), x AS (SELECT *, CASE WHEN total >= 3 THEN correct::DOUBLE / total END AS acc FROM b)
SELECT * EXCLUDE (acc), ROUND(acc, 6) AS accuracy, ROUND(COALESCE(GREATEST(0.0, 1 - acc), 0.5), 6) AS weight FROM x"""
)
def accuracy_weight(spark, d):
    return P.accuracy_weight(_counters(spark, d))


@query(
    GRADED
    + f""", b AS (SELECT user_id, subject, {SUMS}, {ACC} FROM c GROUP BY ALL)
SELECT *, CASE WHEN accuracy IS NULL THEN 'none' WHEN accuracy >= 0.7 THEN 'good' WHEN accuracy >= 0.5 THEN 'fair' ELSE 'weak' END AS band,
total < 3 AS low_sample FROM b"""
)
def accuracy_bands(spark, d):
    return P.bands(P.bucket(_counters(spark, d), "user_id", "subject"))


@query(
    """WITH t AS (SELECT DISTINCT * FROM quiz_attempts)
SELECT attempt_id, user_id, created_at, COUNT(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS used FROM t"""
)
def rolling_use(spark, d):
    return P.rolling_use(table(spark, d, "quiz_attempts"))


@query(
    GRADED
    + """, early AS (SELECT user_id, class, subject, chapter, topic, question_type, SUM(is_correct::INT) AS k, COUNT(*) AS n FROM g JOIN t USING (attempt_id, user_id)
WHERE created_at < TIMESTAMP '2025-06-01' GROUP BY ALL),
late AS (SELECT user_id, class, subject, chapter, topic, question_type, SUM(is_correct::INT) AS k, COUNT(*) AS n FROM g JOIN t USING (attempt_id, user_id)
WHERE created_at >= TIMESTAMP '2025-06-01' GROUP BY ALL)
SELECT user_id, class, subject, chapter, topic, question_type, CAST(SUM(k) AS BIGINT) AS correct_count, CAST(SUM(n) AS BIGINT) AS total_count
FROM (SELECT * FROM early UNION ALL SELECT * FROM late) GROUP BY ALL"""
)
def counters_upsert(spark, d):
    g = _graded(spark, d)
    day = F.lit("2025-06-01").cast("timestamp")
    return P.merged(P.counters(g.where(F.col("created_at") < day)), P.counters(g.where(F.col("created_at") >= day)))


@query(
    """WITH a AS (SELECT DISTINCT attempt_id, question_id, is_correct FROM attempt_answers)
SELECT attempt_id, CAST(SUM(is_correct::INT) AS BIGINT) AS correct, COUNT(*) AS total FROM a GROUP BY 1"""
)
def attempt_scores(spark, d):
    return table(spark, d, "attempt_answers").dropDuplicates(["attempt_id", "question_id"]).groupBy("attempt_id").agg(*P.counts())
