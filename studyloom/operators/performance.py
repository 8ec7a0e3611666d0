"""Counters and accuracy views: one join of answers with attempts and questions, then partial and final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.schemas import COUNTER_KEY


def ratio(a: Column | str, b: Column | str) -> Column:
    """NULL where nothing was counted; six decimals."""
    return F.round(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b), 6)


def counts() -> list[Column]:
    return [F.sum(F.col("is_correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("total")]


def graded(answers: DataFrame, attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Each answer once, with its attempt's and question's keys. Rows that were sent twice are dropped before the joins; only the key
    columns of questions move (no text, no vector), so the join with a question that holds a tenth of the answers is left to AQE."""
    a = answers.dropDuplicates(["attempt_id", "question_id"])
    t = attempts.dropDuplicates(["attempt_id"]).select("attempt_id", "user_id", "created_at", F.col("difficulty").alias("attempt_difficulty"))
    q = questions.select("question_id", "class", "subject", "chapter", "topic", F.col("type").alias("question_type"), "difficulty")
    return a.join(t, "attempt_id").join(q, "question_id")


def counters(g: DataFrame) -> DataFrame:
    """user, scope and type -> correct_count, total_count."""
    return g.groupBy(*COUNTER_KEY).agg(
        F.sum(F.col("is_correct").cast("int")).alias("correct_count"), F.count(F.lit(1)).alias("total_count")
    )


def merged(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Additive upsert of counters."""
    return (
        old.unionByName(delta)
        .groupBy(*COUNTER_KEY)
        .agg(F.sum("correct_count").alias("correct_count"), F.sum("total_count").alias("total_count"))
    )


def bucket(c: DataFrame, *keys: str) -> DataFrame:
    """Accuracy by keys; without keys over all, one row even when there is nothing."""
    out = c.groupBy(*keys).agg(
        F.coalesce(F.sum("correct_count"), F.lit(0)).alias("correct"), F.coalesce(F.sum("total_count"), F.lit(0)).alias("total")
    )
    return out.withColumn("accuracy", ratio("correct", "total"))


def grouping_sets(c: DataFrame) -> DataFrame:
    """Overall, by subject, by chapter and by type in one pass."""
    name = "studyloom_counters_view"
    c.createOrReplaceTempView(name)
    return c.sparkSession.sql(
        f"""SELECT subject, chapter, question_type, CAST(grouping_id(subject, chapter, question_type) AS INT) AS level,
            SUM(correct_count) AS correct, SUM(total_count) AS total
            FROM {name} GROUP BY GROUPING SETS ((), (subject), (subject, chapter), (question_type))"""
    ).withColumn("accuracy", ratio("correct", "total"))


def latest(attempts: DataFrame, limit: int = 200) -> DataFrame:
    """Each user's latest attempts with their rank."""
    by = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "attempt_id")
    return attempts.dropDuplicates(["attempt_id"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def weekly(attempts: DataFrame, limit: int = 200) -> DataFrame:
    """Weeks from Monday over each user's latest attempts."""
    return (
        latest(attempts, limit)
        .groupBy("user_id", F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd").alias("week_start"))
        .agg(F.sum("score_correct").alias("correct"), F.sum("score_total").alias("total"), F.count(F.lit(1)).alias("attempts"))
    )


def by_difficulty(attempts: DataFrame) -> DataFrame:
    return (
        attempts.dropDuplicates(["attempt_id"])
        .groupBy("user_id", "difficulty")
        .agg(F.sum("score_correct").alias("correct"), F.sum("score_total").alias("total"))
        .withColumn("accuracy", ratio("correct", "total"))
    )


def weakest_chapter(c: DataFrame, least: int = 3) -> DataFrame:
    """Each user's chapter of lowest accuracy among those with enough answers."""
    b = bucket(c, "user_id", "subject", "chapter").where(F.col("total") >= least)
    by = Window.partitionBy("user_id").orderBy("accuracy", "subject", "chapter")
    return b.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def best_subject(c: DataFrame) -> DataFrame:
    """Each user's subject of highest accuracy, no answers counting as 0."""
    b = bucket(c, "user_id", "subject")
    by = Window.partitionBy("user_id").orderBy(F.desc(F.coalesce("accuracy", F.lit(0.0))), "subject")
    return b.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def accuracy_weight(c: DataFrame, least: int = 3) -> DataFrame:
    """Weight of each topic for a user: the share of wrong answers, one half below `least` answers."""
    b = c.groupBy("user_id", "class", "subject", "chapter", "topic").agg(
        F.sum("correct_count").alias("correct"), F.sum("total_count").alias("total")
    )
    acc = F.when(F.col("total") >= least, F.try_divide("correct", "total"))
    return b.withColumn("accuracy", F.round(acc, 6)).withColumn(
        "weight", F.round(F.coalesce(F.greatest(F.lit(0.0), 1 - acc), F.lit(0.5)), 6)
    )


def bands(b: DataFrame) -> DataFrame:
    return b.withColumn(
        "band",
        F.when(F.col("accuracy").isNull(), "none").when(F.col("accuracy") >= 0.7, "good").when(F.col("accuracy") >= 0.5, "fair").otherwise("weak"),
    ).withColumn("low_sample", F.col("total") < 3)


def rolling_use(attempts: DataFrame) -> DataFrame:
    """Attempts of a user in the 24 hours up to and with each attempt."""
    used = F.expr(
        "count(1) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)"
    )
    return attempts.dropDuplicates(["attempt_id"]).select("attempt_id", "user_id", "created_at", used.alias("used"))


def progress_card(attempts: DataFrame) -> DataFrame:
    """user_id, overall, hard, week: per cent right of all answers, of hard quizzes, and of the user's last week with any; halves go up, 0 for none."""
    a = attempts.dropDuplicates(["attempt_id"]).withColumn("w", F.date_trunc("week", "created_at"))
    last = a.groupBy("user_id").agg(F.max("w").alias("last"))

    def percent(cond: Column) -> Column:
        right, all_ = (F.sum(F.when(cond, F.col(c))) for c in ("score_correct", "score_total"))
        return F.coalesce(F.floor(F.lit(100.0) * right / F.nullif(all_, F.lit(0)) + 0.5), F.lit(0)).cast("int")

    return a.join(last, "user_id").groupBy("user_id").agg(
        percent(F.lit(True)).alias("overall"), percent(F.col("difficulty") == "hard").alias("hard"), percent(F.col("w") == F.col("last")).alias("week")
    )
