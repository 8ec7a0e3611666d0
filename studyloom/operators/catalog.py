"""Subjects, chapters and topics as chunks and questions name them; names are identity, numbers only order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import natural_key
from studyloom.schemas import SCOPE

SCOPE_KEYS = ("class", "subject", "chapter")


def topics(chunks: DataFrame) -> DataFrame:
    """Each topic of a chapter once, with its first printed number and its place in natural order (numbered ones first)."""
    number = F.when(F.col("topic_number") != "", F.col("topic_number"))
    first = F.min_by("number", F.struct("source_file", "chunk_index", "chunk_id")).alias("number")
    found = (
        chunks.where("topic IS NOT NULL")
        .select(*SCOPE_KEYS, "topic", number.alias("number"), "source_file", "chunk_index", "chunk_id")
        .groupBy(*SCOPE_KEYS, "topic")
        .agg(first)
    )
    by = Window.partitionBy(*SCOPE_KEYS).orderBy(F.col("number").isNull(), natural_key("number"), "topic")
    return found.withColumn("place", F.row_number().over(by))


def counts(chunks: DataFrame) -> DataFrame:
    """Topics of each chapter."""
    return chunks.groupBy(*SCOPE_KEYS).agg(F.countDistinct("topic").alias("topics"), F.countDistinct("chunk_id").alias("chunks"))


def count_options(sizes: DataFrame, column: str = "topics", most: int = 25) -> DataFrame:
    """Numbers of questions (5, 10, ... 25) that can cover so many units: more than there are, or any from 25 units on."""
    all_ = F.sequence(F.lit(5), F.lit(most), F.lit(5))
    fit = F.filter(all_, lambda c: (F.col(column) >= most) | (c > F.col(column)))
    return sizes.withColumn("options", F.array_join(F.transform(fit, lambda c: c.cast("string")), ","))


def requested_units(attempts: DataFrame) -> DataFrame:
    """One row for each chapter or topic that an attempt's scope names."""
    parsed = attempts.dropDuplicates(["attempt_id"]).withColumn("s", F.from_json("scope", SCOPE))
    return parsed.select("attempt_id", "class", "subject", "s.scope_type", F.explode("s.sub_units").alias("unit"))


def resolved_units(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """The chapter and topic pairs that each attempt names: a topic in every chapter that has it, a chapter with all its topics."""
    have = questions.select("class", "subject", "chapter", "topic").distinct()
    units = have.withColumn("unit", F.explode(F.array_distinct(F.array("chapter", "topic"))))
    a = attempts.dropDuplicates(["attempt_id"]).select("attempt_id", "user_id", "difficulty")
    return requested_units(attempts).join(units, ["class", "subject", "unit"]).join(a, "attempt_id").drop("unit", "scope_type").distinct()


def violations(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Requested units that the bank doesn't have in that class and subject."""
    have = (
        questions.select("class", F.lower(F.trim("subject")).alias("subject"), F.explode(F.array("chapter", "topic")).alias("unit"))
        .distinct()
    )
    asked = requested_units(attempts).withColumn("subject", F.lower(F.trim("subject")))
    return asked.join(have, ["class", "subject", "unit"], "left_anti")


def two_sided(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one of two frames has: missing (only in a) or extra (only in b)."""
    left = a.select(*keys).distinct().withColumn("a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("b", F.lit(True))
    return (
        left.join(right, list(keys), "full")
        .where("a IS NULL OR b IS NULL")
        .select(*keys, F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("side"))
    )


def scope_reasons(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """attempt_id, unit, reason: why a named unit is none of its class and subject, or ''; units of a topic scope are topics, others chapters."""
    keys = ["class", "subject"]
    have = questions.select(*keys).distinct().withColumn("any", F.lit(True))
    part = lambda c, name: questions.select(*keys, F.col(c).alias("unit")).distinct().withColumn(name, F.lit(True))
    asked = requested_units(attempts).distinct()
    j = asked.join(have, keys, "left").join(part("chapter", "is_chapter"), [*keys, "unit"], "left").join(part("topic", "is_topic"), [*keys, "unit"], "left")
    reason = (
        F.when(F.col("any").isNull(), "no chapters")
        .when((F.col("scope_type") != "topic") & F.col("is_chapter").isNull(), "unknown chapter")
        .when((F.col("scope_type") == "topic") & F.col("is_topic").isNull(), "unknown topic")
        .otherwise("")
    )
    return j.select("attempt_id", "unit", reason.alias("reason"))
