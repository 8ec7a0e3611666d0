"""Reading the question bank: filters, lookup with exclusion of seen questions and one question for each concept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import order_key
from studyloom.schemas import PAYLOAD

LOOKUP = ("class", "subject", "difficulty", "question_type")
SCOPE = ("class", "subject", "chapter", "topic", "difficulty", "question_type")


def parsed(questions: DataFrame) -> DataFrame:
    return questions.withColumn("p", F.from_json("payload", PAYLOAD))


def distinct_items(a: Column) -> Column:
    """Whether a list has no repeats; NULL for no list. NULL items don't count as values."""
    return F.size(a) == F.size(F.array_distinct(F.filter(a, lambda x: x.isNotNull())))


def wellformed_matching(questions: DataFrame) -> DataFrame:
    """All but matching questions with a repeated or missing item list."""
    p = parsed(questions)
    keep = (F.col("type") != "matching") | (distinct_items(F.col("p.left_items")) & distinct_items(F.col("p.right_items")))
    return p.where(keep).drop("p")


def public_payload(questions: DataFrame) -> DataFrame:
    """What may be shown before an answer: options, or both item lists; nothing of fill_in_blank."""
    p = parsed(questions)
    shown = (
        F.when(F.col("type") == "MCQ", F.array_join("p.options", "|", ""))
        .when(F.col("type") == "matching", F.concat_ws("||", F.array_join("p.left_items", "|", ""), F.array_join("p.right_items", "|", "")))
        .when(F.col("type") == "fill_in_blank", F.lit(""))
    )
    return p.select("question_id", "type", shown.alias("shown"))


def correct_text(questions: DataFrame) -> DataFrame:
    """The right answer as text; pairs in the order of the payload."""
    p = parsed(questions)
    pairs = F.transform(F.map_entries("p.pairs"), lambda e: F.concat(e["key"], F.lit(" -> "), e["value"]))
    text = (
        F.when(F.col("type") == "MCQ", F.try_element_at("p.options", F.col("p.correct_option_index") + 1))
        .when(F.col("type") == "matching", F.array_join(pairs, "; "))
        .otherwise(F.col("p.answer"))
    )
    return p.select("question_id", "type", text.alias("correct_text"))


def seen_pairs(answers: DataFrame, attempts: DataFrame) -> DataFrame:
    return (
        answers.select("attempt_id", "question_id")
        .join(attempts.dropDuplicates(["attempt_id"]).select("attempt_id", "user_id"), "attempt_id")
        .select("user_id", "question_id")
        .distinct()
    )


def lookup(
    requests: DataFrame, questions: DataFrame, seen: DataFrame, count: int = 5, seed: str = "7", keys: tuple[str, ...] | None = None, excluded: DataFrame | None = None
) -> DataFrame:
    """For each request (user and scope) at most `count` questions the user hasn't seen, one of each concept, in seeded order.
    keys: the scope, by default those of SCOPE that requests have. excluded: user_id, cluster of concepts that a user is not to get.

    The order is the scope's, not the user's, so each scope is ranked once; a request only reads the first count + (what its user has
    seen there) concepts of its scope, never the whole of it. A concept whose representative is seen gives way to its next question."""
    keys = keys or tuple(k for k in SCOPE if k in requests.columns)
    cluster = F.coalesce("concept_cluster_id", "question_id").alias("cluster")
    q = questions.withColumn("question_type", F.col("type")).select("question_id", *keys, cluster, order_key(seed, F.col("question_id")).alias("k"))
    gone = seen.join(q.select("question_id", *keys), "question_id").select("user_id", *keys)
    if excluded is not None:
        gone = gone.unionByName(excluded.join(q.select("cluster", *keys).distinct(), "cluster").select("user_id", *keys))
    hits = gone.groupBy("user_id", *keys).agg(F.count(F.lit(1)).alias("had"))
    in_cluster = Window.partitionBy(*keys, "cluster").orderBy("k")
    ranked = q.withColumn("in_cluster", F.row_number().over(in_cluster)).withColumn("lead", F.min("k").over(Window.partitionBy(*keys, "cluster")))
    by_lead = Window.partitionBy(*keys).orderBy("lead")
    ranked = ranked.withColumn("concept", F.dense_rank().over(by_lead))
    wanted = requests.select("user_id", *keys).distinct().join(hits, ["user_id", *keys], "left").fillna(0, ["had"])
    near = wanted.join(ranked, list(keys)).where((F.col("concept") <= count + F.col("had")) & (F.col("in_cluster") <= 1 + F.col("had")))
    fresh = near.join(seen, ["user_id", "question_id"], "left_anti")
    if excluded is not None:
        fresh = fresh.join(excluded, ["user_id", "cluster"], "left_anti")
    one = Window.partitionBy("user_id", *keys, "cluster").orderBy("k")
    first = Window.partitionBy("user_id", *keys).orderBy("concept")
    return (
        fresh.withColumn("r", F.row_number().over(one))
        .where("r = 1")
        .withColumn("pos", F.row_number().over(first))
        .where(F.col("pos") <= count)
        .select("user_id", *keys, "question_id", "pos")
    )


def shortfall(requests: DataFrame, found: DataFrame, count: int = 5, keys: tuple[str, ...] | None = None) -> DataFrame:
    """What each request still lacks, and what follows: full, partial (some found), or empty."""
    keys = keys or tuple(k for k in SCOPE if k in requests.columns)
    n = found.groupBy("user_id", *keys).agg(F.count(F.lit(1)).alias("found"))
    outcome = F.when(F.col("found") == count, "full").when(F.col("found") > 0, "partial").otherwise("empty")
    return (
        requests.select("user_id", *keys).distinct().join(n, ["user_id", *keys], "left").fillna(0, ["found"])
        .withColumn("shortfall", F.lit(count) - F.col("found")).withColumn("outcome", outcome)
    )


def insert_absent(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of `new` whose key `old` doesn't have, each once."""
    return new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))


def explanation_cache(questions: DataFrame) -> DataFrame:
    """Which questions have an explanation stored, and which are to be made."""
    stored = F.when(F.trim("explanation") != "", F.col("explanation"))
    return questions.select(
        "question_id", F.coalesce(stored, F.lit("")).alias("explanation"), stored.isNull().alias("pending")
    )


def style_pick(questions: DataFrame, corpus: DataFrame, seed: str = "3") -> DataFrame:
    """A reference entry for each question's chapter: one of its topic if there is any, else one of the chapter, in seeded order.

    Entries are reduced to one for each topic and one for each chapter before the join, so the join adds no rows."""
    k = order_key(seed, F.col("id"))
    entries = corpus.where("answer IS NOT NULL AND trim(answer) <> ''").dropDuplicates(["id"])
    by_topic = entries.where("topic IS NOT NULL").groupBy("class", "subject", "chapter", "topic").agg(F.min_by("id", k).alias("topic_pick"))
    by_chapter = entries.groupBy("class", "subject", "chapter").agg(F.min_by("id", k).alias("chapter_pick"))
    return (
        questions.select("question_id", "class", "subject", "chapter", "topic")
        .join(by_topic, ["class", "subject", "chapter", "topic"], "left")
        .join(by_chapter, ["class", "subject", "chapter"], "left")
        .select("question_id", F.coalesce("topic_pick", "chapter_pick").alias("reference_id"), F.col("topic_pick").isNotNull().alias("same_topic"))
    )
