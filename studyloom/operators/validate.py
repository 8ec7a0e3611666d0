"""Rules for payloads, one boolean column each, so that a report and a filter are the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import single_spaced, strip_fence
from studyloom.operators.answers import accepted, substance
from studyloom.operators.bank import distinct_items
from studyloom.schemas import PAYLOAD

SYMBOLS = r"[\^*/=()×÷]|[²³]|\w+ x \w+"


def payload_rules(questions: DataFrame) -> DataFrame:
    """question_id, type, reason: the first rule that a payload breaks, or ''."""
    p = questions.withColumn("p", F.from_json(strip_fence("payload"), PAYLOAD))
    words = F.size(F.split(F.trim("p.answer"), r"\s+"))
    same = lambda a, b: F.array_sort(a) == F.array_sort(b)
    mcq = (
        F.when(F.coalesce(F.trim("p.question"), F.lit("")) == "", "no question")
        .when(F.coalesce(F.size("p.options"), F.lit(0)) != 4, "not four options")
        .when(~F.coalesce(F.col("p.correct_option_index").between(0, 3), F.lit(False)), "index out of range")
    )
    fill = (
        F.when(F.coalesce(F.trim("p.answer"), F.lit("")) == "", "no answer")
        .when((words > 4) | F.col("p.answer").rlike(r"[.!?;]"), "not a term")
        .when(F.col("p.answer").rlike(SYMBOLS), "a formula")
        .when(F.coalesce(F.size("p.accepted_answers"), F.lit(0)) > 8, "too many aliases")
    )
    left, right = F.col("p.left_items"), F.col("p.right_items")
    matching = (
        F.when((F.coalesce(F.size(left), F.lit(0)) < 3) | (F.coalesce(F.size(right), F.lit(0)) < 3), "fewer than three")
        .when(F.size(left) != F.size(right), "sides differ")
        .when(~(distinct_items(left) & distinct_items(right)), "repeated item")
        .when(~(same(F.map_keys("p.pairs"), left) & same(F.map_values("p.pairs"), right)), "pairs don't fit")
    )
    reason = F.when(F.col("type") == "MCQ", mcq).when(F.col("type") == "fill_in_blank", fill).when(F.col("type") == "matching", matching).otherwise("type")
    return p.select("question_id", "type", F.coalesce(reason, F.lit("")).alias("reason"))


def enumerations(questions: DataFrame) -> DataFrame:
    """Rows outside the allowed values of difficulty and type."""
    return questions.where(
        ~F.coalesce(F.col("difficulty").isin("easy", "medium", "hard"), F.lit(False))
        | ~F.coalesce(F.col("type").isin("MCQ", "fill_in_blank", "matching"), F.lit(False))
    )


def alias_rules(questions: DataFrame, symbols: str) -> DataFrame:
    """question_id, reason, reviewed: the first rule that a question's own aliases break, or '', and the reviewed ones that stand for them.

    At most eight, each of 1 to 80 characters, a term of at most four words without a mark or symbol unless it names a substance."""
    p = F.from_json("payload", PAYLOAD)
    given = F.coalesce(p["accepted_answers"], F.array().cast("array<string>"))
    plain = lambda v: substance(v).isNull()
    none = F.lit(False)
    size = F.exists(given, lambda v: (F.coalesce(F.trim(v), F.lit("")) == "") | (F.length(v) > 80))
    long_ = F.exists(given, lambda v: F.coalesce(plain(v) & ((F.size(F.split(F.trim(v), r"\s+")) > 4) | v.rlike("[.!?;]")), none))
    marked = F.exists(given, lambda v: F.coalesce(plain(v) & v.rlike(symbols), none))
    reason = F.when(F.size(given) > 8, "too many aliases").when(size, "alias length").when(long_, "alias not a term").when(marked, "alias a formula").otherwise("")
    return questions.select("question_id", reason.alias("reason"), F.coalesce(F.array_join(accepted(single_spaced(p["answer"])), "|"), F.lit("")).alias("reviewed"))
