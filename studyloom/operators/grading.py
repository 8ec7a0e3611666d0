"""Grading of the three question types as expressions over payload and answer."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import single_spaced
from studyloom.operators.answers import typed_right
from studyloom.schemas import PAYLOAD

#: fixed values: what counts as a number, and the unit that may stand behind it
NUMBER = r"^-?\d+(\.\d+)?$"


def nfkc(c: Column | str) -> Column:
    """Compatibility form of a text: Spark has no function for it; ASCII texts never reach Python."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(fold(c))


def numeric(c: Column) -> Column:
    """A number without commas, spaces and unit, as text; NULL if there is none. 10 and 10.0 differ, units don't."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[,\s]", ""), "[a-zA-Z%°]+$", "")
    return F.when(bare.rlike(NUMBER), bare)


def graded(answers: DataFrame, questions: DataFrame, unicode: bool = False) -> DataFrame:
    """attempt_id, question_id, type, verdict; NULL for a question of an unknown type, which no rule grades. unicode: compare
    fill_in_blank answers in compatibility form."""
    form = (lambda c: nfkc(c)) if unicode else (lambda c: c)
    a = answers.dropDuplicates(["attempt_id", "question_id"]).select("attempt_id", "question_id", "user_answer")
    q = questions.select("question_id", "type", F.from_json("payload", PAYLOAD).alias("p"))
    j = a.join(q, "question_id")
    given = form(F.get_json_object(F.concat(F.lit('{"a":'), "user_answer", F.lit("}")), "$.a"))
    j = j.withColumn("_given", single_spaced(given)).withColumn("_key", single_spaced(form(F.col("p.answer"))))
    fill = typed_right(F.col("_key"), F.col("_given"), numeric)
    user = F.from_json("user_answer", "map<string, string>")
    matching = F.forall(F.map_entries("p.pairs"), lambda e: F.coalesce(F.try_element_at(user, e["key"]) == e["value"], F.lit(False)))
    mcq = F.expr("CASE user_answer WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE try_cast(user_answer AS INT) END").eqNullSafe(F.col("p.correct_option_index"))
    wrong = F.lit(False)
    verdict = (
        F.when(F.col("type") == "MCQ", F.coalesce(mcq, wrong))
        .when(F.col("type") == "matching", F.coalesce(matching, wrong))
        .when(F.col("type") == "fill_in_blank", F.coalesce(fill, wrong))
    )
    return j.select("attempt_id", "question_id", "type", verdict.alias("verdict"))


def pair_results(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """How many pairs of each matching answer are right."""
    a = answers.dropDuplicates(["attempt_id", "question_id"])
    q = questions.where("type = 'matching'").select("question_id", F.from_json("payload", PAYLOAD).alias("p"))
    user = F.from_json("user_answer", "map<string, string>")
    right = F.filter(F.map_entries("p.pairs"), lambda e: F.coalesce(F.try_element_at(user, e["key"]) == e["value"], F.lit(False)))
    return a.join(q, "question_id").select("attempt_id", "question_id", F.size(right).alias("right"), F.size("p.pairs").alias("pairs"))
