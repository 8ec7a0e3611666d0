"""Spreading a number of items over units: equal shares with remainders, and weighted samples without replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import uniform


def equal_shares(units: DataFrame, key: str, order: str, count: int, start: int = 0) -> DataFrame:
    """count spread over the units of each key: the quotient each, the remainder from place `start` on in turn."""
    w = Window.partitionBy(key)
    pos = F.row_number().over(w.orderBy(order)) - 1
    n = F.count(F.lit(1)).over(w)
    placed = units.withColumn("pos", pos).withColumn("n", n)
    extra = (F.pmod(F.col("pos") - start, F.col("n")) < F.lit(count) % F.col("n")).cast("int")
    return placed.withColumn("share", (F.floor(F.lit(count) / F.col("n")) + extra).cast("int")).drop("n")


def weighted_sample(units: DataFrame, key: str, unit: str, weight: str, k: int, seed: str = "11") -> DataFrame:
    """At most k units of each key, drawn without replacement with the given weights: the k smallest -ln(u)/w."""
    u = uniform(F.lit(seed), F.col(key), F.col(unit))
    draw = F.when(F.col(weight) > 0, -F.ln(F.greatest(u, F.lit(1e-300))) / F.col(weight))
    by = Window.partitionBy(key).orderBy(F.col("draw").isNull(), "draw", unit)
    return units.withColumn("draw", F.round(draw, 9)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


COUNTS = (5, 10, 15, 20, 25)


def request_faults(requests: DataFrame) -> DataFrame:
    """requests (request_id, scope_type, question_count, units, types) with `fault`: why a request can't be allocated, or ''.

    A scope of all topics or all chapters must be covered: more questions than units, unless there are as many units as the largest count."""
    n = F.size(F.coalesce("units", F.array().cast("array<string>")))
    whole = F.col("scope_type").isin("all_topics_in_chapter", "all_chapters_in_subject")
    fault = (
        F.when(~F.coalesce(F.col("question_count").isin(*COUNTS), F.lit(False)), "question count")
        .when(n == 0, "no units")
        .when(F.size(F.coalesce("types", F.array().cast("array<string>"))) == 0, "no types")
        .when(whole & (n < max(COUNTS)) & (F.col("question_count") <= n), "coverage")
        .otherwise("")
    )
    return requests.withColumn("fault", fault)


def resolved(requests: DataFrame, history: DataFrame, least: int = 3, seed: str = "21") -> DataFrame:
    """request_id, unit_no, unit, question_type, count: each valid request's questions spread over its units and types; they add up to its count.

    history: request_id, unit, correct, total. With more units than questions only so many units are kept: of a request without any history in
    seeded order, else drawn without replacement with weight 1 - accuracy (0.5 below `least` answers). Each kept unit gets the quotient; the
    remainder goes round from a seeded place, or is drawn by the same weights. Types share a unit's questions evenly, first types first. Units
    of one name are units of their own, by their number. Every step ranks the units of one request."""
    valid = request_faults(requests).where("fault = ''")
    units = valid.select("request_id", "question_count", F.posexplode("units").alias("unit_no", "unit"), F.size("units").alias("n_units"))
    past = history.groupBy("request_id", "unit").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    some = history.select("request_id").distinct().withColumn("known", F.lit(True))
    accuracy = F.when(F.col("total") >= least, F.col("correct") / F.col("total"))
    weighed = (
        units.join(past, ["request_id", "unit"], "left")
        .join(some, "request_id", "left")
        .withColumn("weight", F.round(F.coalesce(F.greatest(F.lit(0.0), 1 - accuracy), F.lit(0.5)), 6))
        .withColumn("known", F.coalesce("known", F.lit(False)))
    )

    def draw(salt: str):
        u = F.greatest(uniform(F.lit(seed + salt), F.col("request_id"), F.col("unit_no").cast("string")), F.lit(1e-300))
        weighted = F.when(F.col("weight") > 0, F.round(-F.ln(u) / F.col("weight"), 9))
        return F.when(F.col("known"), weighted).otherwise(F.round(u, 9))

    w = Window.partitionBy("request_id")
    kept = (
        weighed.withColumn("a", draw("a"))
        .withColumn("place", F.row_number().over(w.orderBy(F.col("a").isNull(), "a", "unit_no")))
        .where((F.col("n_units") <= F.col("question_count")) | (F.col("place") <= F.col("question_count")))
        .withColumn("n", F.least("n_units", "question_count"))
        .withColumn("b", draw("b"))
    )
    start = F.floor(uniform(F.lit(f"{seed}c"), F.col("request_id")) * F.col("n"))
    kept = kept.withColumn("pos", F.row_number().over(w.orderBy("unit_no")) - 1).withColumn("by_weight", F.row_number().over(w.orderBy(F.col("b").isNull(), "b", "unit_no")))
    over = F.col("question_count") % F.col("n")
    more = F.when(F.col("known"), F.col("by_weight") <= over).otherwise(F.pmod(F.col("pos") - start, F.col("n")) < over)
    shares = kept.select("request_id", "unit_no", "unit", (F.floor(F.col("question_count") / F.col("n")) + more.cast("int")).alias("share"))
    typed = shares.join(valid.select("request_id", F.size("types").alias("k"), F.posexplode("types").alias("t", "question_type")), "request_id")
    count = (F.floor(F.col("share") / F.col("k")) + (F.col("t") < F.col("share") % F.col("k")).cast("int")).cast("int")
    return typed.select("request_id", "unit_no", "unit", "question_type", count.alias("count")).where("count > 0")
