"""The pN_ queries. Each runs over its whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from studyloom.session import ship, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.similar_vectors import similar_pairs

    return similar_pairs(table(spark, sf_dir, "questions"))


def p1_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour lists themselves, with similarity and rank."""
    from studyloom.llm.similar_vectors import similar_vectors

    return similar_vectors(table(spark, sf_dir, "questions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.near_copies import near_pairs

    return near_pairs(table(spark, sf_dir, "questions"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.near_copies import near_links

    return near_links(table(spark, sf_dir, "questions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.pivot_history import turned_away

    return turned_away(table(spark, sf_dir, "questions"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.pair_defects import pair_defects

    return pair_defects(table(spark, sf_dir, "reference_corpus"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.copy_runs import copies

    return copies(table(spark, sf_dir, "questions"))


def p7_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.copy_runs import representatives

    return representatives(table(spark, sf_dir, "questions"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.text_pieces import oversized

    return oversized(table(spark, sf_dir, "chunk"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.text_pieces import renumbered

    return renumbered(table(spark, sf_dir, "chunk"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.scan_repair import found_noise

    return found_noise(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "source_repairs"))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.scan_repair import repaired_chunks

    found = repaired_chunks(table(spark, sf_dir, "chunk"), table(spark, sf_dir, "source_repairs"))
    return found.where("size(kinds) > 0")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.corpus_tokens import corpus_ids

    return corpus_ids(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_exact_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the largest mix in which the scarcest source still reaches its target."""
    from studyloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), exact=True)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.cut_texts import cut_documents

    return cut_documents(table(spark, sf_dir, "documents"))


def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.cut_texts import limits, measured

    return limits(measured(table(spark, sf_dir, "documents")))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from studyloom.llm.cut_texts import cut_shares

    return cut_shares(table(spark, sf_dir, "documents"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from studyloom.llm.sql import SQL

    return dict(SQL)
