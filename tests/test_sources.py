"""Book folders, resumable runs, progress logs, drop caps, shown names."""

import pytest
from pyspark.sql import functions as F

from studyloom.operators import layout, names, retrieval
from studyloom.sources import tables as S


def test_books_in_order(spark, tmp_path):
    for c, subject, name in (("9", "maths", "chapter 10"), ("9", "maths", "chapter 2"), ("9", "social science", "chapter 1"), ("10", "physics", "chapter 1")):
        p = tmp_path / f"class {c}" / subject
        p.mkdir(parents=True, exist_ok=True)
        (p / f"{name}.pdf").write_bytes(b"x")
    names_ = {"maths": "Maths", "social science": "Social Science"}
    got = [(r["class"], r.subject, r.source_file) for r in S.books(spark, str(tmp_path), subjects=names_).drop("content").collect()]
    assert got == [("10", "Physics", "chapter 1"), ("9", "Maths", "chapter 2"), ("9", "Maths", "chapter 10"), ("9", "Social Science", "chapter 1")]
    assert S.books(spark, str(tmp_path), subjects=names_, only_class="9", only_subject="MATHS").count() == 2


def test_resumable_runs_skip_what_is_done(spark, tmp_path):
    log = str(tmp_path / "log")
    items = spark.createDataFrame([(f"k{n}", n) for n in range(6)], "k string, n int")

    def work(row):
        if row["n"] == 3:
            raise ValueError("bad\tone")
        return {"twice": 2 * row["n"]}

    first = {r.k: (r.status, r.result and r.result.twice, r.error) for r in S.resumable(items, work, "twice int", "k", log, start=1).collect()}
    assert first["k0"][0] == "skipped" and first["k3"] == ("failed", None, "ValueError: bad\tone") and first["k4"] == ("ok", 8, None)
    logged = {(r.status, r.key) for r in S.progress(spark, log).collect()}
    assert logged == {("DONE", k) for k in ("k1", "k2", "k4", "k5")} | {("FAILED", "k3")}
    again = S.resumable(items, lambda row: {"twice": 1}, "twice int", "k", log)
    assert {r.status: r["items"] for r in S.report(again).collect()} == {"skipped": 4, "ok": 2}
    late = S.resumable(items, work, "twice int", "k", str(tmp_path / "other"), budget_s=-1)
    assert {r.status for r in late.collect()} == {"later"} and S.progress(spark, str(tmp_path / "other")).count() == 0


def test_drafts_are_never_overwritten(spark, tmp_path):
    df = spark.range(2)
    S.write_once(df, str(tmp_path / "d"))
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_once(df, str(tmp_path / "d"))


def test_topic_numbers_stand_in_for_topics(spark):
    df = spark.createDataFrame([("a", "", None, None, "3.1"), ("b", "x", "s", "T", "3.2")], "id string, answer string, source string, topic string, topic_number string")
    assert {(r.id, r.answer, r.source, r.topic) for r in S.refreshed(df).collect()} == {("a", None, "ncert_intext", "3.1"), ("b", "x", "s", "T")}


def test_drop_caps_go_to_their_row(spark):
    rows = [("d", 0, 0, 0, "O  L", 20.0, 0.0), ("d", 0, 0, 1, "HM’S AW", 12.0, 5.0), ("d", 0, 0, 2, "body text", 10.0, 40.0), ("d", 0, 1, 0, "TITLE", 20.0, 0.0), ("d", 0, 1, 1, "far below", 10.0, 60.0)]
    df = spark.createDataFrame(rows, "doc string, page int, block int, line_no int, text string, size double, y0 double")
    got = {(r.block, r.line_no): r.text for r in layout.with_drop_caps(df).collect()}
    assert got == {(0, 1): "O  LHM’S AW", (0, 2): "body text", (1, 0): "TITLE", (1, 1): "far below"}


def test_bold_spans(spark):
    df = spark.createDataFrame([(16, "x"), (0, "Times-Bold"), (4, "Times"), (None, None)], "flags int, font string")
    assert [r.bold for r in layout.styled(df).collect()] == [True, True, False, False]


@pytest.mark.parametrize(
    "name, shown",
    [("  LAWS   OF MOTION ", "Laws of Motion"), ("THE DNA AND RNA OF CELLS", "The DNA and RNA of Cells"), ("OHM’S LAW", "Ohm’s Law"), ("BIOT-SAVART LAW", "Biot-Savart Law"), ("Laws of motion ?", "Laws of motion?"),
     ("M O T I O N", "Motion"), ("A B cat", "A B cat"), ("KÖSSEL THEORY", "Kössel Theory"), ("1.2 OF MICE", "1.2 Of Mice"), ("Introduction", "Introduction"), ("", ""), (None, None)],
)
def test_shown_names(spark, name, shown):
    assert spark.createDataFrame([(name,)], "n string").select(names.display_name(F.col("n")).alias("s")).first().s == shown


def test_validation_and_top_up():
    tries = iter([1, 2, 3, 4])
    assert retrieval.validated(lambda: next(tries), lambda x: x == 3) == 3
    assert retrieval.validated(lambda: 0, lambda x: False) is None
    rounds = iter([[1, None], [2], [3, 4]])
    assert retrieval.topped_up(lambda n: next(rounds), 3) == [1, 2, 3]
