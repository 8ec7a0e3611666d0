"""Heading detectors on small synthetic documents."""

from studyloom.operators import detectors as D

KINDS = "doc string, page int, line_no int, block int, text string, size double"


def doc(spark, rows, name="d"):
    return spark.createDataFrame([(name, p, n, b, t, float(s)) for n, (p, b, t, s) in enumerate(rows)], KINDS)


BOOK = [
    (0, 0, "Opening words that are long enough to be kept as an introduction of this chapter, surely so.", 10), (0, 1, "4.1 Laws of Motion", 14), (0, 2, "body one", 10),
    (1, 0, "37.0 °C was the reading", 10), (1, 1, "4.2. Second Law", 14), (1, 2, "body two", 10), (1, 3, "9.9 Other Book Title", 14), (2, 0, "4.1 Laws of Motion", 10), (2, 1, "4.3 Third Law", 10), (2, 2, "4.2 Second Law Again", 10),
]


def test_numbered_headings_and_segments(spark):
    lines = doc(spark, BOOK)
    found = D.numbered(lines)
    assert sorted((r.number, r.name) for r in found.collect()) == [("4.1", "Laws of Motion"), ("4.2", "Second Law"), ("4.3", "Third Law")]
    seg = {r.name: r.text for r in D.segments(lines, found).collect()}
    assert set(seg) == {"Introduction", "Laws of Motion", "Second Law", "Third Law"} and seg["Laws of Motion"].startswith("body one")
    assert D.calibration(lines).first().major == 4


def test_capitals_skip_running_headers_and_stop_at_the_end(spark):
    rows = [(p, 0, "THE BOOK NAME", 9) for p in range(4)] + [(0, 1, "CHEMICAL", 12), (0, 1, "EQUATIONS", 12), (1, 2, "Plain text", 10), (2, 1, "TABLE 3 VALUES", 12), (2, 2, "CHEMICAL EQUATIONS", 12), (3, 1, "Exercises", 12), (3, 2, "AFTER THE END", 12)]
    assert [r.name for r in D.all_caps(doc(spark, rows)).collect()] == ["Chemical Equations"]


def test_sizes_and_routing(spark):
    rows = [(0, 0, "1 Power Sharing", 20), (0, 1, "1.1 In a Country", 13), (0, 2, "text", 10), (0, 3, "Loose Heading", 20)]
    lines = doc(spark, rows, "s").unionByName(doc(spark, BOOK, "n"))
    tiers = {"topic": (19.5, 20.5), "sub": (12.5, 13.5)}
    assert [(r.name, r.tier) for r in D.size_tiers(lines.where("doc = 's'"), **tiers, own_number=True).orderBy("line_no").collect()] == [("Power Sharing", 1), ("In a Country", 2)]
    rules = spark.createDataFrame([("s", "sizes")], "doc string, detector string")
    got = D.routed(lines, rules, **tiers).collect()
    assert {r.doc for r in got} == {"s", "n"} and sum(r.doc == "s" for r in got) == 3


def test_boxes_and_questions(spark):
    rows = [(0, 0, "before", 10), (0, 0, "Figure it Out", 12), (0, 0, "box text", 12), (0, 0, "after the box", 9), (1, 0, "next page", 10)]
    assert [r.text for r in D.without_boxes(doc(spark, rows), "Figure it Out").orderBy("page", "line_no").collect()] == ["before", "after the box", "next page"]
    qa = [(0, 0, "noise", 10), (0, 0, "Q1. What is", 10), (0, 0, "force?", 10), (0, 0, "Ans. A push", 10), (0, 0, "or pull.", 10), (0, 0, "Q2. No answer", 10)]
    assert [(r.question, r.answer) for r in D.questions_answers(doc(spark, qa)).collect()] == [("What is force?", "A push or pull.")]


def test_banner(spark):
    rows = [("d", 0, "Power and Work", "red", 20.0), ("d", 0, "Unit III", "red", 24.0), ("d", 0, "body text " * 30, "black", 10.0), ("d", 1, "Later Title", "red", 30.0)]
    s = spark.createDataFrame(rows, "doc string, page int, text string, color string, size double")
    assert [r.title for r in D.banner(s).collect()] == ["Power and Work"]


def test_books_by_sizes_have_topics_and_exercises(spark):
    rows = [
        (0, 0, "Colour plate", 10.0), (0, 1, "Rain and Rivers", 17.0), (0, 2, "Rain falls.", 10.0), (0, 3, "Fact box", 8.0), (0, 4, "How it falls", 15.0), (0, 5, "Slowly.", 10.0),
        (1, 0, "Activity 1 Look", 12.0), (1, 1, "inside the box", 12.0), (1, 2, "after the box", 9.0), (1, 3, "a) a case", 17.0), (1, 4, "Of it.", 10.0),
        (2, 0, "Let us recall", 17.0), (2, 1, "Late Heading", 17.0), (2, 2, "Exercises", 17.0), (2, 3, "1. Why?", 10.0), (2, 4, "", 10.0), (2, 5, "2. How?", 10.0),
    ]
    lines = spark.createDataFrame([("d", p, n, 0, t, s) for p, n, t, s in rows], KINDS)
    got = {(r.kind, r.ordinal): (r.name, r.text) for r in D.revised(lines, (16.5, 17.5), (14.5, 15.5), "^Activity").collect()}
    assert got == {
        ("topic", 1): ("Rain and Rivers", "Rain falls.\nFact box"),
        ("sub-topic", 2): ("How it falls", "Slowly.\nafter the box"),
        ("sub-topic", 3): ("a) a case", "Of it."),
        ("exercise", 1): (None, "1. Why?"),
        ("exercise", 2): (None, "2. How?"),
    }


def test_capitals_decide_the_chapter_and_others_must_rise(spark):
    texts = ["3.1 FIRST LAW", "2.1 Other Book", "3.3 THIRD LAW", "3.2 Second Law", "3.4 Fourth Law", "3.4 FOURTH LAW", "3.5 what is said here in small letters only"]
    lines = spark.createDataFrame([("d", 0, n, 0, t, 10.0) for n, t in enumerate(texts)], KINDS)
    assert [r.number for r in D.capitals_numbered(lines).orderBy("line_no").collect()] == ["3.1", "3.3", "3.4"]
    chapters = spark.createDataFrame([("d", 3)], "doc string, major int")
    from pyspark.sql import functions as F

    got = D.chapter_numbered(lines, chapters, F.col("name").contains("small")).orderBy("line_no").collect()
    assert [r.number for r in got] == ["3.1", "3.3", "3.4"]


def test_banners_are_put_together_and_chosen(spark):
    kinds = "doc string, page int, line_no int, text string, size double, color int, x0 double, x1 double, y0 double"
    rows = [("d", 0, 0, "body text of the page, which is most of what there is to read on it", 10.0, 0, 0.0, 200.0, 300.0), ("d", 0, 1, "T", 40.0, 1, 0.0, 20.0, 50.0), ("d", 0, 2, "he Living", 24.0, 1, 21.0, 120.0, 52.0)]
    rows += [("d", 0, 3, "World", 24.0, 1, 0.0, 60.0, 80.0), ("d", 0, 4, "Unit Two", 50.0, 2, 0.0, 60.0, 10.0), ("d", 0, 5, "Far Away", 24.0, 1, 0.0, 60.0, 250.0), ("d", 1, 0, "Next Page", 60.0, 1, 0.0, 9.0, 0.0), ("d", 0, 6, "small", 12.0, 1, 0.0, 9.0, 99.0)]
    runs = D.banner_runs(spark.createDataFrame(rows, kinds))
    assert {(r.color, r.text, r.size) for r in runs.collect()} == {(1, "The Living World", 40.0), (2, "Unit Two", 50.0), (1, "Far Away", 24.0)}
    assert [r.title for r in D.banner_title(runs).collect()] == ["The Living World"]
