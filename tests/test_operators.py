"""Golden cases of single operators."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import allocate, bank, catalog, chunking, dedup, grading, layout, performance, validate
from studyloom.sources import tables as sources
from studyloom.streaming import counters as streaming

SCOPE = {"class": "7", "subject": "Science", "chapter": "C", "topic": "T"}
Q = "question_id string, class string, subject string, chapter string, topic string, difficulty string, type string, text string, payload string, concept_cluster_id string, created_at timestamp_ntz, embedding array<float>"


def question(i, kind="MCQ", text="t", payload="{}", cluster=None, difficulty="easy", vector=None, day=1, **scope):
    s = SCOPE | scope
    return (i, s["class"], s["subject"], s["chapter"], s["topic"], difficulty, kind, text, payload, cluster, dt.datetime(2025, 1, day), vector)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), Q)


def one(df, column):
    return [r[column] for r in df.collect()]


def test_normal_text_and_hash(spark):
    df = spark.createDataFrame([("  What IS \n it ",), ("what is it",), (None,)], "t string")
    got = df.select(T.normal("t").alias("n"), T.text_hash("t").alias("h")).collect()
    assert got[0].n == got[1].n == "what is it" and got[0].h == got[1].h and got[2].h is None


def test_jaccard_of_words(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", "x"), ("A a", "a")], "x string, y string")
    assert one(df.select(T.jaccard(T.word_set("x"), T.word_set("y")).alias("j")), "j") == [0.5, 0.0, 1.0]


def test_natural_order(spark):
    df = spark.createDataFrame([("1.10",), ("1.2",), ("10",), ("2",)], "n string")
    assert one(df.orderBy(T.natural_key("n")), "n") == ["1.2", "1.10", "2", "10"]


def test_headline_fence_runs_and_sentences(spark):
    df = spark.createDataFrame([("THE LAW OF MOTION", '```json\n{"a": 1}\n```', "ab ab ab ab! 1000 CE", "See Fig. 2 now. Then go! End")], "a string, b string, c string, d string")
    r = df.select(T.headline("a").alias("a"), T.strip_fence("b").alias("b"), T.collapse_runs("c").alias("c"), T.sentences("d").alias("d")).first()
    assert r.a == "The Law of Motion" and r.b == '{"a": 1}' and "1000 CE" in r.c and r.d == ["See Fig. 2 now.", "Then go!", "End"]


def test_lookup_excludes_seen_one_per_concept_and_limits(spark):
    qs = frame(spark, *(question(f"q{n}", cluster="k" if n < 3 else None) for n in range(8)), question("other", difficulty="hard"))
    req = spark.createDataFrame([("u", "7", "Science", "easy", "MCQ"), ("v", "7", "Science", "easy", "MCQ")], "user_id string, class string, subject string, difficulty string, question_type string")
    seen = spark.createDataFrame([("u", f"q{n}") for n in (0, 1, 3, 4)], "user_id string, question_id string")
    got = bank.lookup(req, qs, seen, 4).collect()
    u, v = ({r.question_id for r in got if r.user_id == x} for x in "uv")
    assert len(u) == 4 and u <= {"q2", "q5", "q6", "q7"} and len(v) == 4 and len(v & {"q0", "q1", "q2"}) <= 1
    short = {r.user_id: r.shortfall for r in bank.shortfall(req, bank.lookup(req, qs, seen, 9), 9).collect()}
    assert short == {"u": 5, "v": 3}


def test_wellformed_matching_drops_missing_and_repeated(spark):
    m = lambda left, right: json.dumps({"left_items": left, "right_items": right})
    df = frame(spark, question("ok", "matching", payload=m(["a", "b"], ["x", "y"])), question("rep", "matching", payload=m(["a", "a"], ["x", "y"])), question("none", "matching"), question("mcq"))
    assert set(one(bank.wellformed_matching(df), "question_id")) == {"ok", "mcq"}


def test_identity_of_pairs_is_free_of_order_but_not_of_case(spark):
    p = lambda d: json.dumps({"pairs": d})
    df = frame(spark, question("a", "matching", payload=p({"x": "1", "y": "2"})), question("b", "matching", payload=p({"y": " 2", "x": "1"}), day=2), question("c", "matching", payload=p({"X": "1", "y": "2"}), day=3))
    got = {r.question_id: r.duplicate_of for r in dedup.exact_duplicates(df).collect()}
    assert got == {"a": None, "b": "a", "c": None}


def test_exact_duplicates_stay_in_scope(spark):
    df = frame(spark, question("a", text="Hi there"), question("b", text=" hi  THERE", day=2), question("c", text="hi there", topic="other", day=3))
    assert {r.question_id: r.duplicate_of for r in dedup.exact_duplicates(df).collect()} == {"a": None, "b": "a", "c": None}


def sequential(vectors, least):
    """The clusters that one-at-a-time intake makes."""
    out = {}
    ids = sorted(vectors)
    for n, i in enumerate(ids):
        best = max(((round(float(np.dot(vectors[i], vectors[j]) / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j])), 9), -m) for m, j in enumerate(ids[:n])), default=(0, 0))
        out[i] = out[ids[-best[1]]] if best[0] >= least else i
    return out


def test_clusters_equal_sequential_intake(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    vs = {f"q{n:02}": (base[n % 6] + 0.25 * rng.normal(size=8)).astype(np.float32) for n in range(40)}
    rows = [question(i, vector=[float(x) for x in v]) for i, v in vs.items()] + [question("zz", vector=None), question("zy", vector=[0.0] * 8)]
    got = {r.question_id: r.cluster for r in dedup.clusters(frame(spark, *rows), least=0.9, dim=8).collect()}
    assert {k: v for k, v in got.items() if k[0] == "q"} == sequential(vs, 0.9) and got["zz"] == "zz" and got["zy"] == "zy"


ANSWERS = [("10,000", "10000", True), ("98%", "98", True), ("10.01", "10", False), ("10 kg", "10 m", True), ("Photosynthesis ", " photosynthesis", True), ("xylem", "phloem", False), ("", "x", False)]


@pytest.mark.parametrize("given,key,right", ANSWERS)
def test_fill_in_blank(spark, given, key, right):
    q = frame(spark, question("q", "fill_in_blank", payload=json.dumps({"answer": key, "accepted_answers": []})))
    a = spark.createDataFrame([("a", "q", json.dumps(given), False)], "attempt_id string, question_id string, user_answer string, is_correct boolean")
    assert one(grading.graded(a, q), "verdict") == [right]


def test_compatibility_form_and_matching(spark):
    q = frame(spark, question("f", "fill_in_blank", payload=json.dumps({"answer": "CO2", "accepted_answers": ["carbon dioxide"]})), question("m", "matching", payload=json.dumps({"pairs": {"a": "1", "b": "2"}})))
    a = spark.createDataFrame([("x", "f", json.dumps("CO₂"), False), ("x", "m", json.dumps({"a": "1", "b": "9"}), False), ("y", "m", json.dumps({"a": "1", "b": "2", "c": "3"}), False), ("z", "m", None, False)], "attempt_id string, question_id string, user_answer string, is_correct boolean")
    got = {(r.attempt_id, r.question_id): r.verdict for r in grading.graded(a, q, unicode=True).collect()}
    assert got == {("x", "f"): True, ("x", "m"): False, ("y", "m"): True, ("z", "m"): False}
    assert {r.attempt_id: r.right for r in grading.pair_results(a, q).collect()} == {"x": 1, "y": 2, "z": 0}


def test_payload_rules(spark):
    j = json.dumps
    good = {"question": "q", "options": ["a", "b", "c", "d"], "correct_option_index": 1}
    df = frame(
        spark, question("1", payload=j(good)), question("2", payload=f"```json\n{j(good | {'correct_option_index': 4})}\n```"), question("3", payload=j(good | {"options": ["a"]})),
        question("4", "fill_in_blank", payload=j({"answer": "a b c d e"})), question("5", "fill_in_blank", payload=j({"answer": "x^2"})), question("6", "fill_in_blank", payload=j({"answer": "osmosis"})),
        question("7", "matching", payload=j({"left_items": ["a", "b", "c"], "right_items": ["x", "y", "z"], "pairs": {"a": "x", "b": "y", "c": "z"}})),
        question("8", "matching", payload=j({"left_items": ["a", "b", "c"], "right_items": ["x", "y", "z"], "pairs": {"a": "x", "b": "y", "c": "q"}})), question("9", payload="no json"),
    )
    got = {r.question_id: r.reason for r in validate.payload_rules(df).collect()}
    assert got == {"1": "", "2": "index out of range", "3": "not four options", "4": "not a term", "5": "a formula", "6": "", "7": "", "8": "pairs don't fit", "9": "no question"}


def test_shares_add_up_and_rotate(spark):
    u = spark.createDataFrame([("k", f"u{n}") for n in range(3)], "key string, u string")
    assert [r.share for r in allocate.equal_shares(u, "key", "u", 25).orderBy("u").collect()] == [9, 8, 8]
    assert [r.share for r in allocate.equal_shares(u, "key", "u", 10, start=2).orderBy("u").collect()] == [3, 3, 4]


def test_weighted_sample_prefers_weak(spark):
    u = spark.createDataFrame([(f"k{n}", x, w) for n in range(300) for x, w in (("weak", 0.8), ("strong", 0.1))], "key string, unit string, w double")
    got = one(allocate.weighted_sample(u, "key", "unit", "w", 1), "unit")
    assert len(got) == 300 and got.count("weak") > 225


def test_count_options(spark):
    df = spark.createDataFrame([(6,), (25,), (24,), (30,)], "topics int")
    assert one(catalog.count_options(df), "options") == ["10,15,20,25", "5,10,15,20,25", "25", "5,10,15,20,25"]


def test_empty_performance_has_one_row(spark):
    c = spark.createDataFrame([], "user_id string, class string, subject string, chapter string, topic string, question_type string, correct_count long, total_count long")
    r = performance.bucket(c).first()
    assert (r.correct, r.total, r.accuracy) == (0, 0, None)


def test_headings(spark):
    df = spark.createDataFrame([("d", n, t) for n, t in enumerate(["2.4. Laws of Motion", "37.0 °C was read", "10.4 cm long", "3.8.1 Fertile Gene", "text"])], "source_file string, line_no int, text string")
    assert one(layout.headings(df), "number") == ["2.4", "3.8.1"]
    filled = layout.with_current_heading(df, ["line_no"]).orderBy("line_no").collect()
    assert [r.heading for r in filled] == ["2.4", "2.4", "2.4", "3.8.1", "3.8.1"]


def glyph(c, x0, x1, y0, y1, size):
    return ("d", 1, 1, 0, c, float(x0), float(y0), float(x1), float(y1), float(size))


def test_glyphs_to_lines(spark):
    kinds = "doc string, page int, block int, pos int, c string, x0 double, y0 double, x1 double, y1 double, size double"
    row = [glyph("H", 0, 8, 0, 12, 12), glyph("H", 0.5, 8, 0.2, 12, 12), glyph("2", 8, 12, 6, 12, 7), glyph("O", 12, 20, 0, 12, 12)]
    assert one(layout.glyph_lines(spark.createDataFrame(row, kinds)), "text") == ["H2O"]
    far = [glyph("H", 0, 8, 0, 12, 12), glyph("2", 60, 64, 6, 12, 7)]
    assert sorted(one(layout.glyph_lines(spark.createDataFrame(far, kinds)), "text")) == ["2", "H"]
    full = [glyph("H", 0, 8, 0, 12, 12), glyph("2", 8, 12, 6, 18, 12)]
    assert sorted(one(layout.glyph_lines(spark.createDataFrame(full, kinds)), "text")) == ["2", "H"]


def test_two_columns_range_join_and_chapter_end(spark):
    lines = spark.createDataFrame([("d", 1, 2, 5, "r", 300.0, 500.0), ("d", 1, 1, 6, "l", 10.0, 200.0)], "doc string, page int, block int, line_no int, text string, x0 double, x1 double")
    assert [r.text for r in layout.two_columns(lines).orderBy("place").collect()] == ["l", "r"]
    pages = spark.createDataFrame([("d", p, "1" if p < 4 else "2") for p in range(1, 7)], "doc string, page int, heading string")
    tables = spark.createDataFrame([("a", "d", 3), ("b", "d", 5), ("c", "d", 9)], "table_id string, doc string, page int")
    assert {r.table_id: r.heading for r in layout.table_topics(tables, layout.page_ranges(pages)).collect()} == {"a": "1", "b": "2", "c": None}
    marks = spark.createDataFrame([("d", p, 0) for p in (1, 3, 9, 11)], "doc string, page int, line_no int")
    assert one(layout.chapter_end(marks), "end_page") == [3]


def test_packing_equals_a_loop(spark):
    random.seed(1)
    texts = ["x" * random.randint(0, 900) for _ in range(60)] + ["y" * 2500, "z"]
    df = spark.createDataFrame([("d", n, t) for n, t in enumerate(texts)], "doc string, n int, text string")
    got = {r.n: r.piece for r in chunking.packed(df, ["doc"], ["n"]).collect()}
    want, used, piece = {}, 0, 0
    for n, t in enumerate(texts):
        if used and used + len(t) > 2000:
            piece, used = piece + 1, 0
        used += len(t)
        want[n] = piece
    assert got == want


def test_markdown_and_table_filter(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", None]], 0.1), ([["x" * 200]], 0.1), ([["a"]], 0.5)], "rows array<array<string>>, area double")
    kept = chunking.real_tables(df)
    assert one(chunking.markdown(kept), "markdown") == ["| a | b |\n| --- | --- |\n| 1 |  |"]


def test_threshold_sweep(spark):
    df = spark.createDataFrame([(0.95, True), (0.9, True), (0.91, False), (0.5, False)], "similarity double, near boolean")
    r = dedup.sweep(df, F.col("near")).first()
    assert (r.missed, r.merged, r.t) == (0, 1, 0.9)


def test_upsert_publish_formats_and_isolation(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    up = sources.upserted(old, new, ["k"])
    root = str(tmp_path / "pub")
    sources.publish(spark, root, {"t": old})
    sources.publish(spark, root, {"t": up})
    assert {r.k: r.v for r in sources.published(spark, root, "t").collect()} == {"a": 1, "b": 2, "c": 2}
    for fmt in ("parquet", "orc", "json", "csv", "tsv"):
        sources.write(up, f"{tmp_path}/{fmt}", fmt)
        options = {"header": "true"} if fmt == "tsv" else {}
        assert sources.read(spark, f"{tmp_path}/{fmt}", fmt, "k string, v int", **options).count() == 3
    got = {r.k: (r.result, r.error) for r in sources.isolated(up, lambda r: {"x": 1 // (r["v"] - 2)}, "x int", "k").collect()}
    assert got["a"][0].x == -1 and got["b"][1].startswith("ZeroDivisionError")


def test_repairs_in_order_and_titles(spark):
    c = spark.createDataFrame([("c", "one tvvo", "s", "Unknown"), ("d", "x", "s", "Real")], "chunk_id string, text string, source_file string, chapter string")
    r = spark.createDataFrame([(2, "c", "two", "2"), (1, "c", "tvvo", "two"), (3, None, "one", "")], "repair_id long, chunk_id string, before string, after string")
    assert one(chunking.repaired(c, r), "text") == ["one 2"]
    assert {x.chunk_id: x.chapter for x in chunking.titled(c).collect()} == {"c": "Real", "d": "Real"}


def test_admission_by_rolling_quota(spark, tmp_path):
    rows = [("u", t) for t in (0, 10, 20, 86_405, 86_411)] + [("v", 5)]
    got = streaming.admitted_batch(spark.createDataFrame(rows, "user_id string, at_s long"), limit=2)
    assert {(r.user_id, r.at_s): r.ok for r in got.collect()} == {("u", 0): True, ("u", 10): True, ("u", 20): False, ("u", 86_405): True, ("u", 86_411): True, ("v", 5): True}
    spark.createDataFrame(rows, "user_id string, at_s long").withColumn("at", F.timestamp_seconds("at_s")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id string, at_s long, at timestamp").parquet(f"{tmp_path}/in")
    q = streaming.admitted(stream.select("user_id", "at"), limit=2).writeStream.format("memory").queryName("adm").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.at_s): r.ok for r in spark.table("adm").collect()} == {(r.user_id, r.at_s): r.ok for r in got.collect()}


def test_admission_forgets_users_whose_times_are_over(spark, tmp_path):
    kinds = "user_id string, at_s long"
    day = 86_400
    for n, rows in enumerate(([("u", 1), ("u", 2)], [("v", 10 * day)], [("w", 11 * day)], [("u", 12 * day), ("u", 12 * day + 1), ("u", 12 * day + 2)])):
        spark.createDataFrame(rows, kinds).withColumn("at", F.timestamp_seconds("at_s")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(f"{kinds}, at timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.admitted(stream.select("user_id", "at"), limit=2, delay="1 hour").writeStream.format("memory").queryName("adm2").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.at_s): r.ok for r in spark.table("adm2").collect()} == {("u", 1): True, ("u", 2): True, ("v", 10 * day): True, ("w", 11 * day): True, ("u", 12 * day): True, ("u", 12 * day + 1): True, ("u", 12 * day + 2): False}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 4  # u's first times have left


def test_topic_pieces(spark):
    import re

    from studyloom.operators import chunking as C

    def want(number, text):
        """The rules of SURVEY H19 line by line."""
        whole = text.replace(C.MARKER, "")
        if len(whole) <= 3000 or not number:
            return [("none", whole)]
        lines, method = text.split("\n"), "marked-subheading"
        at = [n for n, x in enumerate(lines) if x.startswith(C.MARKER)]
        lines = [x.replace(C.MARKER, "") for x in lines]
        if not at:
            at, method = [n for n, x in enumerate(lines) if re.match(r"^\d+\.\d+\.\d+\s+.{2,100}$", x)], "sub-subheading"
        if at:
            ends = [*([0] if at[0] else []), *at, len(lines)]
            return [(method, "\n".join(lines[a:b]).strip()) for a, b in zip(ends, ends[1:])]
        out, used = [[]], 0
        for x in lines:
            if out[-1] and used + len(x) > 2000:
                out.append([])
                used = 0
            out[-1].append(x)
            used += len(x)
        return [("paragraph-group", "\n".join(p).strip()) for p in out]

    prose = "\n".join(f"Line {n} of a text \U0001d538 that goes on and on over the page." for n in range(80))
    texts = {
        "short": "a\n1.2.3 Not cut\nb", "short marked": f"a\n{C.MARKER}b", "exact": "x" * 3000, "plain": prose, "one line": "y" * 5000, "blank first": "\n\n" + "z" * 2500 + "\n" + prose,
        "numbers": f"intro\n1.2.1 First part\n{prose}\n1.2.2 Second \r\nend\n1.2.3 x\nnot a heading", "first line": f"1.2.1 First part\n{prose}\n1.2.2\tNext part\n  ",
        "both": f"a\n1.2.1 First part\n{prose}\n{C.MARKER}A. Subhead\nb\n1.2.2 Next\n{C.MARKER}\nc", "in a line": f"a {C.MARKER} b\n{prose}", "empty": "",
    }
    rows = [(f"{name} {k}", number, text) for name, text in texts.items() for k, number in enumerate(["1.2", None, ""])]
    got = {}
    for r in C.topic_pieces(spark.createDataFrame(rows, "topic string, topic_number string, text string"), ["topic"]).collect():
        got.setdefault(r.topic, []).append((r.chunk_index, r.split_method, r.text))
    assert {k: sorted(v) for k, v in got.items()} == {t: [(n, *p) for n, p in enumerate(want(number, text))] for t, number, text in rows}
    assert {m for v in got.values() for _, m, _ in v} == {"none", "marked-subheading", "sub-subheading", "paragraph-group"}


def test_stored_hashes_of_pairs_and_chunk_ids_are_met(spark, sf):
    """The tables' own values, made outside this library, are the check."""
    big = sf.replace("sf0.001", "sf0.01")
    q = spark.read.parquet(f"{big}/questions.parquet").where("lower(text_hash) LIKE 'matching-v2:%'")
    rows = dedup.identity_hash(q).selectExpr("identity", "lower(text_hash) AS stored").collect()
    assert len(rows) > 100 and all(r.identity == r.stored for r in rows)
    chunks = dedup.chunk_ids(spark.read.parquet(f"{big}/chunk.parquet")).distinct().collect()
    assert sum(r.made_id == r.chunk_id for r in chunks) > 0.85 * len(chunks)  # the rest belong to books with a lost topic number


@pytest.mark.parametrize(
    "key, given, right",
    [("magnesium oxide", "MgO", True), ("MgO", "Magnesium Oxide", True), ("MgO", "mgo", True), ("CO", "Co", False), ("carbon monoxide", "co", False), ("cobalt", "Co", True),
     ("CaO", "quicklime", True), ("large", " BIG ", True), ("deoxyribonucleic acid", "dna", True), ("big", "small", False), ("atom", "atoms", True), ("10", "11", False), ("1,000 kg", "1000", True),
     ("H2O", "water", True), ("NaOH", "NaCl", False), ("Fe2O3", "fe2o3", False), ("straße", "STRASSE", True), ("x", "", False), ("x", None, False), (None, "x", False)],
)
def test_equivalent_answers(spark, key, given, right):
    q = frame(spark, question("q", "fill_in_blank", payload=json.dumps({"answer": key, "accepted_answers": ["11", "small"]})))
    a = spark.createDataFrame([("a", "q", None if given is None else json.dumps(given), None)], "attempt_id string, question_id string, user_answer string, is_correct boolean")
    assert one(grading.graded(a, q, unicode=True), "verdict") == [right]


def test_unknown_types_are_not_graded(spark):
    q = frame(spark, question("q", "essay", payload=json.dumps({"answer": "x"})))
    a = spark.createDataFrame([("a", "q", '"x"', None)], "attempt_id string, question_id string, user_answer string, is_correct boolean")
    assert one(grading.graded(a, q), "verdict") == [None]


def test_allocations_add_up_and_faults_are_told(spark):
    kinds = "request_id string, scope_type string, question_count int, units array<string>, types array<string>"
    units = [f"t{n}" for n in range(30)]
    rows = [("all", "all_topics_in_chapter", 25, units, ["MCQ"]), ("few", "topics", 10, units[:3], ["MCQ", "matching", "fill_in_blank"]), ("known", "topics", 5, units[:4], ["MCQ"])]
    rows += [("n", "topics", 7, ["a"], ["MCQ"]), ("u", "topics", 5, [], ["MCQ"]), ("t", "topics", 5, ["a"], []), ("c", "all_topics_in_chapter", 5, units[:5], ["MCQ"]), ("nul", "topics", None, None, None)]
    df = spark.createDataFrame(rows, kinds)
    history = spark.createDataFrame([("known", "t0", 10, 10), ("known", "t1", 10, 10), ("known", "t2", 10, 10), ("known", "t3", 0, 10)], "request_id string, unit string, correct int, total int")
    assert {r.request_id: r.fault for r in allocate.request_faults(df).collect() if r.fault} == {"n": "question count", "u": "no units", "t": "no types", "c": "coverage", "nul": "question count"}
    got = allocate.resolved(df, history).collect()
    sums = {}
    for r in got:
        sums[r.request_id] = sums.get(r.request_id, 0) + r["count"]
    assert sums == {"all": 25, "few": 10, "known": 5} and len([r for r in got if r.request_id == "all"]) == 25
    few = {}
    for r in got:
        if r.request_id == "few":
            few.setdefault(r.unit, {})[r.question_type] = r["count"]
    assert sorted(sum(v.values()) for v in few.values()) == [3, 3, 4] and all(v["MCQ"] >= v["matching"] >= v["fill_in_blank"] for v in few.values())
    assert {r.unit: r["count"] for r in got if r.request_id == "known"}["t3"] == 2  # the weak one gets the remainder
