"""Golden cases of lookups, greedy picks, names and retries."""

import pytest
from pyspark.sql import functions as F

from studyloom.operators import names, retrieval
from studyloom.streaming import counters


def one(df, column):
    return [r[column] for r in df.collect()]


def test_greedy_lines_never_take_a_concept_twice(spark):
    rows = [("r", line, 2, f"q{line}{n}", c, str(n)) for line in (1, 2) for n, c in enumerate(["a", "a", "b", "c", "d"])] + [("s", 1, 3, "x", "a", "0")]
    df = spark.createDataFrame(rows, "request_id string, line_no int, count int, question_id string, cluster string, place string")
    got = {}
    for r in retrieval.greedy_lines(df).collect():
        got.setdefault((r.request_id, r.line_no), []).append(r.cluster)
    assert got == {("r", 1): ["a", "b"], ("r", 2): ["c", "d"], ("s", 1): ["a"]}


def test_formulas_and_identities(spark):
    df = spark.createDataFrame([("H2O",), ("CO",), ("Xy2",), ("Ca(OH)2",), ("water",)], "t string")
    assert one(df.select(names.is_formula(F.col("t")).alias("f")), "f") == [True, True, False, True, False]
    aliases = spark.createDataFrame([("carbon monoxide", "CO"), ("carbon monoxide", "carbon monoxide"), ("cobalt", "Co"), ("cobalt", "cobalt"), ("water", "H2O"), ("water", "Water")], "identity string, alias string")
    terms = spark.createDataFrame([("CO",), ("Co",), ("co",), ("h2o",), ("WATER",), ("mud",)], "term string")
    got = {r.term: r.identity for r in names.identities(terms, aliases).collect()}
    assert got == {"CO": "carbon monoxide", "Co": "cobalt", "co": None, "h2o": "water", "WATER": "water", "mud": None}


def test_names_garble_and_continuations(spark):
    df = spark.createDataFrame([("L A W S  of Motion ,\x11 Again",), ("xq zzt vvb wqk",), ("and the Laws of Motion",), ("The body is at rest.",)], "t string")
    assert one(df.select(names.clean_name(F.col("t")).alias("c")), "c")[0] == "LAWS of Motion, Again"
    assert one(df.select(names.garbled(F.col("t"), ["the", "laws", "of", "motion", "body", "is", "at", "rest", "and", "again"]).alias("g")), "g") == [True, True, False, False]
    assert one(df.select(names.continues_title(F.col("t")).alias("c")), "c")[2:] == [True, False]


def test_resilient_calls():
    tries, waits = [], []

    def fails():
        tries.append(1)
        raise ValueError("no")

    assert retrieval.resilient(fails, 2, 1.0, lambda: "other", waits.append) == "other" and len(tries) == 3 and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        retrieval.resilient(fails, 0)
    assert retrieval.resilient(lambda: 5) == 5


def test_nearest_within_a_block(spark):
    rows = [(n, n % 2, [1.0, float(n)]) for n in range(6)]
    df = spark.createDataFrame(rows, "id long, block int, v array<double>")
    got = retrieval.nearest(df.where("id = 1"), df, "block", "id", "v", 2).orderBy("rank").collect()
    assert [r.row_id for r in got] == [3, 5]


def test_late_rows_leave_windows(spark, tmp_path):
    import datetime as dt

    rows = [(f"a{n}", dt.datetime(2025, 1, 1, n)) for n in range(5)]
    spark.createDataFrame(rows, "k string, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, at timestamp").parquet(f"{tmp_path}/in")
    w = counters.windowed(stream, "at", "1 hour", "1 hour", "1 hour")
    q = w.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").count() >= 3 and counters.sessions(spark.read.parquet(f"{tmp_path}/in"), "at", "90 minutes", "1 hour").count() == 1


def test_sliced_blocks_find_the_same_parents(spark):
    import numpy as np

    from studyloom.operators import dedup

    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 8))
    rows = [(f"q{n:03}", "b" if n % 3 else "c", n // 5, [float(v) for v in base[n % 20] + 0.1 * rng.normal(size=8)]) for n in range(200)]
    rows += [("bad", "b", 1, [1.0]), ("none", "b", 1, None), ("nul", None, 1, rows[0][3]), ("zero", "b", 99, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id string, block string, at int, v array<double>")
    one, cut = ({tuple(r) for r in dedup.nearest_earlier(df, ["block"], "id", ["at"], "v", 0.9, 8, slice_rows=n).collect()} for n in (10_000, 30))
    assert one == cut and len(one) > 100
    good = {r[0]: (r[1], r[2], np.array(r[3]) / np.linalg.norm(r[3])) for r in rows[:200]}
    for i, parent, s in one:
        earlier = {j: round(float(good[i][2] @ v), 9) for j, (b, at, v) in good.items() if b == good[i][0] and (at, j) < (good[i][1], i)}
        assert abs(max(earlier.values()) - s) < 1e-6 and earlier[parent] >= s - 1e-6


def test_nearest_is_the_same_in_any_number_of_parts(spark):
    rows = [(n, n % 2, [float(n % 7), float(n % 5), 1.0]) for n in range(60)] + [(99, 0, None), (98, 0, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, block int, v array<double>")
    one, many = ({tuple(r) for r in retrieval.nearest(df, df, "block", "id", "v", 3, parts=p).collect()} for p in (1, 7))
    assert one == many and len(one) == 61 * 3


def test_cross_lines_are_filled_beyond_a_large_cluster(spark):
    rows = [("r", 1, 2, f"a{n:03}", "big", f"{n:03}") for n in range(100)] + [("r", 1, 2, "z", "small", "999"), ("r", 2, 1, "y", "big", "0")]
    df = spark.createDataFrame(rows, "request_id string, line_no int, count int, question_id string, cluster string, place string")
    got = {(r.line_no, r.question_id) for r in retrieval.greedy_lines(df, 3).collect()}
    assert got == {(1, "a000"), (1, "z")}


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from studyloom.session import ensure_checkpoint_dir

    none = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))
    spark = SimpleNamespace(sparkContext=SimpleNamespace(_jsc=jsc, master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(spark)
