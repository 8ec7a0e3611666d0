"""Problems 1 and 5 against brute force."""

import numpy as np
import pytest

from studyloom.llm import pivot_history, similar_vectors
from studyloom.llm.vectors import Tree, calibrated, close_pairs, digest, pack, unit, unpack

KINDS = "question_id string, embedding array<float>, text_hash string, batch_no int, id string, h string"


def made(n=600, dim=16, seed=1, copies=150):
    """Families of near copies, exact copies of one vector, scaled ones, and every kind of unusable vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    x = (centres[np.arange(n) % (n // 6)] + 0.12 * rng.normal(size=(n, dim))).astype(np.float32)
    x[:copies] = x[0]
    x[copies : copies + 5] *= np.float32(3)
    rows = [(f"q{i:04}", [float(v) for v in x[i]], f"{'AbC' if i % 50 == 0 else i}", int(i % 4), None, "x") for i in range(n)]
    nan = float("nan")
    bad = [None, [], [1.0], [0.0] * dim, [nan] * dim, [None] * dim, [float("inf")] * dim]
    rows += [(f"z{i}", v, None if i % 2 else "abc", 3, "clash", None) for i, v in enumerate(bad)] + [(None, rows[0][1], "1", 3, "", ""), rows[200]]
    return rows, x


def brute(rows, k, least, dim):
    usable = {i: np.array(v, np.float64) for i, v, *_ in rows if i and v and len(v) == dim and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(usable)
    m = np.stack([usable[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    out = {}
    for n, i in enumerate(ids):
        near = sorted((-s[n, j], ids[j]) for j in range(len(ids)) if j != n and s[n, j] >= least)[:k]
        out[i] = near
    return out


def test_packing_is_lossless():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.round(rng.normal(size=(5, 8)) * 64) / 64, rng.normal(size=(5, 8)), np.full((1, 8), 1e30)]).astype(np.float32)
    assert (unpack(pack(x), 8) == x).all() and len(set(digest(x))) == len(x)
    assert [len(b) for b in pack(x)][:5] == [16] * 5 and len(pack(x)[-1]) == 32


def test_tree_visits_widen_to_all_leaves():
    x = unit(np.random.default_rng(2).normal(size=(400, 8)).astype(np.float32))
    tree = Tree(x, 20)
    assert 10 < tree.leaves < 60 and abs(sum(tree.share) - 1) < 1e-9
    (narrow, _), (wide, far) = tree.visits(x, 1), tree.visits(x, tree.leaves)
    assert all(set(v) == set(range(tree.leaves)) for v in wide) and all(a == b[:1] for a, b in zip(narrow, wide))
    assert all(v == sorted(v) for v in far)
    some, more = tree.visits(x, 2)[0], tree.visits(x, 2, 0.05)[0]
    assert {len(v) for v in some} == {2} and {len(v) for v in more} == {2, 3} and all(v[:2] == w for v, w in zip(more, some))


@pytest.mark.parametrize("both", [True, False])
def test_calibration_reaches_its_target(both):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2000, 16))
    a, b = unit(a.astype(np.float32)), unit((a + 0.3 * rng.normal(size=a.shape)).astype(np.float32))
    tree = Tree(np.concatenate([a, b]), 40)
    most, gap, reached = calibrated(tree, (a, b), 0.99, both)
    to_a, to_b = tree.visits(a, most, gap)[0], tree.visits(b, most, gap)[0]
    met = [bool(set(v) & set(w if both else w[:1])) for v, w in zip(to_a, to_b)]
    assert 0.99 <= np.mean(met) and abs(np.mean(met) - reached) < 1e-9 and most < tree.leaves


def test_close_pairs_equal_brute_force():
    x = np.random.default_rng(4).normal(size=(90, 6)).astype(np.float32)
    got = {(int(a), int(b)) for i, j, _ in close_pairs(x, x, 0.7, block=7) for a, b in zip(i, j)}
    m = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {tuple(map(int, p)) for p in np.argwhere(np.round(m @ m.T, 9) >= 0.7)}
    assert got == want
    once = [(int(a), int(b)) for i, j, _ in close_pairs(x, None, 0.7, block=7) for a, b in zip(i, j)]
    assert sorted(once) == sorted(p for p in want if p[0] <= p[1])


def test_one_leaf_is_exact_with_ties_and_copies(spark):
    rows, _ = made()
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    got = {}
    for r in similar_vectors.similar_vectors(df, least=0.8, dim=16, least_leaves=1).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.similarity))
    for i, near in brute(rows, 10, 0.8, 16).items():
        assert [(n, s) for _, n, s in sorted(got.get(i, []))] == [(n, -s) for s, n in near], i


def test_pairs_reach_recall_with_many_leaves(spark):
    rows, _ = made(1200, copies=300)
    df = spark.createDataFrame(rows, KINDS).repartition(6)
    got = {tuple(r) for r in similar_vectors.similar_pairs(df, least=0.8, dim=16, leaf_rows=60, block=100).collect()}
    want = {(min(i, n), max(i, n)) for i, near in brute(rows, 10, 0.8, 16).items() for _, n in near}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("how, least", [({"least_leaves": 1}, 1.0), ({"leaf_rows": 60, "block": 250, "part": 300, "probes": 400}, 0.97)])
def test_lists_without_a_floor_are_full(spark, how, least):
    rows, _ = made(900, copies=200, seed=9)
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    got = {}
    for r in similar_vectors.similar_vectors(df, dim=16, **how).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.similarity))
    want = brute(rows, 10, -2, 16)
    assert got.keys() == want.keys() and {len(v) for v in got.values()} == {10}
    same = sum(len({n for _, n, _ in got[i]} & {n for _, n in near}) for i, near in want.items())
    assert same >= least * 10 * len(want)
    if least == 1:
        for i, near in want.items():
            assert [(n, s) for _, n, s in sorted(got[i])] == [(n, -s) for s, n in near], i


def test_empty_and_all_unusable(spark):
    empty = spark.createDataFrame([], KINDS)
    bad = spark.createDataFrame([("a", None, None, None, None, None), ("b", [0.0] * 16, None, 1, None, None)], KINDS)
    for df in (empty, bad):
        assert similar_vectors.similar_pairs(df, dim=16).count() == 0 and pivot_history.turned_away(df, dim=16).count() == 0


def away(rows, least, dim):
    out = set()
    good = [(i, np.array(v, np.float64), b) for i, v, _, b, *_ in rows if v and len(v) == dim and None not in v and np.isfinite(v).all() and np.any(v)]
    m = np.stack([v for _, v, _ in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T >= least
    batch = np.array([b for _, _, b in good])
    for n, (i, _, b) in enumerate(good):
        if i and (s[n] & (batch < b)).any():
            out.add(i)
    first = {}
    for _, _, h, b, *_ in rows:
        if h:
            first[h.lower()] = min(first.get(h.lower(), 99), b)
    return out | {i for i, _, h, b, *_ in rows if i and h and first[h.lower()] < b}


@pytest.mark.parametrize("pivots", [10_000, 100])
def test_batches_against_history(spark, pivots):
    rows, _ = made(900, copies=200, seed=5)
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    got = {r.question_id for r in pivot_history.turned_away(df, dim=16, rows_per_pivot=pivots, block=90).collect()}
    want = away(rows, 0.9, 16)
    assert not got - want and len(got) >= (len(want) if pivots > 1000 else 0.98 * len(want))


def test_null_batches_take_no_part(spark):
    v = [1.0] + [0.0] * 15
    df = spark.createDataFrame([("a", v, "H", None, None, None), ("b", v, "h", 2, None, None), ("c", v, None, 2, None, None)], KINDS)
    assert pivot_history.turned_away(df, dim=16).count() == 0


def test_batches_one_by_one_equal_all_at_once(spark, tmp_path):
    """check, then append, for one batch after the other; the history isn't moved, and only asked ranges are read."""
    rows, x = made(400, copies=40, seed=7)
    df = spark.createDataFrame([r for r in rows if r[0]], KINDS)
    ranges = pivot_history.Ranges(unit(x[:10]), unit(x), 4000, 60)
    assert ranges.parts > 12
    table = pivot_history.PivotTable(spark, str(tmp_path / "t"), ranges, 9.0, 0.9, 16, buckets=4)
    table.append(df.where("batch_no = 0"))
    got, size = set(), table.stored("vectors").count()
    for b in (1, 2, 3):
        new = df.where(f"batch_no = {b}")
        checked = table.check(new)
        got |= {r.question_id for r in checked.collect()}
        table.append(new)
        assert table.stored("vectors").count() > size
        size = table.stored("vectors").count()
    assert got == away([r for r in rows if r[0]], 0.9, 16)
    late = df.where("batch_no > 0")
    assert {r.question_id for r in table.check(late, hot_rows=2).collect()} == got == {r.question_id for r in table.check(late, prune=False).collect()}
    one = df.where("question_id = 'q0101'")
    narrow = pivot_history.PivotTable(spark, table.path, ranges, 0.0, 0.9, 16, buckets=4)
    narrow.name = table.name
    parts = narrow.asked_parts(one.selectExpr("embedding", "batch_no", "question_id AS id"))
    assert 0 < len(parts) < ranges.parts
    plan = narrow.check(one)._jdf.queryExecution().toString()
    scan = plan[plan.rindex("FlatMapCoGroupsInArrow") :]
    assert "PushedFilters: [In(part" in scan or "PushedFilters: [EqualTo(part" in scan or "part IN" in scan
    assert scan.count("Exchange hashpartitioning(part") + scan.count("REPARTITION_BY_NUM") <= 2  # the questions only
    table.drop()


def test_too_few_pairs_leave_the_exact_bound(spark):
    """One near pair in the sample or none is no calibration: nothing may be missed then, wherever the copies lie."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[1400:] = x[:100] + 0.1 * rng.normal(size=(100, 16)).astype(np.float32)
    rows = [(f"q{i:04}", [float(v) for v in x[i]], None, int(i >= 1400), None, None) for i in range(1500)]
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    how = {"rows_per_pivot": 30, "probes": 5, "most_probes": 60}
    ranges, margin, _ = pivot_history.choose_pivots(df, "question_id", "embedding", 16, 0.9, 0.999, **how)
    assert len(ranges.pivots) > 20 and margin >= 2 * np.sqrt(0.2)
    assert {r.question_id for r in pivot_history.turned_away(df, dim=16, **how).collect()} == away(rows, 0.9, 16)
    pairs = {tuple(r) for r in similar_vectors.similar_pairs(df, least=0.9, dim=16, leaf_rows=60, probes=5, most_probes=60).collect()}
    assert pairs == {(min(i, n), max(i, n)) for i, near in brute(rows, 10, 0.9, 16).items() for _, n in near}


def wide(x, cosine, rng):
    """A row at this cosine of each row of x."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=x.shape)
    other -= np.einsum("ij,ij->i", other, u)[:, None] * u
    return (cosine * u + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other, axis=1, keepdims=True)).astype(np.float32)


def test_rare_pairs_unlike_the_others_are_found(spark):
    """Thousands of tight pairs in one range and a few wide ones across ranges: no threshold fitted on most of the pairs may lose the rest."""
    rng = np.random.default_rng(13)
    centres, rare = rng.normal(size=(500, 16)), rng.normal(size=(20, 16)).astype(np.float32)
    tight = (centres[np.arange(6000) % 500] + 0.002 * rng.normal(size=(6000, 16))).astype(np.float32)
    x = np.concatenate([tight, rare, wide(rare, 0.903, rng)])
    rows = [(f"q{i:04}", [float(v) for v in x[i]], None, int(i >= 6020 or i % 2), None, None) for i in range(len(x))]
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    assert {r.question_id for r in pivot_history.turned_away(df, dim=16, rows_per_pivot=30).collect()} == away(rows, 0.9, 16)


def test_sketches_bound_the_cosine():
    rng = np.random.default_rng(17)
    x = rng.normal(size=(300, 160)).astype(np.float32)
    x[:5], x[0, 1:] = np.eye(160, dtype=np.float32)[:5], 0
    a, b = unit(x), unit(wide(x, 0.9, rng))
    s, t = pivot_history.sketched(a), pivot_history.sketched(b)
    assert s.shape == (300, pivot_history.SKETCH + 1)
    for one, two, p, q in ((a, b, s, t), (a, a, s, s)):
        assert (p @ q.T >= one.astype(np.float64) @ two.T.astype(np.float64) - 1e-5).all()


def test_rounds_equal_brute_force(spark, tmp_path):
    """Several rounds, sketches, families larger than a sketch sorts out, pairs on both sides of the threshold."""
    rng = np.random.default_rng(19)
    rows, x = made(400, dim=160, copies=40, seed=19)
    far = np.concatenate([wide(x[100:150], 0.9001, rng), wide(x[150:200], 0.8999, rng), wide(np.repeat(x[200:201], 80, 0), 0.96, rng)])
    rows = [(i, v, None, *r) for i, v, _, *r in rows if i] + [(f"w{n:03}", [float(v) for v in far[n]], None, 3, None, None) for n in range(len(far))]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    ranges = pivot_history.Ranges(unit(x[:10]), unit(x), 4000, 60)
    table = pivot_history.PivotTable(spark, str(tmp_path / "t"), ranges, 9.0, 0.9, 160, buckets=2)
    table.append(df)
    got = [r.question_id for r in table.check(df.where("batch_no > 0"), prune=False, round_rows=100).collect()]
    table.drop()
    assert sorted(got) == sorted(away(rows, 0.9, 160))
