"""Problem 1: the k most similar vectors of every vector.

Method: a hierarchical k-means tree, fitted on a bounded sample, holds every row in one leaf; each
row visits leaves best bin first through a priority queue, and the visits are widened until the true
neighbours of sampled queries (found by brute force over all rows) are met with the wanted recall, all of them where the sample is the whole table.
With a floor (`least`) a row is found in every leaf it visits, not only in its home: two rows meet if they visit
any leaf in common, which takes far fewer visits, and fewer copies of vectors, than searching homes.

Scale. Rows move once to each leaf they visit. Equal vectors are
merged inside each Arrow batch before the shuffle, so a vector that fills a third of the table
arrives as one row per batch, with its k + 1 smallest ids. Leaves whose share of the sample says they will
outgrow `block` rows are split: base rows are spread over blocks, queries visit all of them. Within a leaf only
pairs above `least` leave the matrix product, and a running top k of each row is kept.
The tree has one leaf for `leaf_rows` rows (at least `least_leaves`), so the rows of a leaf don't grow with the table. What is broadcast is the tree, one
vector for each node: it grows with the table, by 1.5 KB for `leaf_rows` rows, up to `max_leaves` (64 MB), and only beyond that leaves grow.

Without a floor (`least=None`) every row has its k neighbours, however far they are; most of them lie in other leaves, so that nearly
all leaves are visited. Leaves are then packed into shards of up to `block` rows and a row goes once to each shard it has leaves in,
in `part` queries at a time; inside, each leaf is compared with the rows that visit it and a running top k is kept for each row.
The work grows with the square of the rows.

Defined results: rows whose id is NULL or whose vector isn't usable (NULL, wrong length, NULL, NaN
or infinite values, all zero) have no neighbours and are none; equal similarities (9 decimals) rank by the
smaller id; repeated ids count once; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.vectors import (
    SAMPLE,
    SLACK,
    Tree,
    calibrated,
    close_pairs,
    collect_matrix,
    digest,
    exact_cosine,
    matrix,
    nearest_rows,
    pack,
    probed,
    sampled,
    unit,
    unpack,
)

ROUTED = "leaf int, block int, base boolean, h binary, v binary, ids array<string>"
SHARDED = "shard int, part int, asks boolean, home int, leaves array<int>, h binary, v binary, ids array<string>"
NEAREST = "h binary, near array<struct<far: double, id: string>>"
NEAR_TYPE = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.string())]))


def fit(
    df: DataFrame,
    id_col: str,
    vector: str,
    dim: int,
    k: int,
    least: float | None,
    recall: float,
    leaf_rows: int = 1500,
    least_leaves: int = 8,
    max_leaves: int = 40000,
    sample_rows: int = 32768,
    probes: int = 4096,
    most_probes: int = 32768,
    both: bool = True,
) -> tuple[Tree | None, int, float, float, int]:
    """(tree, leaf visits of a row, gap for one more, recall measured on the sample or 1.0 where all leaves are visited, rows); the tree is
    None for a table without a usable vector."""
    total = df.count()
    leaves = int(min(max_leaves, max(least_leaves, total // leaf_rows)))
    x = collect_matrix(sampled(df, id_col, vector, min(SAMPLE, max(sample_rows, 16 * leaves)), total, 1), vector, dim)
    if not len(x):
        return None, 1, -1.0, 1.0, total
    tree = Tree(unit(x), leaves, branching=32)
    if tree.leaves == 1:
        return tree, 1, -1.0, 1.0, total
    whole = total <= probes  # every row is asked, so every true pair is known: none of them need be missed
    if least is None:
        queries = collect_matrix(sampled(df, id_col, vector, probes, total, 2), vector, dim)
        if not len(queries):
            queries = x[:probes]
        some = np.random.default_rng(5).permutation(len(queries))[: len(queries) if whole else max(1, probes // 4)]
        pairs = nearest_rows(df, vector, queries[some], k, dim)
    else:
        pairs = probed(df, id_col, vector, probes, most_probes, total, 2, k, least, dim)
    if pairs is None or not len(pairs[0]):
        # too few to calibrate on: every row is searched for in all leaves, which misses none
        return tree, tree.leaves, -1.0, 1.0, total
    return tree, *calibrated(tree, pairs, 1.0 if whole else recall, both), total


def _route(shared, most: int, gap: float, dim: int, keep_ids: int, blocks: list[int]):
    def run(batches):
        tree: Tree = shared.value
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            first: dict[bytes, int] = {}
            members: dict[bytes, list[str]] = {}
            for n, (h, i) in enumerate(zip(digest(x), ids)):
                if i is not None:
                    if h not in first:
                        first[h], members[h] = n, []
                    members[h].append(i)
            if not first:
                continue
            hs, at = list(first), np.fromiter(first.values(), np.int64, len(first))
            packed = pack(x[at])
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for h, v, leaves in zip(hs, packed, tree.visits(unit(x[at]), most, gap)[0]):
                small = sorted(set(members[h]))[:keep_ids]
                code = int.from_bytes(h[:4], "little")
                for leaf in leaves:
                    for block in range(blocks[leaf]):
                        for column, value in zip(out, (leaf, block, block == code % blocks[leaf], h, v, small)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int32()),
                    pa.array(out[1], pa.int32()),
                    pa.array(out[2], pa.bool_()),
                    pa.array(out[3], pa.binary()),
                    pa.array(out[4], pa.binary()),
                    pa.array(out[5], pa.list_(pa.string())),
                ],
                ["leaf", "block", "base", "h", "v", "ids"],
            )

    return run


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, first_id: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the `keep` best pairs of each owner, by similarity, then by the partner's smallest id."""
    order = np.lexsort((first_id[other], -sim, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    return order[rank < keep]


def _search(dim: int, least: float, keep: int):
    def run(t: pa.Table) -> pa.Table:
        groups: dict[bytes, int] = {}
        packed, ids, base = [], [], []
        for b, h, v, i in zip(*(t.column(c).to_pylist() for c in ("base", "h", "v", "ids"))):
            if h not in groups:
                groups[h] = len(packed)
                packed.append(v)
                ids.append(i)
                base.append(b)
            else:
                g = groups[h]
                ids[g], base[g] = sorted({*ids[g], *i})[:keep], base[g] or b
        x, inside = unpack(packed, dim), np.flatnonzero(base)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(np.array([i[0] for i in ids]), kind="stable")] = np.arange(len(ids))
        several = np.array([len(i) > 1 for i in ids])
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        waiting, parts = 0, [held]
        for i, j, s in close_pairs(x, None if len(inside) == len(x) else x[inside], least):
            j = inside[j]
            other = (i != j) | several[i]  # a vector alone in its group is no neighbour of itself
            i, j, s = i[other], j[other], s[other]
            parts.append((np.r_[i, j], np.r_[j, i], np.r_[s, s]))
            waiting += 2 * len(i)
            if waiting > 4 * keep * len(x):
                held = _kept(parts, rank, keep)
                waiting, parts = 0, [held]
        i, j, s = _kept(parts, rank, keep)
        hs, near = [], []
        names, starts = list(groups), np.searchsorted(i, np.arange(len(x) + 1))
        for n in np.unique(i).tolist():
            at = range(starts[n], starts[n + 1])
            found = sorted((-float(s[p]), one) for p in at for one in ids[j[p]])[:keep]
            hs.append(names[n]), near.append([{"far": f, "id": one} for f, one in found])
        return pa.table([pa.array(hs, pa.binary()), pa.array(near, NEAR_TYPE)], ["h", "near"])

    return run


def _kept(parts: list[tuple], rank: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `keep` best partners of each owner, in the order of the owners; pairs told twice count once."""
    i, j, s = (np.concatenate([p[n] for p in parts]) for n in range(3))
    pair = np.unique(i * len(rank) + j, return_index=True)[1]
    i, j, s = i[pair], j[pair], s[pair]
    best = _best(i, j, s, rank, keep)
    return i[best], j[best], s[best]


def _shards(tree: Tree, total: int, block: int) -> list[range]:
    """The shards of each leaf: neighbouring leaves share one up to `block` rows, a larger leaf has several of its own."""
    out, at, used = [], 0, 0.0
    for share in tree.share:
        rows = total * share
        if used and used + rows > block:
            at, used = at + 1, 0.0
        several = max(1, -(-int(rows) // block))
        out.append(range(at, at + several))
        at, used = (at + several, 0.0) if several > 1 else (at, used + rows)
    return out


def _send(shared, most: int, gap: float, dim: int, keep_ids: int, shards: list[range], parts: int):
    def run(batches):
        tree: Tree = shared.value
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            ids = batch.column(0).take(pa.array(rows)).to_pylist()
            first: dict[bytes, int] = {}
            members: dict[bytes, set[str]] = {}
            for n, (h, i) in enumerate(zip(digest(x), ids)):
                if i is not None:
                    first.setdefault(h, n)
                    members.setdefault(h, set()).add(i)
            hs, at = list(first), np.fromiter(first.values(), np.int64, len(first))
            for begin in range(0, len(hs), 1024):
                some, y = hs[begin : begin + 1024], x[at[begin : begin + 1024]]
                out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
                for h, v, leaves in zip(some, pack(y), tree.visits(unit(y), most, gap)[0]):
                    small = sorted(members[h])[:keep_ids]
                    asked: dict[int, list[int]] = {}
                    for leaf in leaves:
                        for shard in shards[leaf]:
                            asked.setdefault(shard, []).append(leaf)
                    code = int.from_bytes(h[:4], "little")
                    home, own = shards[leaves[0]][code % len(shards[leaves[0]])], code // 65536 % parts
                    sent = [(s, own, True, leaves[0] if s == home else -1, to) for s, to in asked.items()]
                    sent += [(home, part, False, leaves[0], []) for part in range(parts) if part != own]
                    for row in sent:
                        for column, value in zip(out, (*row, h, v, small)):
                            column.append(value)
                kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.string()))
                names = ["shard", "part", "asks", "home", "leaves", "h", "v", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return run


def _top(q: np.ndarray, b: np.ndarray, own: np.ndarray, rank: np.ndarray, state: tuple, keep: int, at: np.ndarray, base: np.ndarray) -> None:
    """Merges the rows b (numbers `base`) into the running lists `state` of the queries q (numbers `at`), exactly: float32 products
    only leave out rows that can't be among the `keep` best. own: the query's number, or -1 if it may be its own neighbour."""
    sims_of, rows_of = state
    sims = unit(q) @ unit(b).T
    floor = sims_of[at, -1]
    better = np.flatnonzero(sims.max(1) >= floor - SLACK)
    if not len(better):
        return
    sims, floor = sims[better], floor[better]
    if len(b) > keep:
        floor = np.maximum(floor, np.partition(sims, len(b) - keep, axis=1)[:, len(b) - keep])
    i, j = np.nonzero(sims >= (floor - SLACK)[:, None])
    other = base[j] != own[better[i]]
    i, j = better[i[other]], j[other]
    s = np.empty(len(i))
    for part in range(0, len(i), 100_000):
        cut = slice(part, part + 100_000)
        s[cut] = np.round(exact_cosine(q[i[cut]], b[j[cut]]), 9)
    old_i, old_k = np.nonzero(rows_of[at] >= 0)
    i, j, s = np.r_[old_i, i], np.r_[rows_of[at][old_i, old_k], base[j]], np.r_[sims_of[at][old_i, old_k], s]
    best = _best(i, j, s, rank, keep)
    i, j, s = i[best], j[best], s[best]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    rows_of[at[i], place], sims_of[at[i], place] = j, s


def _nearest(dim: int, keep: int, block: int = 512):
    def run(t: pa.Table) -> pa.Table:
        groups: dict[bytes, int] = {}
        packed, ids, home, asks, visits = [], [], [], [], []
        for a, leaf, to, h, v, i in zip(*(t.column(c).to_pylist() for c in ("asks", "home", "leaves", "h", "v", "ids"))):
            g = groups.setdefault(h, len(packed))
            if g == len(packed):
                packed.append(v), ids.append(i), home.append(leaf), asks.append(a), visits.append(to)
            else:
                ids[g] = sorted({*ids[g], *i})[:keep]
        x = unpack(packed, dim)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(np.array([i[0] for i in ids]), kind="stable")] = np.arange(len(ids))
        own = np.array([-1 if len(i) > 1 else n for n, i in enumerate(ids)])
        state = np.full((len(ids), keep), -2.0), np.full((len(ids), keep), -1, np.int64)
        home, askers = np.array(home), {}
        for n, to in enumerate(visits):
            for leaf in to:
                askers.setdefault(leaf, []).append(n)
        for leaf, queries in sorted(askers.items()):
            base, queries = np.flatnonzero(home == leaf), np.array(queries)
            for b in range(0, len(base), 8192):
                some = base[b : b + 8192]
                for q in range(0, len(queries), block):
                    at = queries[q : q + block]
                    _top(x[at], x[some], own[at], rank, state, keep, at, some)
        hs, near = [], []
        for n, h in enumerate(groups):
            if asks[n]:
                found = [(-s, i) for s, g in zip(state[0][n].tolist(), state[1][n].tolist()) if g >= 0 for i in ids[g]]
                hs.append(h), near.append([{"far": f, "id": i} for f, i in sorted(found)[:keep]])
        return pa.table([pa.array(hs, pa.binary()), pa.array(near, NEAR_TYPE)], ["h", "near"])

    return run


def _members(dim: int):
    def run(batches):
        for batch in batches:
            rows, x = matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)).cast(pa.string()), pa.array(digest(x), pa.binary())], ["id", "h"]
            )

    return run


def similar_vectors(
    df: DataFrame,
    id_col: str = "question_id",
    vector: str = "embedding",
    k: int = 10,
    least: float | None = None,
    dim: int = 384,
    recall: float = 0.992,
    block: int | None = None,
    part: int = 60000,
    **fitting,
) -> DataFrame:
    """Neighbour lists: id, neighbour, similarity, rank (1..k); least: only of those with similarity >= least."""
    df = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector).alias("embedding"))
    spark = df.sparkSession
    how = ({"both": False, "leaf_rows": 3000} if least is None else {}) | fitting
    tree, most, gap, _, total = fit(df, "id", "embedding", dim, k, least, recall, **how)
    if tree is None:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    keep = k + 1
    shared = spark.sparkContext.broadcast(tree)
    if least is None:
        shards = _shards(tree, total, block or 40000)
        sent = df.mapInArrow(_send(shared, most, gap, dim, keep, shards, max(1, -(-total // part))), SHARDED)
        found = sent.groupBy("shard", "part").applyInArrow(_nearest(dim, keep), NEAREST)
    else:
        blocks = [max(1, -(-int(total * share * most) // (block or 20000))) for share in tree.share]
        routed = df.mapInArrow(_route(shared, most, gap, dim, keep, blocks), ROUTED)
        found = routed.groupBy("leaf", "block").applyInArrow(_search(dim, least, keep), NEAREST)
    near = F.array_distinct(F.flatten(F.collect_list("near")))  # a pair may meet in several leaves
    lists = found.groupBy("h").agg(near.alias("near")).select("h", F.slice(F.array_sort("near"), 1, keep).alias("near"))
    members = df.mapInArrow(_members(dim), "id string, h binary").where("id IS NOT NULL").distinct()
    own = members.join(lists, "h").select("id", F.slice(F.expr("filter(near, n -> n.id <> id)"), 1, k).alias("near"))
    return own.select("id", F.posexplode("near").alias("p", "n")).select(
        "id", F.col("n.id").alias("neighbour"), (-F.col("n.far")).alias("similarity"), (F.col("p") + 1).alias("rank")
    )


def similar_pairs(df: DataFrame, least: float = 0.8, **how) -> DataFrame:
    """question_id_a < question_id_b: pairs with similarity >= least of which one at least is in the other's list."""
    near = similar_vectors(df, least=least, **how)
    return near.select(
        F.least("id", "neighbour").alias("question_id_a"), F.greatest("id", "neighbour").alias("question_id_b")
    ).distinct()
