"""Shared machinery of the vector operators: packing, k-means tree, calibration.

Vectors travel as bytes: float16 where every value survives the round trip, else float32, so the
shuffle is never lossy. Similarities are always computed from the exact float32 values in double
precision; float32 products only select the pairs worth computing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 1e-4  # what a float32 product may be off by; only widens the set that is computed exactly


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 matrix) of the usable vectors: `dim` values, all finite, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if not n:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    offsets = column.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    found = values[offsets[:-1][rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim), np.float32)
    fine = np.isfinite(found).all(1) & found.any(1)
    return rows[fine], found[fine]


def pack(x: np.ndarray) -> list[bytes]:
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    same = (half.astype(np.float32) == x).all(1)
    return [half[i].tobytes() if same[i] else x[i].tobytes() for i in range(len(x))]


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim), np.float32)
    short = np.fromiter((len(b) == 2 * dim for b in packed), bool, len(packed))
    if short.any():
        out[short] = np.frombuffer(b"".join(b for b in packed if len(b) == 2 * dim), np.float16).reshape(-1, dim)
    if not short.all():
        out[~short] = np.frombuffer(b"".join(b for b in packed if len(b) != 2 * dim), np.float32).reshape(-1, dim)
    return out


def digest(x: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(row.tobytes()) for row in x]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, float32, by way of double precision."""
    out = np.empty(x.shape, np.float32)
    for at in range(0, len(x), 8192):
        d = x[at : at + 8192].astype(np.float64)
        out[at : at + 8192] = d / np.linalg.norm(d, axis=1, keepdims=True)
    return out


def few(columns: int, cells: int = 1 << 22) -> int:
    """Rows of a matrix of so many columns that stay within `cells` numbers (16 MB)."""
    return max(1, cells // max(1, columns))


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The most similar centre of each row, in pieces of bounded size."""
    step = few(len(centres))
    return np.concatenate([(x[at : at + step] @ centres.T).argmax(1) for at in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine of two float32 matrices, double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def close_pairs(
    q: np.ndarray, b: np.ndarray | None, least: float, block: int = 256
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, base row, cosine rounded to 9 decimals) of all pairs with cosine >= least, in blocks of queries.

    b=None: the rows of q among themselves, each pair once (and each row with itself)."""
    uq, own = unit(q), b is None
    b, ub = (q, uq) if own else (b, unit(b))
    wide = None
    for at in range(0, len(q), block):
        skip = at if own else 0
        i, j = np.nonzero(uq[at : at + block] @ ub[skip:].T >= least - SLACK)
        if own:
            i, j = i[j >= i], j[j >= i]
        j = j + skip
        if len(i) > 0.02 * block * len(b):  # a family of near copies: all at once rather than pair by pair
            if wide is None:
                wide = b.astype(np.float64)
                wide /= np.linalg.norm(wide, axis=1, keepdims=True)
            rows = q[at : at + block].astype(np.float64)
            sim = ((rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ wide.T)[i, j]
        else:
            sim = np.empty(len(i))
            for part in range(0, len(i), 100_000):
                s = slice(part, part + 100_000)
                sim[s] = exact_cosine(q[at + i[s]], b[j[s]])
        sim = np.round(sim, 9)
        keep = sim >= least
        yield i[keep] + at, j[keep], sim[keep]


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit rows; k centres of length 1."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        to = closest(x, centres)
        order = np.argsort(to, kind="stable")
        starts = np.searchsorted(to[order], np.arange(k))
        counts = np.bincount(to, minlength=k)
        full = np.flatnonzero(counts)
        centres[full] = np.add.reduceat(x[order], starts[full], axis=0)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = x[rng.choice(len(x), len(empty), replace=False)]
        length = np.linalg.norm(centres, axis=1, keepdims=True)
        centres /= np.where(length > 0, length, 1)
    return centres


class Tree:
    """Hierarchical k-means tree over unit vectors.

    `centres` holds one row per node but the root; `children[n]` the nodes below node n (the root is
    -1); `leaf[n]` the leaf number or -1. `share` is each leaf's share of the sample it was fitted on.
    `lift[n]` is what leaves below node n are closer to a row than n itself (a high quantile over the sample), so that bins of
    different depth compare in the queue; 0 at leaves.
    """

    def __init__(self, sample: np.ndarray, leaves: int, branching: int = 16, seed: int = 7):
        self.dim, self.children, self.leaf, self.share, self.lift = sample.shape[1], {}, [], [], []
        rows: list[np.ndarray] = []
        cap = max(1, -(-len(sample) // max(1, leaves)))

        def grow(node: int, x: np.ndarray, depth: int) -> np.ndarray:
            """Each row's similarity to its best leaf below."""
            want = min(branching, -(-len(x) // cap))
            if want < 2 or depth > 12:
                below = []
            else:
                centres = kmeans(x, want, seed + len(rows))
                to = closest(x, centres)
                below = [(centres[k], x[to == k]) for k in range(want) if (to == k).any()]
            if len(below) < 2:
                if node >= 0:
                    self.leaf[node] = len(self.share)
                self.share.append(len(x) / max(1, len(sample)))
                return x @ rows[node] if node >= 0 else np.zeros(len(x))
            self.children[node] = []
            for centre, part in below:
                rows.append(centre)
                self.leaf.append(-1)
                self.lift.append(0.0)
                self.children[node].append(len(rows) - 1)
            reached = [(grow(c, part, depth + 1), part) for c, (_, part) in zip(list(self.children[node]), below)]
            if node >= 0:
                gains = np.concatenate([best - part @ rows[node] for best, part in reached])
                self.lift[node] = float(np.quantile(gains, 0.95))
            return np.concatenate([best for best, _ in reached])

        grow(-1, sample, 0)
        self.centres = np.array(rows, np.float32).reshape(-1, self.dim)
        # children of a node stand together, so that opening it is one small product
        self.spans = {n: (c[0], c[-1] + 1) for n, c in self.children.items()}

    @property
    def leaves(self) -> int:
        return len(self.share)

    def visits(self, x: np.ndarray, most: int, gap: float = -1.0) -> tuple[list[list[int]], list[list[float]]]:
        """(leaves, their distances in the queue) of each unit row, best bin first: the `most` first ones, the first of which is its home,
        and one more if it is at most `gap` less similar than the last of them. Only opened nodes are compared, so a row's work
        grows with its visits and the tree's depth, not with its leaves."""
        if not self.children:
            return [[0]] * len(x), [[0.0]] * len(x)
        out, keys, leaf, spans, centres = [], [], self.leaf, self.spans, self.centres
        lift = np.array(self.lift, np.float32)
        first, end = spans[-1]
        for at in range(0, len(x), 4096):
            for row, sims in zip(x[at : at + 4096], (-(x[at : at + 4096] @ centres[first:end].T + lift[first:end])).tolist()):
                queue = list(zip(sims, range(first, end)))
                heapq.heapify(queue)
                seen: list[int] = []
                far: list[float] = []
                while queue:
                    key, node = heapq.heappop(queue)
                    if len(seen) >= most and (len(seen) > most or key > far[-1] + gap):
                        break
                    if leaf[node] >= 0:
                        seen.append(leaf[node])
                        far.append(max(key, far[-1]) if far else key)
                    else:
                        a, b = spans[node]
                        for item in zip((-(centres[a:b] @ row + lift[a:b])).tolist(), range(a, b)):
                            heapq.heappush(queue, item)
                out.append(seen)
                keys.append(far)
        return out, keys


def calibrated(tree: Tree, pairs: tuple[np.ndarray, np.ndarray], recall: float, both: bool) -> tuple[int, float, float]:
    """(leaf visits of a row, gap within which one more is made, recall reached): visits are widened until the true pairs are met often enough.

    both: a pair is met in any leaf that both rows visit; else only in the second row's home."""
    a, b = pairs
    tried = 4
    while True:
        tried = min(2 * tried, tree.leaves)
        (to_a, far_a), (to_b, far_b) = tree.visits(a, tried), tree.visits(b, tried if both else 1)
        if both:
            # with n visits each a pair is met if some leaf is among the first n of both
            place = [{leaf: n for n, leaf in enumerate(v)} for v in to_b]
            met = [min((max(n, p[leaf]) for n, leaf in enumerate(v) if leaf in p), default=tried) for v, p in zip(to_a, place)]
        else:
            met = [v.index(h[0]) if h[0] in v else tried for v, h in zip(to_a, to_b)]
        first = np.array(met)
        reached = [float((first < n).mean()) for n in range(1, tried + 1)]
        if reached[-1] >= recall or tried == tree.leaves:
            break
    most = next((n for n, r in enumerate(reached, 1) if r >= recall), tried)
    if most == 1:
        return 1, -1.0, reached[0]
    # one visit less, but for rows whose last one is hardly worse than the one before
    least = most - 1

    def step(far: list[list[float]]) -> np.ndarray:
        return np.array([v[least] - v[least - 1] if len(v) > least else np.inf for v in far])

    gap_a = step(far_a)
    gap_b = step(far_b) if both else np.full(len(b), -np.inf)
    for gap in np.quantile(gap_a[np.isfinite(gap_a)], np.linspace(0.1, 0.9, 9)) if np.isfinite(gap_a).any() else ():
        now = [_met(v[: least + (g <= gap)], w[: least + (h <= gap)] if both else w) for v, w, g, h in zip(to_a, to_b, gap_a, gap_b)]
        if (share := float(np.mean(now))) >= recall:
            return least, float(gap), share
    return most, -1.0, reached[most - 1]


def _met(a: list[int], b: list[int]) -> bool:
    return not set(a).isdisjoint(b)


SAMPLE = 131_072  # rows that a tree or pivots are fitted on at most: 100 MB on the driver as they are sent
PAIRS = 2000  # true pairs that a calibration needs: at a target of 0.999, two missed ones


def probed(df: DataFrame, id_col: str, vector: str, probes: int, most: int, total: int, salt: int, k: int, least: float, dim: int, enough: int = PAIRS):
    """True pairs of sampled rows, the sample widened up to `most` rows until `enough` are found; None where they are too few to calibrate on,
    unless every row was asked: then they are all there are."""
    while True:
        queries = collect_matrix(sampled(df, id_col, vector, probes, total, salt), vector, dim)
        pairs = true_neighbours(df, id_col, vector, queries, k, least, dim) if len(queries) else (queries, queries)
        if len(pairs[0]) >= enough or probes >= total and len(pairs[0]):
            return pairs
        if probes >= min(most, total):
            return None
        short = enough / max(1, len(pairs[0]))  # what the sample lacks, with some to spare
        probes = int(min(most, total, max(2 * probes, 1.25 * short * probes)))


def sampled(df: DataFrame, key: str, vector: str, n: int, total: int, salt: int) -> DataFrame:
    """A repeatable sample of about n of `total` rows, by a hash of key and vector: bounded by n plus its spread."""
    if total <= n:
        return df
    share = F.pmod(F.xxhash64(F.col(key), F.col(vector), F.lit(salt)), F.lit(1_000_000))
    return df.where(share < int(1_000_000 * n / total) + 1)


def collect_matrix(df: DataFrame, column: str, dim: int) -> np.ndarray:
    """The usable vectors of a bounded frame on the driver."""
    got = df.select(column).mapInArrow(_packer(dim), "v binary").toArrow()
    return unpack(sorted(got.column(0).to_pylist()), dim)  # the order of arrival must not matter


def _packer(dim: int):
    def run(batches):
        for batch in batches:
            _, x = matrix(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array(pack(x), pa.binary())], ["v"])

    return run


def _first(owner: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest similarities of each owner."""
    order = np.lexsort((-sim, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    return order[rank < k]


def true_neighbours(
    df: DataFrame, id_col: str, vector: str, queries: np.ndarray, k: int, least: float, dim: int
) -> tuple[np.ndarray, np.ndarray]:
    """Brute force for calibration: for each of a bounded set of query vectors its k most similar rows of
    all of df with cosine >= least, another vector than itself: partial top k by task, merged on the executors."""
    known = df.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q = unit(known.value)
        i, s, x = np.empty(0, np.int64), np.empty(0, np.float32), np.empty((0, dim), np.float32)
        for batch in batches:
            _, new = matrix(batch.column(0), dim)
            for at in range(0, len(new), 2048):
                part = new[at : at + 2048]
                sims = q @ unit(part).T
                n, j = np.nonzero((sims >= least) & (sims < 1 - 1e-6))
                if not len(n):
                    continue
                # only the k best of a query in this batch are kept, then those of all so far
                first = _first(n, sims[n, j], k)
                n, j = n[first], j[first]
                i, s, x = np.r_[i, n], np.r_[s, sims[n, j]], np.concatenate([x, part[j]])
                first = _first(i, s, k)
                i, s, x = i[first], s[first], x[first]
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(-s.astype(np.float64)), pa.array(pack(x), pa.binary())],
                ["q", "far", "v"],
            )

    return _merged(df.select(vector).mapInArrow(run, "q int, far double, v binary"), queries, k, dim)


def _merged(found: DataFrame, queries: np.ndarray, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query over all tasks, merged on the executors: the driver gets at most k rows for each query."""
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "v"))), 1, k).alias("b"))
    got = best.orderBy("q").select("q", F.explode("b.v").alias("v")).toArrow()
    x = unpack(got.column("v").to_pylist(), dim)
    return unit(queries)[got.column("q").to_numpy()], unit(x) if len(x) else x


def nearest_rows(df: DataFrame, vector: str, queries: np.ndarray, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """true_neighbours without a floor: each query's k most similar rows of all of df, however far. A running top k by task, merged
    before the driver, which gets k rows for each query."""
    known = df.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q = unit(known.value)
        s, x = np.empty((len(q), 0), np.float32), np.empty((0, dim), np.float32)
        held = np.empty((len(q), 0), np.int64)
        for batch in batches:
            _, new = matrix(batch.column(0), dim)
            for at in range(0, len(new), 2048):
                part = new[at : at + 2048]
                sims = q @ unit(part).T
                sims[sims >= 1 - 1e-6] = -2  # another vector than itself
                s = np.concatenate([s, sims], axis=1)
                held = np.concatenate([held, np.broadcast_to(np.arange(len(x), len(x) + len(part)), sims.shape)], axis=1)
                x = np.concatenate([x, part])
                if s.shape[1] > k:
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    s, held = np.take_along_axis(s, best, 1), np.take_along_axis(held, best, 1)
                used, held = np.unique(held, return_inverse=True)
                x, held = x[used], held.reshape(s.shape)
        i, n = np.nonzero(s > -2)
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], n[at : at + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.astype(np.int32)), pa.array(-s[a, b].astype(np.float64)), pa.array(pack(x[held[a, b]]), pa.binary())],
                ["q", "far", "v"],
            )

    return _merged(df.select(vector).mapInArrow(run, "q int, far double, v binary"), queries, k, dim)
