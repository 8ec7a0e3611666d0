"""Problem 2: records that differ by small edits.

Method: circulant MinHash. Two permutations of a universe of `SIZE` word codes make every signature
coordinate: the first scatters a record's words, the second is read at that place shifted circularly by k for
coordinate k, so the k coordinates of a word are one contiguous slice. Coordinates are banded; records that
share a band are candidates; a sketch of one bit from each of further coordinates, carried in the band rows, drops most
chance candidates inside the join; exact Jaccard of the word sets decides.

Scale. Records with equal word sets are one representative before any banding (a group of copies that
holds a third of all rows is one row); only 8-byte bands, ids and sketches are shuffled for the join, the word sets
only once more for the exact check. With 5 rows in 50 bands a pair at the threshold 0.6 is missed with probability 0.017,
at 0.65 with 0.002, at 0.7 with 0.0001; the sketch (192 bits) loses less than 0.0001 at the threshold.

Defined results: NULL texts and payloads have no words; a record without any word is similar to none
(the Jaccard similarity of two empty sets isn't defined); payloads that aren't JSON count as one string; rows with a NULL id are
left out and rows of one repeated id count once, with the words of all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.session import cut
from studyloom.llm.canonical import words

SIZE = 1 << 20  # universe of word codes
SEED = 20240229
SKETCH_LONGS = 3

_PI: dict[int, np.ndarray] = {}


def _circle(length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first permutation, windows of `length` consecutive values of the second, wrapped around)."""
    if length not in _PI:
        rng = np.random.default_rng(SEED)
        scatter = rng.permutation(SIZE).astype(np.int32)
        ring = rng.permutation(SIZE).astype(np.int32)
        _PI[length] = scatter, np.lib.stride_tricks.sliding_window_view(np.r_[ring, ring[: length - 1]], length)
    return _PI[length]


def codes(found: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) & (SIZE - 1) for w in found), np.int64, len(found))


def signatures(records: list[list[str]], length: int) -> np.ndarray:
    """Circulant MinHash coordinates, one row for each record with at least one word."""
    scatter, windows = _circle(length)
    out = np.empty((len(records), length), np.int32)
    for n, found in enumerate(records):
        places = scatter[codes(found)]
        np.min(windows[places[:4096]], axis=0, out=out[n])
        for at in range(4096, len(places), 4096):  # very long records in parts
            np.minimum(out[n], windows[places[at : at + 4096]].min(axis=0), out=out[n])
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each record; the band's number is part of it."""
    rng = np.random.default_rng(SEED + 1)
    odd = (rng.integers(0, 1 << 62, (bands, rows), dtype=np.int64) * 2 + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (sig[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64) + np.uint64(0x9E3779B9)) * odd
        x ^= x >> np.uint64(29)
        h = (x * np.uint64(0xBF58476D1CE4E5B9)).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(
            0x94D049BB133111EB
        )
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    return h.view(np.int64)


def sketches(sig: np.ndarray, at: int) -> np.ndarray:
    """One bit of each of 64 * SKETCH_LONGS coordinates, as longs."""
    bits = (sig[:, at : at + 64 * SKETCH_LONGS] & 1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def _sets(batches):
    for batch in batches:
        ids, texts, payloads = (c.to_pylist() for c in batch.columns)
        keep = [n for n, i in enumerate(ids) if i is not None]
        found = [sorted(words(texts[n], payloads[n])) for n in keep]
        keep, found = [n for n, w in zip(keep, found) if w], [w for w in found if w]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[n] for n in keep], pa.string()),
                pa.array([xxhash.xxh3_128_digest("\x1f".join(w)) for w in found], pa.binary()),
                pa.array(found, pa.list_(pa.string())),
            ],
            ["id", "k", "words"],
        )


def _banded(bands: int, rows: int):
    length = bands * rows + 64 * SKETCH_LONGS

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = signatures(part.column(1).to_pylist(), length)
                sketch = sketches(sig, bands * rows)
                keys = band_keys(sig, bands, rows)
                offsets = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                        *(pa.array(np.ascontiguousarray(sketch[:, n])) for n in range(SKETCH_LONGS)),
                    ],
                    ["k", "bands", *(f"s{n}" for n in range(SKETCH_LONGS))],
                )

    return run


def near_classes(
    df: DataFrame,
    id_col: str = "question_id",
    text: str = "text",
    payload: str = "payload",
    least: float = 0.6,
    bands: int = 50,
    rows: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(id, k): the class of equal word sets of each record; (a, b): pairs of different classes, a < b, with
    similarity >= least."""
    df = df.select(*(F.col(c).cast("string").alias(n) for c, n in zip((id_col, text, payload), ("id", "t", "p"))))
    sets = df.mapInArrow(_sets, "id string, k binary, words array<string>")
    classes = cut(sets.groupBy("k").agg(F.first("words").alias("words")))  # used three times: banded, and on both sides of the exact check
    bits = 64 * SKETCH_LONGS
    agree = (1 + least) / 2
    fewest = int(bits * agree - 4 * (bits * agree * (1 - agree)) ** 0.5)
    sketch = ", ".join(f"s{n} long" for n in range(SKETCH_LONGS))
    banded = classes.mapInArrow(_banded(bands, rows), f"k binary, bands array<long>, {sketch}").select(
        "k", *(f"s{n}" for n in range(SKETCH_LONGS)), F.explode("bands").alias("band")
    )
    differ = " + ".join(f"bit_count(a.s{n} ^ b.s{n})" for n in range(SKETCH_LONGS))
    candidates = (
        banded.alias("a")
        .hint("merge")
        .join(banded.alias("b"), F.expr(f"a.band = b.band AND a.k < b.k AND {differ} <= {bits - fewest}"))
        .select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))
        .distinct()
    )
    pairs = (
        candidates.join(classes.select(F.col("k").alias("a"), F.col("words").alias("wa")), "a")
        .join(classes.select(F.col("k").alias("b"), F.col("words").alias("wb")), "b")
        .withColumn("both", F.size(F.array_intersect("wa", "wb")))
        .where(F.col("both") / (F.size("wa") + F.size("wb") - F.col("both")) >= least)
        .select("a", "b")
    )
    return sets.select("id", "k").distinct(), pairs


def near_pairs(df: DataFrame, **how) -> DataFrame:
    """question_id_a < question_id_b: all pairs of records with similarity >= least, equal ones too."""
    members, pairs = near_classes(df, **how)
    a, b = (members.select(F.col("id").alias(f"i{n}"), F.col("k").alias(n)) for n in "ab")
    across = pairs.join(a, "a").join(b, "b").where("ia <> ib")
    within = a.join(b, F.expr("a = b AND ia < ib"))
    ids = ["ia", "ib"]
    return (
        across.select(*ids)
        .union(within.select(*ids))
        .select(F.least(*ids).alias("question_id_a"), F.greatest(*ids).alias("question_id_b"))
        .distinct()
    )


def near_links(df: DataFrame, **how) -> DataFrame:
    """One row for each record: its class of equal word sets, the class's size, and the class's links to others."""
    members, pairs = near_classes(df, **how)
    links = (
        pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("links"))
    )
    sizes = members.groupBy("k").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return (
        members.join(sizes.join(links, "k", "left"), "k")
        .select(F.col("id").alias("question_id"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
