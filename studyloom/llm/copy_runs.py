"""Problem 7: duplicates hidden by formatting differences.

Method: canonical records are range-partitioned and externally sorted by (full key, id) with Spark's
sort, which spills, then each partition is scanned once: adjacent rows with equal full keys are a run.

Scale. The range bounds are on (key, id), so a key that holds a third of all rows spreads over
several partitions in id order instead of filling one. A run can therefore continue over partition ends: the
scan marks the rows of a partition's first run, and one edge row per partition (at most as many rows as there are
partitions, which is the proven bound for broadcasting them) tells where that run began. Counts are exact.

Defined results: a NULL type, text or payload equals only NULL; payloads that aren't JSON are
compared by their letters and digits; rows without an id, and repeated rows of one id, count once per id (NULL: not at all);
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.canonical import record
from studyloom.session import cut

EDGE = "part int, first boolean, key string, id string, kept string"


def _keys(batches):
    for batch in batches:
        ids, kinds, texts, payloads = (c.to_pylist() for c in batch.columns)
        keep = [n for n, i in enumerate(ids) if i is not None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([record(kinds[n], texts[n], payloads[n]) for n in keep], pa.string()),
                pa.array([ids[n] for n in keep], pa.string()),
            ],
            ["key", "id"],
        )


def _scan(batches):
    """Each row with the smallest id of its run so far, and whether the run is the partition's first."""
    key = kept = last = None
    first = False
    began = False
    for batch in batches:
        parts, keys, ids = (c.to_pylist() for c in batch.columns)
        out: tuple[list, ...] = ([], [], [], [], [])
        for p, k, i in zip(parts, keys, ids):
            if k != key or not began:
                first, key, kept, last, began = not began, k, i, None, True
            if i != last:  # a repeated row of one id
                for column, value in zip(out, (p, first, k if first else None, i, kept)):
                    column.append(value)
            last = i
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out[0], pa.int32()),
                pa.array(out[1], pa.bool_()),
                pa.array(out[2], pa.string()),
                pa.array(out[3], pa.string()),
                pa.array(out[4], pa.string()),
            ],
            ["part", "first", "key", "id", "kept"],
        )


def _edges(batches):
    """One row per partition: its first key and id, and its last key with the smallest id of that key's run here."""
    low = None
    key = kept = part = None
    for batch in batches:
        for p, k, i in zip(*(c.to_pylist() for c in batch.columns)):
            if low is None:
                low, part = (k, i), p
            if k != key:
                key, kept = k, i
    if low is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *(pa.array([x], pa.string()) for x in (low[0], key, kept))],
            ["part", "low", "high", "kept"],
        )


def copy_runs(
    df: DataFrame,
    id_col: str = "question_id",
    kind: str = "type",
    text: str = "text",
    payload: str = "payload",
    partitions: int | None = None,
) -> DataFrame:
    """kept_id, id of every record: kept_id is the smallest id of the records that are the same as it."""
    df = df.select(*(F.col(c).cast("string").alias(n) for c, n in zip((id_col, kind, text, payload), "iktp")))
    spark = df.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.mapInArrow(_keys, "key string, id string")
    # written out once: the scan and the edges must see the same partitions
    ranged = cut(
        keyed.repartitionByRange(n, "key", "id")
        .sortWithinPartitions("key", "id")
        .select(F.spark_partition_id().alias("part"), "key", "id")
    )
    edges = ranged.mapInArrow(_edges, "part int, low string, high string, kept string")
    # where the first run of a partition continues one that began before: the earliest partition that ends in the key
    # knows its smallest id
    began = (
        edges.alias("a")
        .join(
            F.broadcast(edges.select(F.col("part").alias("p"), F.col("high"), F.col("kept").alias("k"))).alias("b"),
            F.expr("a.low = b.high AND b.p < a.part"),
        )
        .groupBy("part")
        .agg(F.min("k").alias("began"))
    )
    rows = ranged.mapInArrow(_scan, EDGE)
    return (
        rows.join(F.broadcast(began), "part", "left")
        .select(F.expr("CASE WHEN first THEN coalesce(began, kept) ELSE kept END").alias("kept_id"), "id")
    )


def copies(df: DataFrame, **columns) -> DataFrame:
    """kept_id, copy_id: every record but the kept one of its group."""
    return (
        copy_runs(df, **columns).where("kept_id <> id").select("kept_id", F.col("id").alias("copy_id")).distinct()
    )


def representatives(df: DataFrame, **columns) -> DataFrame:
    """kept_id and the exact number of records it stands for."""
    return copy_runs(df, **columns).groupBy("kept_id").agg(F.count(F.lit(1)).alias("copies"))
