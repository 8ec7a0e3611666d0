"""Exact duplicates, identity of matching questions, and clusters by nearest earlier vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import natural_key, normal, single_spaced, text_hash
from studyloom.schemas import PAYLOAD
from studyloom.session import cut

SCOPE = ("class", "subject", "chapter", "topic")
BOOK = ("class", "subject", "source_file")


def pair_identity(payload: Column | str) -> Column:
    """Pairs of a matching question as a JSON list in one fixed order; white space collapsed, case kept."""
    pairs = F.map_entries(F.from_json(payload, PAYLOAD)["pairs"])
    return F.to_json(F.array_sort(F.transform(pairs, lambda e: F.array(single_spaced(e["key"]), single_spaced(e["value"])))))


def identity_hash(questions: DataFrame) -> DataFrame:
    """question_id, hash: of the normal text, or of the pairs of a matching question, marked as such."""
    h = F.when(F.col("type") == "matching", F.concat(F.lit("matching-v2:"), F.sha2(pair_identity("payload"), 256))).otherwise(text_hash("text"))
    return questions.withColumn("identity", h)


def exact_duplicates(questions: DataFrame) -> DataFrame:
    """question_id, duplicate_of: the first arrival in the scope with the same hash (NULL for that one itself).

    A partial aggregation and a join on the aggregated side: a hash that a third of all rows share fills no task."""
    q = identity_hash(questions).select("question_id", *SCOPE, "identity", "created_at")
    first = q.groupBy(*SCOPE, "identity").agg(F.min_by("question_id", F.struct("created_at", "question_id")).alias("first"))
    joined = q.join(first, [*SCOPE, "identity"])
    return joined.select("question_id", F.when(F.col("first") != F.col("question_id"), F.col("first")).alias("duplicate_of"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last version of each key."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision inside the JVM; 0 where a length is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def nearest_earlier(
    df: DataFrame, block: list[str], id_col: str, order: list[str], vector: str, least: float, dim: int, rows: int = 2048, slice_rows: int = 16384
) -> DataFrame:
    """id, parent, similarity: for each row of a block its most similar earlier row, if at least `least`; equal ones: the smaller id. A row with a
    NULL among the block columns has none.

    A block of more than `slice_rows` rows is cut into slices, and each slice is compared with each slice in a task of its own, by
    matrix products in pieces of `rows`: a task holds two slices, however large the block. The number of pairs is what the definition asks for."""
    good = F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v))
    ordered = df.where(good).select(*block, F.struct(*order, F.col(id_col).cast("string").alias("_id")).alias("_o"), F.col(vector).cast("array<float>").alias("_v"))
    sizes = ordered.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    slices = F.ceil(F.col("_n") / slice_rows).cast("int")
    placed = ordered.join(sizes, block).select(
        *block, "_o", "_v", slices.alias("_k"), F.pmod(F.xxhash64("_o._id"), slices).cast("int").alias("_s")
    )
    later = placed.select(*block, F.col("_s").alias("_a"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_b"), "_o", "_v", F.lit(True).alias("_asks"))
    held = placed.select(*block, F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_a"), F.col("_s").alias("_b"), "_o", "_v", F.lit(False).alias("_asks"))

    def run(t: pa.Table) -> pa.Table:
        keys = t.column("_o").combine_chunks()
        names = [keys.type.field(n).name for n in range(keys.type.num_fields)]
        t = pa.table([*(keys.field(n) for n in names), t.column("_v"), t.column("_asks")], [*names, "_v", "_asks"])
        t = t.sort_by([(c, "ascending") for c in names])
        ids, asks = t.column("_id").to_pylist(), t.column("_asks").to_numpy()
        x = np.array(t.column("_v").to_pylist(), np.float64).reshape(-1, dim)
        norm = np.linalg.norm(x, axis=1)
        fine = np.isfinite(norm) & (norm > 0)
        # a row that both asks and is held stands twice, one after the other: it may not be its own parent
        q, y = np.flatnonzero(asks & fine), np.flatnonzero(~asks & fine)
        out: tuple[list, ...] = ([], [], [])
        unit = x / np.where(norm > 0, norm, 1)[:, None]
        for at in range(0, len(q), rows):
            part = q[at : at + rows]
            before = np.searchsorted(y, part)  # rows held that stand before each
            top = int(before.max(initial=0))
            if not top:
                continue
            sims = np.round(unit[part] @ unit[y[:top]].T, 9)
            sims[np.arange(top)[None, :] >= before[:, None]] = -2
            for n in range(len(part)):
                if before[n] and ids[y[before[n] - 1]] == ids[part[n]]:
                    sims[n, before[n] - 1] = -2
                best = float(sims[n].max())
                if best >= least:
                    same = np.flatnonzero(sims[n] == best)
                    for column, value in zip(out, (ids[part[n]], min(ids[y[m]] for m in same), best)):
                        column.append(value)
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["id", "parent", "similarity"])

    found = later.unionByName(held).groupBy(*block, "_a", "_b").applyInArrow(run, "id string, parent string, similarity double")
    best = F.min_by(F.struct("parent", "similarity"), F.struct((-F.col("similarity")).alias("far"), "parent")).alias("b")
    return found.groupBy("id").agg(best).select("id", "b.*")


def forest_roots(parents: DataFrame, most: int = 40) -> DataFrame:
    """id, root by pointer jumping; each doubling is checkpointed, and it ends when nothing moves."""
    p = cut(parents.select("id", F.col("parent").alias("root")))
    for _ in range(most):
        up = p.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = cut(p.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        p = moved.select("id", "root")
        if not moved.where("moved").limit(1).count():
            break
    return p


def clusters(questions: DataFrame, least: float = 0.9, dim: int = 384) -> DataFrame:
    """question_id, cluster: each row joins the cluster of its most similar earlier row of its block, or starts its own.

    MCQ and fill_in_blank compare with each other, matching only with itself."""
    q = questions.dropDuplicates(["question_id"]).withColumn("kind", F.when(F.col("type") == "matching", "matching").otherwise("single"))
    parents = nearest_earlier(q, ["class", "topic", "difficulty", "kind"], "question_id", ["created_at"], "embedding", least, dim)
    roots = forest_roots(parents)
    return (
        q.select("question_id").join(roots, F.col("question_id") == F.col("id"), "left").select("question_id", F.coalesce("root", "question_id").alias("cluster"))
    )


def topic_order(chunks: DataFrame) -> DataFrame:
    """class, subject, source_file, topic, topic_number and its ordinal: the place of each topic in its book, from 0. Unnumbered ones come first, then natural order."""
    number = F.coalesce(F.col("topic_number"), F.lit("")).alias("topic_number")
    topics = chunks.select(*BOOK, F.coalesce("topic", F.lit("")).alias("topic"), number).distinct()
    by = Window.partitionBy(*BOOK).orderBy(natural_key("topic_number"), "topic", "topic_number")
    return topics.withColumn("ordinal", F.row_number().over(by) - 1)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """The first 16 hex digits of SHA-1 over class, subject, book, the topic's ordinal in it and the chunk's number."""
    rows = chunks.select("chunk_id", *BOOK, F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("topic_number", F.lit("")).alias("topic_number"), "chunk_index").distinct()
    key = F.concat_ws("|", *BOOK, F.col("ordinal").cast("string"), F.col("chunk_index").cast("string"))
    return rows.join(topic_order(chunks), [*BOOK, "topic", "topic_number"]).select("chunk_id", "ordinal", F.substring(F.sha1(key), 1, 16).alias("made_id"))


def neighbours_in_topic(questions: DataFrame) -> DataFrame:
    """Each question with the one before it in its topic, by arrival, and the similarity of their vectors."""
    by = Window.partitionBy(*SCOPE).orderBy("created_at", "question_id")
    good = questions.where("size(embedding) = 384 AND NOT exists(embedding, v -> v IS NULL OR isnan(v)) AND exists(embedding, v -> v <> 0)")
    pairs = good.select(
        "question_id", F.lag("question_id").over(by).alias("before"), "embedding", F.lag("embedding").over(by).alias("e"), "text", F.lag("text").over(by).alias("t")
    ).where("before IS NOT NULL")
    return pairs.select("question_id", "before", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("similarity"), normal("text").eqNullSafe(normal("t")).alias("same_text"))


def spread(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, 95th percentile and maximum, exact."""
    at = F.percentile(column, F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)))).alias("q")
    return df.agg(F.min(column).alias("low"), at, F.max(column).alias("high"), F.count(column).alias("n")).select(
        "n", "low", *(F.round(F.col("q")[i], 6).alias(a) for i, a in enumerate(("p25", "median", "p75", "p95"))), "high"
    )


def sweep(pairs: DataFrame, near: Column, column: str = "similarity") -> DataFrame:
    """The first threshold with the fewest errors: near pairs below it and distinct ones at or above it.

    Pairs are counted by rounded similarity first; the running sums then go over at most 2,001 values (three decimals), whatever the pairs."""
    by_value = pairs.select(F.round(column, 3).alias("t"), near.cast("int").alias("y")).groupBy("t").agg(
        F.sum("y").alias("near"), F.sum(1 - F.col("y")).alias("other")
    )
    by = Window.partitionBy().orderBy("t")
    missed = F.coalesce(F.sum("near").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    merged = F.sum("other").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return by_value.select("t", missed.alias("missed"), merged.alias("merged")).orderBy(F.col("missed") + F.col("merged"), "t").limit(1)


def at_thresholds(pairs: DataFrame, near: Column, thresholds: tuple[float, ...], column: str = "similarity") -> DataFrame:
    """t, caught, merged: near pairs and distinct ones at or above each fixed threshold, in one aggregation."""
    sums = [F.struct(F.lit(t).alias("t"), F.sum((near & (F.col(column) >= t)).cast("int")).alias("caught"), F.sum((~near & (F.col(column) >= t)).cast("int")).alias("merged")) for t in thresholds]
    return pairs.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("a")).select("a.*")
