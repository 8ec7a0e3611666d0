"""Looking up chunks and questions: scopes, quarantine of repaired sources, similarity within a filter, greedy picks over lines."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import normal, order_key
from studyloom.operators.dedup import clusters, cosine, identity_hash
from studyloom.schemas import PAYLOAD

TOPIC = ("class", "subject", "chapter", "topic")


def chunk_text(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text of each asked chunk, NULL for an unknown one; rows of one chunk sent again give one."""
    one = chunks.groupBy("chunk_id").agg(F.min_by("text", F.struct("chunk_index", "text")).alias("text"))
    return ids.select("chunk_id").distinct().join(one, "chunk_id", "left")


def grounding(chunks: DataFrame, n: int = 5) -> DataFrame:
    """The first n chunks of each topic in the books' order."""
    rows = chunks.select(*TOPIC, "source_file", "topic_number", "chunk_index", "chunk_id").dropDuplicates(["chunk_id"])
    by = Window.partitionBy(*TOPIC).orderBy("source_file", F.coalesce("topic_number", F.lit("")), "chunk_index", "chunk_id")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select(*TOPIC, "chunk_id", "place")


def quarantine(questions: DataFrame, repairs: DataFrame, revision: str) -> DataFrame:
    """question_id, needs_review: its chunk was repaired and the question isn't of the current revision (NULL is not)."""
    fixed = repairs.where("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("source_chunk_id")).distinct().withColumn("fixed", F.lit(True))
    own = F.get_json_object("payload", "$.source_revision")
    return questions.join(fixed, "source_chunk_id", "left").select(
        "question_id", (F.coalesce("fixed", F.lit(False)) & ~own.eqNullSafe(F.lit(revision))).alias("needs_review")
    )


def intake(questions: DataFrame, clustered: bool = False) -> DataFrame:
    """Disposition of each row in order of arrival: exact_duplicate of an earlier one in its scope, or accepted.

    Old hashes of matching questions are made again from their pairs, so rows from before that form still meet. Accepted rows have the
    cluster of the most similar earlier accepted row of their block, or their own."""
    q = identity_hash(questions)
    key = F.struct("batch_no", "created_at", "question_id")
    first = q.groupBy(*TOPIC, "identity").agg(F.min_by("question_id", key).alias("first"))
    stored = F.lower("text_hash")
    told = q.join(first, [*TOPIC, "identity"]).select(
        "question_id",
        F.when(F.col("first") == F.col("question_id"), "accepted").otherwise("exact_duplicate").alias("reason"),
        F.when(F.col("first") != F.col("question_id"), F.col("first")).alias("duplicate_of"),
        stored.eqNullSafe(F.col("identity")).alias("hash_is_current"),
    )
    if not clustered:
        return told
    taken = questions.join(told.where("reason = 'accepted'").select("question_id"), "question_id", "left_semi")
    return told.join(clusters(taken), "question_id", "left")


def nearest(queries: DataFrame, rows: DataFrame, block: str, id_col: str, vector: str, k: int, parts: int = 8) -> DataFrame:
    """The k most similar rows of each query within its block (a filter that must match), exact.

    A block's rows are spread over `parts` parts, to each of which its queries go; there matrix products leave the k best of each query, which are
    merged at the end. Rows without a whole vector take no part; a vector of length 0 is similar to none (0)."""
    kind = dict(rows.dtypes)[id_col]
    good = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda v: v.isNull() | F.isnan(v))
    part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")
    r = rows.where(good).select(F.col(block).alias("block"), part.alias("part"), F.col(id_col).alias("row_id"), F.col(vector).alias("v"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    q = queries.where(good).select(F.col(block).alias("block"), everywhere, F.col(id_col).alias("query_id"), F.col(vector).alias("v"))

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        if len(asked) and len(held):
            ids, own = held.column("row_id").to_pylist(), asked.column("query_id").to_pylist()
            y, x = (np.array(t.column("v").to_pylist(), np.float64) for t in (held, asked))
            y, x = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (y, x))
            order = sorted(range(len(ids)), key=lambda n: ids[n])
            y, ids = y[order], [ids[n] for n in order]  # equals rank by the smaller id
            for at in range(0, len(x), 512):
                sims = np.round(x[at : at + 512] @ y.T, 6)
                for n, line in enumerate(sims):
                    first = np.argpartition(-line, min(k, len(line) - 1))[: k + 1]
                    for j in np.flatnonzero(line >= line[first].min()):
                        if ids[j] != own[at + n]:
                            for column, value in zip(out, (own[at + n], ids[j], float(line[j]))):
                                column.append(value)
        names = ["query_id", "row_id", "similarity"]
        kinds = [asked.schema.field("query_id").type, held.schema.field("row_id").type, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names)

    found = q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInArrow(best, f"query_id {kind}, row_id {kind}, similarity double")
    by = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def greedy_lines(candidates: DataFrame, most: int = 25) -> DataFrame:
    """Picks for the lines of a request in their order: each line takes its first `count` clusters that no earlier line took.

    candidates: request_id, line_no, count, question_id, cluster, place. A request has at most `most` items, so each line only needs
    its first count + most clusters, each by its first question: the walk's input is bounded for any bank."""
    first = F.min_by(F.struct("question_id", "count"), "place").alias("f")
    one = candidates.groupBy("request_id", "line_no", "cluster").agg(first, F.min("place").alias("place")).select("request_id", "line_no", "cluster", "place", "f.*")
    by = Window.partitionBy("request_id", "line_no").orderBy("place")
    near = one.withColumn("n", F.row_number().over(by)).where(F.col("n") <= F.col("count") + most)

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        out = []
        for line, rows in frame.sort_values(["line_no", "place"]).groupby("line_no", sort=True):
            taken: set = set()
            for r in rows.itertuples():
                if len(taken) >= r.count_:
                    break
                if r.cluster not in used and r.cluster not in taken:
                    taken.add(r.cluster)
                    out.append((key[0], int(line), r.question_id, r.cluster))
            used |= taken
        return pd.DataFrame(out, columns=["request_id", "line_no", "question_id", "cluster"])

    return (
        near.withColumnRenamed("count", "count_")
        .groupBy("request_id")
        .applyInPandas(walk, "request_id string, line_no int, question_id string, cluster string")
    )


def hashed_embedding(text: Column | str, dim: int = 64) -> Column:
    """A stand-in encoder: signed word hashes, unit length. Any function of texts to vectors fits its place."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype("float32"))
        return pd.Series(out)

    return encode(text)


def review(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Each stored answer with its stored verdict and whether an explanation is there; nothing is graded again."""
    q = questions.select("question_id", "type", (F.coalesce(F.trim("explanation"), F.lit("")) != "").alias("explained"))
    return answers.dropDuplicates(["attempt_id", "question_id"]).join(q, "question_id").select("attempt_id", "question_id", "type", "is_correct", "explained")


def answered(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Whether an answer says anything: matching needs a pair, a blank needs a letter."""
    a = answers.dropDuplicates(["attempt_id", "question_id"]).join(questions.select("question_id", "type"), "question_id")
    text = F.get_json_object(F.concat(F.lit('{"a":'), "user_answer", F.lit("}")), "$.a")
    pairs = F.size(F.map_keys(F.from_json("user_answer", "map<string, string>")))
    says = (
        F.when(F.col("user_answer").isNull(), False)
        .when(F.col("type") == "matching", F.coalesce(pairs > 0, F.lit(False)))
        .when(F.col("type") == "fill_in_blank", F.coalesce(normal(text) != "", F.lit(False)))
        .otherwise(True)
    )
    return a.select("attempt_id", "question_id", "type", says.alias("answered"))


def gate(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Drafts that may enter the bank: allowed values, source chunk in scope and unchanged (SHA-256 of its text), payload readable."""
    c = chunks.groupBy("chunk_id").agg(F.min(F.sha2("text", 256)).alias("digest"), F.min("class").alias("chunk_class"))
    j = candidates.join(c, candidates["source_chunk_id"] == c["chunk_id"], "left")
    reason = (
        F.when(~F.coalesce(F.col("difficulty").isin("easy", "medium", "hard"), F.lit(False)), "difficulty")
        .when(F.col("digest").isNull(), "source unknown")
        .when(F.col("chunk_class") != F.col("class"), "source out of scope")
        .when(F.from_json("payload", PAYLOAD)["question"].isNull(), "payload")
        .otherwise("")
    )
    return j.select("question_id", reason.alias("reason"))


def pick_order(df: DataFrame, key: list[str], id_col: str, seed: str, k: int) -> DataFrame:
    """A uniform sample of at most k rows of each key in a seeded order."""
    by = Window.partitionBy(*key).orderBy(order_key(seed, F.col(id_col)))
    return df.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def resilient(calls, retries: int = 2, backoff: float = 1.0, fallback=None, sleep=lambda s: None):
    """The result of the first call that works: the primary with `retries` more tries and waits of backoff * 2**n, then a fallback once."""
    error: Exception | None = None
    for n in range(retries + 1):
        try:
            return calls()
        except Exception as e:
            error = e
            if n < retries:
                sleep(backoff * 2**n)
    if fallback is not None:
        return fallback()
    raise error


def access(calls: DataFrame, attempts: DataFrame) -> DataFrame:
    """calls (attempt_id, caller) with `access`: not found, forbidden (another user's) or ok. attempts: attempt_id, owner, each once."""
    told = F.when(F.col("owner").isNull(), "not found").when(F.col("owner") != F.col("caller"), "forbidden").otherwise("ok")
    return calls.join(attempts, "attempt_id", "left").withColumn("access", told).drop("owner")


def submitted(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Of each attempt: its answers, those whose question the bank doesn't have (an error of the request), and the right ones of the others."""
    known = questions.select("question_id").distinct().withColumn("known", F.lit(True))
    a = answers.dropDuplicates(["attempt_id", "question_id"]).join(known, "question_id", "left")
    return a.groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(F.col("known").isNull()).alias("unknown"),
        F.count_if(F.col("known") & F.col("is_correct")).alias("correct"),
    )


def gate_counts(rules: tuple[tuple[str, DataFrame, bool], ...]) -> DataFrame:
    """rule, found, none_wanted: how many rows each rule finds, and whether it should find none."""
    counted = [df.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("rule"), "found", F.lit(none).alias("none_wanted")) for name, df, none in rules]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out


def explained(questions: DataFrame, made: DataFrame) -> DataFrame:
    """question_id, explanation, updated: the stored explanation, else the made one (question_id, made), else ''."""
    stored = F.when(F.coalesce(F.trim("explanation"), F.lit("")) != "", F.col("explanation"))
    return questions.select("question_id", stored.alias("stored")).join(made, "question_id", "left").select(
        "question_id", F.coalesce("stored", "made", F.lit("")).alias("explanation"), (F.col("stored").isNull() & F.col("made").isNotNull()).alias("updated")
    )


def validated(calls, valid, attempts: int = 3):
    """The first of at most `attempts` results that is valid, else None; an error of the call itself goes through."""
    for _ in range(attempts):
        found = calls()
        if valid(found):
            return found
    return None


def topped_up(make, wanted: int, rounds: int = 3) -> list:
    """Items from make(number still wanted) until there are `wanted`, in at most `rounds` rounds."""
    out: list = []
    for _ in range(rounds):
        if len(out) >= wanted:
            break
        out.extend(x for x in make(wanted - len(out)) if x is not None)
    return out[:wanted]
