"""Reading and writing tables: explicit schemas, several formats, upserts and whole publications.

Plain files have no transactions over several tables, so a publication writes everything under a new version first and then
adds a manifest that names it; readers follow the newest manifest, so they never see half of a publication, nor none."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyloom import schemas
from studyloom.operators.dedup import latest
from studyloom.session import cut

SCHEMAS = {
    "questions": schemas.QUESTIONS, "chunk": schemas.CHUNKS, "quiz_attempts": schemas.ATTEMPTS, "attempt_answers": schemas.ANSWERS,
    "reference_corpus": schemas.CORPUS,
}


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Parquet and ORC carry their schema; JSON, CSV and TSV are read with the given one, malformed rows as NULLs."""
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if fmt == "tsv":
        return reader.option("sep", "\t").csv(path)
    return reader.format(fmt).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "tsv":
        writer.option("sep", "\t").option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)


def scan(spark: SparkSession, sf_dir: str, name: str, **equal) -> DataFrame:
    """A table with equality filters that reach the scan; a filter of None is left out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def books(spark: SparkSession, root: str, pattern: str = "*.pdf", subjects: dict[str, str] | None = None, only_class: str | None = None, only_subject: str | None = None) -> DataFrame:
    """Files of a tree `class */subject/name.pdf` with what their place says, in the order of class, subject and the number in the name; contents stay unread
    unless selected. subjects: names for folders (small letters), else their title case; only_subject in any case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    part = lambda n: F.regexp_extract("path", r"class[ _]?([^/]+)/([^/]+)/([^/]+)\.[^./]+$", n)
    named = F.initcap(part(2))
    if subjects:
        flat = [F.lit(x) for pair in subjects.items() for x in pair]
        named = F.coalesce(F.try_element_at(F.create_map(*flat), F.lower(part(2))), named)
    found = files.select("path", "length", F.trim(part(1)).alias("class"), named.alias("subject"), part(3).alias("source_file"), "content")
    if only_class:
        found = found.where(F.col("class") == only_class)
    if only_subject:
        found = found.where(F.lower("subject") == only_subject.lower())
    number = F.coalesce(F.expr("try_cast(regexp_replace(source_file, '[^0-9]', '') AS int)"), F.lit(0))
    return found.orderBy("class", "subject", number, "source_file")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Old and new rows with the last version of each key; without an order new rows win."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, *order, F.desc("_new")).drop("_new")


def refreshed(derived: DataFrame) -> DataFrame:
    """Reference entries as they are stored: no empty answers, a default source, a topic where only its number is known."""
    if "topic_number" in derived.columns and "topic" in derived.columns:
        derived = derived.withColumn("topic", F.coalesce("topic", F.nullif(F.col("topic_number"), F.lit(""))))
    return derived.withColumn("answer", F.nullif(F.col("answer"), F.lit(""))).withColumn("source", F.coalesce("source", F.lit("ncert_intext")))


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes all tables under a new version and then adds the manifest that names it, in one rename; returns the version. Older
    manifests stay, for readers that hold them."""
    version = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    fs, new = _filesystem(spark, f"{root}/_{version}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}), "utf-8"))
    out.close()
    if not fs.rename(new, _filesystem(spark, f"{root}/{version}.manifest")[1]):
        raise OSError(f"the manifest of {version} can't be named")
    return version


def newest(spark: SparkSession, root: str) -> str:
    """The version of the newest manifest."""
    fs, pattern = _filesystem(spark, f"{root}/*.manifest")
    names = [f.getPath().getName() for f in fs.globStatus(pattern)]
    if not names:
        raise FileNotFoundError(f"nothing is published under {root}")
    return max(names).removesuffix(".manifest")


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{newest(spark, root)}/{name}")


LOG = "status string, key string, note string, at timestamp"


def log_progress(rows: DataFrame, path: str) -> None:
    """Appends rows (status, key, note) to a log of tab-separated files: DONE, FAILED, SKIPPED."""
    kept = [F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\\t\\n\\r]", " ").alias(c) for c in ("status", "key", "note")]
    rows.select(*kept, F.current_timestamp().alias("at")).write.mode("append").option("sep", "\t").csv(path)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The log; an empty one if there is none yet."""
    fs, p = _filesystem(spark, path)
    return spark.read.option("sep", "\t").schema(LOG).csv(path) if fs.exists(p) else spark.createDataFrame([], LOG)


def resumable(items: DataFrame, fn, schema: str, key: str, log: str, start: int = 0, budget_s: float | None = None, workers: int = 6) -> DataFrame:
    """key, result, error, status of each item, in one pass: skipped (in the log as done, or before place `start` by key), failed, ok, or later (its turn
    came after the time budget); what was done or failed is logged. A failure stays its item's own. At most `workers` items run at once."""
    spark = items.sparkSession
    done = progress(spark, log).where("status = 'DONE'").select(F.col("key").alias(key)).distinct().withColumn("_done", F.lit(True))
    place = F.row_number().over(Window.partitionBy().orderBy(key)) - 1  # a list of files, not of rows
    listed = items.withColumn("_place", place).join(done, key, "left").withColumn("_skip", F.col("_done").isNotNull() | (F.col("_place") < start)).drop("_done")
    until = time.time() + budget_s if budget_s is not None else None

    def run(row: dict) -> dict:
        if until is not None and time.time() > until:
            raise TimeoutError("later")
        return fn({k: v for k, v in row.items() if k not in ("_place", "_skip")})

    ran = cut(isolated(listed.where("NOT _skip"), run, schema, key, workers))
    late = F.col("error") == "TimeoutError: later"
    told = ran.withColumn("status", F.when(late, "later").when(F.col("error").isNotNull(), "failed").otherwise("ok"))
    log_progress(told.where("status <> 'later'").select(F.when(F.col("status") == "ok", "DONE").otherwise("FAILED").alias("status"), F.col(key).alias("key"), F.col("error").alias("note")), log)
    skipped = listed.where("_skip").select(key, F.lit(None).cast(ran.schema["result"].dataType).alias("result"), F.lit(None).cast("string").alias("error"), F.lit("skipped").alias("status"))
    return told.select(key, "result", "error", "status").unionByName(skipped)


def report(told: DataFrame) -> DataFrame:
    """How many items of a resumable run ended in each way."""
    return told.groupBy("status").agg(F.count(F.lit(1)).alias("items"))


def write_once(df: DataFrame, path: str) -> None:
    """Drafts as JSON; a folder that is there already is an error, never overwritten."""
    df.write.mode("errorifexists").json(path)


def isolated(df: DataFrame, fn, schema: str, key: str, workers: int | None = None) -> DataFrame:
    """Runs a Python function on each row and keeps its failures as rows: key, result (JSON text), error. workers: at most so many rows run at once."""
    import pyarrow as pa

    df = df.repartition(workers, key) if workers else df

    columns = df.columns

    def run(batches):
        for batch in batches:
            keys, results, errors = [], [], []
            for row in batch.to_pylist():
                keys.append(row[key])
                try:
                    results.append(json.dumps(fn(row)))
                    errors.append(None)
                except Exception as e:
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(results, pa.string()), pa.array(errors, pa.string())], [key, "result", "error"]
            )

    done = df.select(*columns).mapInArrow(run, f"{key} string, result string, error string")
    return done.withColumn("result", F.from_json("result", schema))
