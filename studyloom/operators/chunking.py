"""Topics to chunks, chunks to what they hold: pieces, figures, tables, repairs, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import natural_key, sentences

#: fixed values: phrases that make a sentence depend on a figure, in any case
FIGURE = (
    r"as shown (in|below|above)",
    r"shown in (the )?figure",
    r"in the figure (below|above)",
    r"the diagram illustrates",
    r"figure\s+\d+\.\d+\s+shows",
    r"in the (above|below) (figure|diagram)",
    r"the (figure|diagram) (below|above) shows",
)
MARKER = "\x00SUBHEADING\x00"  # begins a line that a detector knows for a subheading; never part of a piece
NUMBERED = r"(?U)^\d+\.\d+\.\d+[\s\x1c-\x1f]+[^\n]{2,100}\z"  # 1.2.1 Heading
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def packed(lines: DataFrame, doc: list[str], order: list[str], limit: int = 2000, blank: bool = False) -> DataFrame:
    """Greedy packing of a document's lines: a piece is closed when the next line would take it over the limit and it isn't empty.
    blank: a piece of nothing but empty lines isn't empty either.

    The fold restarts at each overflow, so a running sum can't express it; it is one aggregate over the document's line lengths."""
    parts = lines.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("l"))
    start = F.expr("named_struct('used', 0, 'at', 0, 'starts', array(0))").cast("struct<used: int, at: int, starts: array<int>>")

    def step(s: Column, x: Column) -> Column:
        n = F.length(x["text"])
        full = (s["at"] > 0 if blank else s["used"] > 0) & (s["used"] + n > limit)
        return F.struct(
            F.when(full, n).otherwise(s["used"] + n).alias("used"),
            (s["at"] + 1).alias("at"),
            F.when(full, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"),
        )

    # the list grows by one number for a piece, not for a line; each piece then is a slice of the lines
    folded = parts.withColumn("f", F.aggregate("l", start, step))
    ranges = F.transform(F.col("f.starts"), lambda s, k: F.struct(s.alias("low"), F.coalesce(F.get("f.starts", k + 1), F.col("f.at")).alias("high")))
    pieces = folded.select(*doc, "l", F.posexplode(ranges).alias("piece", "r"))
    return pieces.select(*doc, "piece", F.explode(F.slice("l", F.col("r.low") + 1, F.col("r.high") - F.col("r.low"))).alias("z")).select(
        *doc, *(F.col(f"z.{c}").alias(c) for c in order), F.col("z.text").alias("text"), "piece"
    )


def topic_pieces(topics: DataFrame, key: list[str], number: str = "topic_number", longest: int = 3000, limit: int = 2000) -> DataFrame:
    """Topics (key, number, text) as pieces: key, chunk_index, split_method, text.

    A topic of at most `longest` characters or without a number stays whole ("none"); another is cut before each line that begins with
    MARKER ("marked-subheading"), else before each N.M.K heading ("sub-subheading"), else packed by lines ("paragraph-group"). What stands
    before the first heading is a piece of its own; pieces of cut topics are trimmed. A NULL text is an empty one. `key` is unique."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    plain = F.replace(raw, F.lit(MARKER), F.lit(""))
    whole = (F.length(plain) <= longest) | (F.coalesce(F.col(number), F.lit("")) == "")
    lines = F.split(raw, "\n")
    marked = F.exists(lines, lambda x: x.startswith(MARKER))
    numbered = F.exists(F.split(plain, "\n"), lambda x: x.rlike(NUMBERED))
    method = F.when(whole, "none").when(marked, "marked-subheading").when(numbered, "sub-subheading").otherwise("paragraph-group")
    t = topics.select(*key, raw.alias("text"), plain.alias("_plain"), method.alias("split_method"))

    kept = t.where("split_method = 'none'").select(*key, F.lit(0).alias("chunk_index"), "split_method", F.col("_plain").alias("text"))
    cut = t.where("split_method <> 'none'").select(*key, "split_method", F.posexplode(F.split("text", "\n")).alias("line_no", "_raw"))
    cut = cut.withColumn("text", F.replace("_raw", F.lit(MARKER), F.lit("")))
    by = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.when(F.col("split_method") == "marked-subheading", F.col("_raw").startswith(MARKER)).otherwise(F.col("text").rlike(NUMBERED))
    # the first line begins a piece in any case
    headed = cut.where("split_method <> 'paragraph-group'").withColumn("piece", F.sum(((F.col("line_no") == 0) | begins).cast("int")).over(by) - 1)
    filled = packed(cut.where("split_method = 'paragraph-group'"), [*key, "split_method"], ["line_no"], limit, blank=True)
    columns = [*key, "split_method", "line_no", "text", F.col("piece").cast("int").alias("chunk_index")]
    pieces = headed.select(*columns).unionByName(filled.select(*columns)).groupBy(*key, "split_method", "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    return kept.unionByName(pieces.withColumn("text", F.regexp_replace("text", EDGES, "")))


def figure_sentences(chunks: DataFrame, *also: str) -> DataFrame:
    """Sentences that need a figure to be understood; also: further patterns."""
    s = chunks.select("chunk_id", F.posexplode(sentences(F.regexp_replace("text", r"\s+", " "))).alias("pos", "sentence"))
    depends = F.lit(False)
    for pattern in (*FIGURE, *also):
        depends = depends | F.col("sentence").rlike(f"(?i){pattern}")
    return s.where(depends)


def figures_in_chunks(chunks: DataFrame) -> DataFrame:
    """Figures linked by caption: the first chunk of the book whose text holds it, white space aside; unlinked ones stay.

    The comparison is with the book's own chunks only: an equi join on source_file with the containment as its condition."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    rows = chunks.select("source_file", "chunk_id", "chunk_index", "text", "images").dropDuplicates(["chunk_id"])
    figures = rows.select("source_file", F.explode("images").alias("i")).select("source_file", "i.image_file", "i.caption").distinct()
    texts = rows.select("source_file", "chunk_id", "chunk_index", flat("text").alias("t"))
    j = figures.alias("f").join(texts.alias("c"), F.expr("f.source_file = c.source_file AND contains(c.t, lower(f.caption))"), "left")
    return j.groupBy("f.source_file", "f.image_file").agg(F.min_by("c.chunk_id", F.struct("c.chunk_index", "c.chunk_id")).alias("chunk_id"))


def tables_in_chunks(chunks: DataFrame) -> DataFrame:
    """Rows of the tables printed in a chunk: line, cells."""
    lines = chunks.select("chunk_id", "text").distinct().select("chunk_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return lines.where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$")).select(
        "chunk_id", "line_no", F.array_join(cells, ";").alias("cells"), F.size(cells).alias("width")
    )


def markdown(rows: DataFrame) -> DataFrame:
    """Tables (array of rows of cells) as Markdown."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    head = line(F.col("rows")[0])
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.col("rows")[0])))
    body = F.transform(F.slice("rows", F.lit(2), F.size("rows")), line)
    return rows.withColumn("markdown", F.array_join(F.concat(F.array(head, rule), body), "\n"))


def real_tables(tables: DataFrame, most_area: float = 0.15, most_chars: int = 150) -> DataFrame:
    cells = F.flatten("rows")
    return tables.where((F.col("area") <= most_area) & (F.size(cells) > 0) & F.forall(cells, lambda c: F.length(F.coalesce(c, F.lit(""))) <= most_chars))


def repaired(chunks: DataFrame, repairs: DataFrame, equations: bool = False) -> DataFrame:
    """Literal repairs of a chunk's text, in order of their ids; only chunks that have any are rewritten.
    equations: each repair with an equation number (1.2) also without its numbers.

    The repairs of one chunk come together as one array before the join, so each chunk meets its own repairs and no others."""
    own = repairs.where("chunk_id IS NOT NULL AND before <> ''").select("chunk_id", "repair_id", F.lit(0).alias("variant"), "before", F.coalesce("after", F.lit("")).alias("after"))
    if equations:
        number = r"\(\d+\.\d+\)"
        bare = [F.regexp_replace(c, number, "").alias(c) for c in ("before", "after")]
        own = own.union(own.where(F.col("before").rlike(number)).select("chunk_id", "repair_id", F.lit(1), *bare).where("before <> ''"))
    listed = own.groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("repair_id", "variant", "before", "after"))).alias("r"))
    fixed = F.aggregate("r", F.col("text"), lambda t, p: F.replace(t, p["before"], p["after"]))
    rows = chunks.select("chunk_id", "text").distinct().join(listed, "chunk_id")
    return rows.select("chunk_id", fixed.alias("text"), (fixed != F.col("text")).alias("changed"))


def titled(chunks: DataFrame) -> DataFrame:
    """Chapter of each chunk; an unknown one is taken from the book, if the rest of it agrees on most."""
    known = F.when(~F.lower(F.trim("chapter")).isin("unknown", ""), F.col("chapter"))
    votes = chunks.select("source_file", known.alias("chapter")).where("chapter IS NOT NULL").groupBy("source_file", "chapter").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("source_file").agg(F.max_by("chapter", F.struct("n", "chapter")).alias("book_chapter"))
    return chunks.select("chunk_id", "source_file", known.alias("chapter")).distinct().join(best, "source_file", "left").select(
        "chunk_id", F.coalesce("chapter", "book_chapter", F.lit("Unknown")).alias("chapter"), F.col("chapter").isNull().alias("patched")
    )


def recurring_titles(chunks: DataFrame, least: int = 2) -> DataFrame:
    """Topic titles that several books of a subject share."""
    return (
        chunks.groupBy("class", "subject", F.lower("topic").alias("title"))
        .agg(F.countDistinct("source_file").alias("books"))
        .where(F.col("books") >= least)
    )


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """Metadata for stores that only know plain values: lists as JSON, '' for NULL, no text."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("chunk_id", "class", "subject", "source_file", "chapter", "chapter_number", "topic", "topic_number", "chunk_index")]
    return chunks.select(*plain, F.coalesce("has_table", F.lit(False)).alias("has_table"), *(F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("[]")).alias(a) for c, a in (("figure_dependent_spans", "spans"), ("images", "images"))))


def topic_ordinals(chunks: DataFrame) -> DataFrame:
    """Running number of topics in a book: each chunk_index 0 begins one."""
    rows = chunks.select("source_file", "chapter_number", "topic_number", "topic", "chunk_index", "chunk_id").dropDuplicates(["chunk_id"])
    number = natural_key(F.coalesce(F.col("topic_number"), F.lit("")))
    by = Window.partitionBy("source_file").orderBy(number, "topic", "chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("source_file", "chunk_id", (F.sum((F.col("chunk_index") == 0).cast("int")).over(by) - 1).alias("ordinal"))


def images_by_number(chunks: DataFrame) -> DataFrame:
    """chunk_id, has_table, images: the files of all chunks of the book with the same printed topic number and chunk number."""
    key = ["source_file", "topic_number", "chunk_index"]
    r = chunks.dropDuplicates(["chunk_id"])
    files = r.where("topic_number <> ''").select(*key, F.explode("images.image_file").alias("file")).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("images"))
    return r.drop("images").join(files, key, "left").select("chunk_id", F.coalesce("has_table", F.lit(False)).alias("has_table"), F.coalesce("images", F.lit("")).alias("images"))


def table_chunks(chunks: DataFrame) -> DataFrame:
    """table_id, chunk_id: for the tables printed in a chunk the chunk of the same topic that holds the first of their cells (by row, then column) found
    in any, else the topic's first chunk. A topic's cells meet its own chunks only."""
    topic = ["source_file", "topic"]
    r = chunks.where("topic IS NOT NULL").dropDuplicates(["chunk_id"]).select(*topic, "chunk_id", "chunk_index", "text")
    rows = tables_in_chunks(chunks).select(F.col("chunk_id").alias("table_id"), "line_no", "cells")
    held = rows.join(r.select(*topic, F.col("chunk_id").alias("table_id")), "table_id")
    cells = held.select(*topic, "table_id", "line_no", F.posexplode(F.split("cells", ";")).alias("pos", "cell")).where("cell <> ''")
    place = F.struct("line_no", "pos", "chunk_index", "chunk_id")
    hits = cells.join(r, topic).where(F.contains("text", "cell")).groupBy("table_id").agg(F.min_by("chunk_id", place).alias("hit"))
    first = r.groupBy(*topic).agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("first"))
    return held.select(*topic, "table_id").distinct().join(first, topic).join(hits, "table_id", "left").select("table_id", F.coalesce("hit", "first").alias("chunk_id"))


def patch_counts(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """class, subject, source_file, rows, differing, rewritten: what setting the titles (source_file, title) would change."""
    j = chunks.select("chunk_id", "class", "subject", "source_file", "chapter").distinct().join(titles, "source_file")
    n = j.groupBy("class", "subject", "source_file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("chapter").eqNullSafe(F.col("title"))).alias("differing"))
    return n.withColumn("rewritten", F.when(F.col("differing") > 0, F.col("rows")).otherwise(0))


def with_repairs(texts: DataFrame, repairs: DataFrame) -> DataFrame:
    """texts (chunk_id, text) with their literal repairs, in order; a chunk without any, or without a text, as it is."""
    fixed = repaired(texts.where("text IS NOT NULL"), repairs).select("chunk_id", F.col("text").alias("fixed"))
    return texts.join(fixed, "chunk_id", "left").select("chunk_id", F.coalesce("fixed", "text").alias("text"))
