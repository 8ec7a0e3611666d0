"""From glyphs to lines, and what lines are: headings, running headers, questions and answers, page ranges.

Line order (page, line_no) is part of the data. Grouped Python runs per page or per document, never over a corpus."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^\s*(\d{1,2}(?:\.\d{1,2})+)\.?\s+(\S.*)$"
MARKER = r"(?i)^\s*(exercises?|summary|key ?words|what you have learnt)\b"


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """Printed lines of chunks: source_file, chunk_id, chunk_index, line_no, text. Rows sent again by re-ingestion count once."""
    return chunks.select("source_file", "chunk_id", "chunk_index", "text").distinct().select(
        "source_file", "chunk_id", "chunk_index", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    )


def glyph_lines(glyphs: DataFrame, gap: float = 3.0, twice: float = 2.0, small: float = 0.8) -> DataFrame:
    """Lines of text blocks from their characters.

    Characters are sorted by (y0, x0); a new row begins where y0 differs from the last character's by more than `gap`; inside a row
    a character within `twice` points of the last accepted equal one is a repeat. A row of digits, all smaller than `small` of the row
    above's size, is set into it where it touches (subscripts) unless it floats above it."""

    BLOCK, Y0, X0, POS, CHAR, X1, Y1, SIZE = range(8)
    named = ("block", "y0", "x0", "pos", "c", "x1", "y1", "size")

    def touches(c: tuple, others: list[tuple]) -> bool:
        return any((b[CHAR].isalnum() or b[CHAR] == ")") and -0.6 <= c[X0] - b[X1] <= 0.4 * b[SIZE] and b[Y0] <= (c[Y0] + c[Y1]) / 2 for b in others)

    def block_lines(chars: list[tuple]) -> list[list[tuple]]:
        rows: list[list[tuple]] = []
        for c in chars:
            if rows and abs(c[Y0] - rows[-1][-1][Y0]) <= gap:
                rows[-1].append(c)
            else:
                rows.append([c])
        merged: list[list[tuple]] = []
        for row in rows:
            kept: list[tuple] = []
            for c in sorted(row, key=lambda c: c[X0]):
                last = kept[-1] if kept else None
                if not (last and last[CHAR] == c[CHAR] and abs(last[X0] - c[X0]) < twice and abs(last[Y0] - c[Y0]) < twice):
                    kept.append(c)
            if merged and all(c[CHAR].isdigit() for c in kept):
                base = merged[-1]
                size = max(c[SIZE] for c in base)
                if all(c[SIZE] < small * size for c in kept) and all(touches(c, [*base, *kept[:k]]) for k, c in enumerate(kept)):
                    merged[-1] = sorted([*base, *kept], key=lambda c: c[X0])
                    continue
            merged.append(kept)
        return merged

    def run(t: pa.Table) -> pa.Table:
        """The lines of one page, block by block."""
        chars = sorted(zip(*(t.column(c).to_pylist() for c in named)), key=lambda c: c[: POS + 1])
        doc, page = (t.column(c)[0].as_py() for c in ("doc", "page"))
        out = []
        for block, own in itertools.groupby(chars, key=lambda c: c[BLOCK]):
            for n, r in enumerate(block_lines(list(own))):
                out.append((doc, page, block, n, "".join(c[CHAR] for c in r), max(c[SIZE] for c in r), min(c[X0] for c in r), min(c[Y0] for c in r), max(c[X1] for c in r), max(c[Y1] for c in r)))
        names = ["doc", "page", "block", "line_no", "text", "size", "x0", "y0", "x1", "y1"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5]
        return pa.table([pa.array([o[k] for o in out], kinds[k]) for k in range(len(names))], names)

    return (
        glyphs.where("NOT (x1 - x0 < 0)")
        .groupBy("doc", "page")
        .applyInArrow(
            run, "doc string, page int, block int, line_no int, text string, size double, x0 double, y0 double, x1 double, y1 double"
        )
    )


def two_columns(lines: DataFrame) -> DataFrame:
    """Reading order of a two-column page: blocks left of the middle first, else as they are. Adds `place` per page."""
    page = Window.partitionBy("doc", "page")
    block = Window.partitionBy("doc", "page", "block")
    middle = (F.min("x0").over(page) + F.max("x1").over(page)) / 2
    side = (F.avg((F.col("x0") + F.col("x1")) / 2).over(block) >= middle).cast("int")
    first = F.min("line_no").over(block)
    keyed = lines.withColumn("side", side).withColumn("first", first)
    return keyed.withColumn("place", F.row_number().over(page.orderBy("side", "first", "block", "line_no"))).drop("side", "first")


def headline_fragment(text: Column) -> Column:
    """Upper case, or at most six words with a capital first, or four fifths of the longer words with a capital."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    long_ = F.filter(words, lambda w: F.length(w) > 3)
    big = F.filter(long_, lambda w: w.rlike(r"^\p{Lu}"))
    return (
        ((F.upper(text) == text) & text.rlike(r"\p{L}"))
        | ((F.size(words) <= 6) & F.trim(text).rlike(r"^\p{Lu}"))
        | ((F.size(long_) > 0) & (F.size(big) >= 0.8 * F.size(long_)))
    )


def plausible_heading(text: Column) -> Column:
    """Starts with a letter, half of it letters, reads like a headline, and isn't a measurement or a sentence."""
    t = F.trim(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return t.rlike(r"^\p{L}") & (letters * 2 >= F.length(t)) & headline_fragment(t) & ~t.rlike(r"[.;:,]$")


def headings(lines: DataFrame) -> DataFrame:
    """Numbered headings: number, title; a line such as 37.0 °C is none."""
    number = F.regexp_extract("text", HEADING, 1)
    title = F.regexp_extract("text", HEADING, 2)
    return lines.withColumn("number", number).withColumn("title", F.trim(title)).where((number != "") & plausible_heading(title))


def with_current_heading(lines: DataFrame, order: list[str], doc: str = "source_file") -> DataFrame:
    """Each line with the last heading number above it in its document (forward fill)."""
    number = F.when(plausible_heading(F.regexp_extract("text", HEADING, 2)), F.regexp_extract("text", HEADING, 1))
    by = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("_n", F.when(number != "", number))
    return marked.withColumn("heading", F.last("_n", ignorenulls=True).over(by)).drop("_n")


def page_ranges(pages: DataFrame) -> DataFrame:
    """First and last page of each heading number."""
    return pages.where("heading IS NOT NULL").groupBy("doc", "heading").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def table_topics(tables: DataFrame, ranges: DataFrame) -> DataFrame:
    """The first topic whose pages hold a table's page; tables without one stay, unlinked."""
    j = tables.alias("t").join(ranges.alias("r"), F.expr("t.doc = r.doc AND t.page BETWEEN r.first_page AND r.last_page"), "left")
    by = Window.partitionBy("t.table_id").orderBy(F.col("r.first_page"), F.col("r.heading"))
    return j.withColumn("n", F.row_number().over(by)).where("n = 1").select("t.table_id", "t.doc", "t.page", "r.heading")


def repeated_lines(lines: DataFrame, least: int = 2) -> DataFrame:
    """Lines that many chunks of one book share, by their letters: candidates for running headers."""
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}]", "")
    return (
        lines.select("source_file", "chunk_id", letters.alias("letters"))
        .where(F.length("letters").between(4, 60))
        .groupBy("source_file", "letters")
        .agg(F.countDistinct("chunk_id").alias("chunks"))
        .where(F.col("chunks") >= least)
    )


def chapter_end(marks: DataFrame) -> DataFrame:
    """The first marked page (from 2 on) with another mark within three pages."""
    by = Window.partitionBy("doc").orderBy("page", "line_no")
    gap = F.least(F.col("page") - F.lag("page").over(by), F.lead("page").over(by) - F.col("page"))
    return marks.withColumn("gap", gap).where("page >= 2 AND gap <= 3").groupBy("doc").agg(F.min("page").alias("end_page"))


def question_groups(lines: DataFrame, order: list[str], doc: str = "source_file") -> DataFrame:
    """Numbered items put together: a line that starts with a number and dot begins one, lines before the first are dropped."""
    start = F.col("text").rlike(r"^\s*(?:Q\s*)?\d{1,2}[.)]\s+\S").cast("int")
    by = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("item", F.sum(start).over(by)).where("item > 0")
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return numbered.groupBy(doc, "item").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count(F.lit(1)).alias("lines"))


def style_histogram(spans: DataFrame) -> DataFrame:
    """How often each style is used, with its first text."""
    return (
        spans.groupBy("size", "bold", "font")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("text", F.struct("page", "pos")).alias("sample"))
        .orderBy(F.desc("size"), F.desc("n"))
    )


def dominant_color(spans: DataFrame) -> DataFrame:
    """Each document's body colour: the one with most text."""
    by = spans.groupBy("doc", "color").agg(F.sum(F.length("text")).alias("n"))
    return by.groupBy("doc").agg(F.max_by("color", F.struct("n", "color")).alias("color"))


def title_case(text: Column) -> Column:
    """A title's shape: 2 to 80 characters, capital first, no closing mark, at most eight words, no label."""
    t = F.trim(text)
    words = F.size(F.split(t, r"\s+"))
    return (
        F.length(t).between(2, 80) & t.rlike(r"^\p{Lu}") & ~t.rlike(r"[.,;:?!]$") & (words <= 8)
        & ~((words == 1) & (F.length(t) >= 20)) & ~t.rlike(r"(?i)^(fig(ure)?|table|activity|unit|readings)\b")
        & ~t.rlike(r"(?i)\s(a|an|and|of|the|in|on|to|with)$")
    )


def chapter_titles(candidates: DataFrame) -> DataFrame:
    """Of candidate titles with a tier, each document's best: lowest tier, then score, then the smaller text."""
    by = Window.partitionBy("doc").orderBy("tier", F.desc("score"), "title")
    return candidates.where(title_case(F.col("title"))).withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def leading_number(lines: DataFrame) -> DataFrame:
    """doc, number, votes: the number that most lines of a document begin with; among equals the one seen first."""
    n = F.regexp_extract("text", r"^\s*(\d{1,2})[. ]", 1)
    votes = (
        lines.withColumn("n", F.when(n != "", n.cast("int")))
        .where("n IS NOT NULL")
        .groupBy("doc", "n")
        .agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("page", "line_no")).alias("seen"))
    )
    return votes.groupBy("doc").agg(F.min_by("n", F.struct((-F.col("votes")).alias("v"), "seen")).alias("number"), F.max("votes").alias("votes"))


def block_sizes(lines: DataFrame) -> DataFrame:
    """doc, page, block, smallest (size of a line), lines: blank lines don't count."""
    return lines.where(F.trim("text") != "").groupBy("doc", "page", "block").agg(F.min("size").alias("smallest"), F.count(F.lit(1)).alias("lines"))


def vertical_blocks(blocks: DataFrame, narrow: float = 20, tall: float = 50, times: float = 4) -> DataFrame:
    """Blocks (width, height) of rotated text: narrower than `narrow`, higher than `tall` and than `times` their width."""
    return blocks.where((F.col("width") < narrow) & (F.col("height") > tall) & (F.col("height") > times * F.col("width")))


def captions(lines: DataFrame) -> DataFrame:
    """doc, page, block, k, number, caption: lines that begin with a figure's number, each with the lines after it in its block up to the next."""
    starts = F.col("text").rlike(r"^\s*Fig(?:ure|\.)\s*\d+\.\d+")
    by = Window.partitionBy("doc", "page", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = lines.withColumn("k", F.sum(starts.cast("int")).over(by)).where((F.col("k") > 0) & (F.trim("text") != ""))
    number = F.regexp_extract(F.min(F.when(starts, F.col("text"))), r"(\d+\.\d+)", 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: F.trim(x["text"])), " ")
    return n.groupBy("doc", "page", "block", "k").agg(number.alias("number"), text.alias("caption"))


def styled(spans: DataFrame) -> DataFrame:
    """spans (flags, font) with `bold`: bit 4 of the flags, or a font named so."""
    return spans.withColumn("bold", F.coalesce(F.col("flags").bitwiseAND(16) != 0, F.lit(False)) | F.coalesce(F.contains(F.lower("font"), F.lit("bold")), F.lit(False)))


def with_drop_caps(lines: DataFrame, longest: int = 20, larger: float = 1.15, gap: float = 8.0) -> DataFrame:
    """Lines in which a row of raised initials is set before the row it belongs to: at most `longest` characters (but for a number), no small letter, some letter,
    `larger` than the next row of its block, which begins 0 to `gap` points below. The merged line stands in the next row's place."""
    by = Window.partitionBy("doc", "page", "block").orderBy("line_no")
    core = F.trim(F.regexp_replace("text", r"^\d+\.\s*\d+\.?\s*", ""))
    shaped = (F.length(core) > 0) & (F.length(core) <= longest) & ~core.rlike(r"\p{Ll}") & core.rlike(r"\p{L}")
    below = F.lead("y0").over(by) - F.col("y0")
    initials = F.coalesce(shaped & (F.col("size") > larger * F.lead("size").over(by)) & below.between(0, gap), F.lit(False))
    marked = lines.withColumn("_initials", initials)
    before = F.lag("_initials").over(by)
    joined = F.when(before, F.concat(F.lag("text").over(by), F.col("text"))).otherwise(F.col("text"))
    return marked.withColumn("_joined", joined).where(~F.col("_initials")).drop("text", "_initials").withColumnRenamed("_joined", "text").select(*lines.columns)
