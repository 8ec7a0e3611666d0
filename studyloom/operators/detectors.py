"""Topic headings of a document from its lines, by several families of layout, and the segments between them.

Lines: doc, page, line_no, block, text, size. Flags are expressions and windows per document; only the check that accepted
numbers rise, which depends on what was accepted before, is a fold, over a document's few candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.functions.text import headline
from studyloom.operators.layout import HEADING, plausible_heading


ORDER = ("page", "line_no")
END = r"(?i)^\s*(summary|exercises?|what you have learnt|key ?words|let us recall)\b"


def _number(part: int) -> Column:
    return F.regexp_extract("text", HEADING, part)


def calibration(lines: DataFrame) -> DataFrame:
    """For each document the largest size of numbered heading lines and their most frequent chapter number (the first seen on ties)."""
    found = lines.withColumn("n", _number(1)).where((F.col("n") != "") & plausible_heading(_number(2)))
    top = F.max("size").over(Window.partitionBy("doc"))
    large = found.withColumn("heading_size", top).where(F.col("size") >= F.col("heading_size") - 0.5).withColumn("major", F.split("n", r"\.")[0].cast("int"))
    votes = large.groupBy("doc", "heading_size", "major").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(*ORDER)).alias("seen"))
    return votes.groupBy("doc", "heading_size").agg(F.min_by("major", F.struct((-F.col("votes")).alias("v"), "seen")).alias("major"))


def rising(candidates: DataFrame) -> DataFrame:
    """Candidates (doc, page, line_no, minor, sure) kept in order: sure ones always, others only if their minor number is the next higher."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        last, keep = -1, []
        for r in frame.sort_values(list(ORDER)).itertuples():
            if r.sure or r.minor > last:
                keep.append((key[0], r.page, r.line_no))
                last = max(last, r.minor)
        return pd.DataFrame(keep, columns=["doc", "page", "line_no"])

    return candidates.groupBy("doc").applyInPandas(fold, "doc string, page int, line_no int")


def numbered(lines: DataFrame) -> DataFrame:
    """Headings such as 3.2 Title of the dominant chapter number, in heading size or with a rising number."""
    c = calibration(lines)
    found = lines.withColumn("number", _number(1)).withColumn("name", F.trim(_number(2))).where((F.col("number") != "") & plausible_heading(_number(2)))
    parts = F.split("number", r"\.")
    found = found.join(c, "doc").where(parts[0].cast("int") == F.col("major"))
    found = found.withColumn("minor", parts[1].cast("int")).withColumn("sure", F.col("size") >= F.col("heading_size") - 0.5)
    # of one number the first line counts
    once = Window.partitionBy("doc", "number").orderBy(*ORDER)
    found = found.withColumn("r", F.row_number().over(once)).where("r = 1")
    kept = rising(found.select("doc", *ORDER, "minor", "sure"))
    return found.join(kept, ["doc", *ORDER]).select("doc", *ORDER, "number", "name")


def running(lines: DataFrame) -> DataFrame:
    """Line texts that a quarter of a document's pages (at least two) share: running headers."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    key = F.regexp_replace(F.upper("text"), r"[^\p{L}]", "").alias("key")
    on = lines.select("doc", "page", key).where("key <> ''").groupBy("doc", "key").agg(F.countDistinct("page").alias("on"))
    return on.join(pages, "doc").where(F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 4))).select("doc", "key")


def all_caps(lines: DataFrame) -> DataFrame:
    """Headings in capitals: no running header, first occurrence only, before the document's end marker; lines of one block together."""
    key = F.regexp_replace(F.upper("text"), r"[^\p{L}]", "")
    shaped = (F.upper("text") == F.col("text")) & (F.length(key) >= 4) & ~F.col("text").rlike(r"(?i)^\s*(table|fig(ure)?)\b|\d{3,}") & ~F.col("text").rlike(r"[.:;]$")
    end = F.min(F.when(F.col("text").rlike(END), F.struct(*ORDER))).over(Window.partitionBy("doc"))
    flagged = lines.withColumn("key", key).withColumn("end", end).where(shaped).where("end IS NULL OR struct(page, line_no) < end")
    flagged = flagged.join(running(lines), ["doc", "key"], "left_anti")
    blocks = flagged.groupBy("doc", "page", "block").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    named = blocks.withColumn("name", headline(F.array_join(F.transform("l", lambda x: F.trim(x["text"])), " ")))
    once = Window.partitionBy("doc", "name").orderBy(*ORDER)
    return named.withColumn("r", F.row_number().over(once)).where("r = 1").select("doc", *ORDER, F.lit(None).cast("string").alias("number"), "name")


def size_tiers(lines: DataFrame, topic: tuple[float, float], sub: tuple[float, float], own_number: bool = False) -> DataFrame:
    """Headings by font size: a topic's and a sub-topic's range; with own_number only lines that begin with N or N.M."""
    tier = F.when(F.col("size").between(*topic), 1).when(F.col("size").between(*sub), 2)
    number = F.regexp_extract("text", r"^\s*(\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    name = F.trim(F.regexp_replace("text", r"^\s*\d+(?:\.\d+)*[.)]?\s+", ""))
    t = lines.withColumn("tier", tier).withColumn("number", F.nullif(number, F.lit(""))).where("tier IS NOT NULL")
    t = t.where("number IS NOT NULL") if own_number else t
    return t.where(F.length(F.trim("text")) > 2).select("doc", *ORDER, "number", name.alias("name"), "tier")


def routed(lines: DataFrame, rules: DataFrame, **tiers) -> DataFrame:
    """Headings of each document by the detector that a rule table (doc, detector) names: numbered (default), all_caps, sizes.

    A document whose numbered detector finds nothing falls back to all_caps."""
    chosen = lines.join(rules.select("doc", "detector"), "doc", "left").withColumn("detector", F.coalesce("detector", F.lit("numbered")))
    by_number = numbered(chosen.where("detector = 'numbered'"))
    none = chosen.where("detector = 'numbered'").join(by_number.select("doc").distinct(), "doc", "left_anti")
    caps = all_caps(chosen.where("detector = 'all_caps'").unionByName(none))
    out = by_number.unionByName(caps)
    if tiers:
        out = out.unionByName(size_tiers(chosen.where("detector = 'sizes'"), **tiers).select("doc", *ORDER, "number", "name"))
    return out


def segments(lines: DataFrame, headings: DataFrame, least_intro: int = 80) -> DataFrame:
    """doc, ordinal, number, name, text: the text under each heading; what stands before the first is the Introduction, if long enough."""
    marked = lines.join(headings.select("doc", *ORDER, "number", "name", F.lit(1).alias("head")), ["doc", *ORDER], "left")
    by = Window.partitionBy("doc").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered_ = marked.withColumn("ordinal", F.coalesce(F.sum("head").over(by), F.lit(0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct(*ORDER, "text")))), lambda x: x["text"]), "\n")
    out = numbered_.groupBy("doc", "ordinal").agg(F.max("number").alias("number"), F.coalesce(F.max("name"), F.lit("Introduction")).alias("name"), body.alias("text"))
    return out.where((F.col("ordinal") > 0) | (F.length(F.trim("text")) >= least_intro))


def without_boxes(lines: DataFrame, start: str, tolerance: float = 1.5) -> DataFrame:
    """Lines outside boxes: a box starts at a line like `start` and goes on, on its page, while sizes stay within the tolerance."""
    page = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.col("text").rlike(start)
    box_size = F.last(F.when(begins, F.col("size")), ignorenulls=True).over(page)
    left = F.when(~begins & (F.abs(F.col("size") - box_size) > tolerance), 1).otherwise(0)
    box = F.sum(begins.cast("int")).over(page)
    marked = lines.withColumn("_box", box).withColumn("_left", left)
    gone = F.max("_left").over(Window.partitionBy("doc", "page", "_box").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_gone", gone).where("_box = 0 OR _gone = 1").drop("_box", "_left", "_gone")


def questions_answers(lines: DataFrame) -> DataFrame:
    """Question and answer of each `Q1.` ... `Ans.` run; a question without an answer's text is dropped."""
    q, a = F.col("text").rlike(r"^\s*Q\s*\d+[.)]"), F.col("text").rlike(r"(?i)^\s*ans(wer)?[.:]")
    by = Window.partitionBy("doc").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = lines.withColumn("q", F.sum(q.cast("int")).over(by)).where("q > 0")
    within = Window.partitionBy("doc", "q").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = n.withColumn("part", F.max(a.cast("int")).over(within))
    bare = F.trim(F.regexp_replace("text", r"(?i)^\s*(q\s*\d+[.)]|ans(wer)?[.:])", ""))
    join = lambda p: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct(*ORDER, bare.alias("t"))))), lambda x: x["t"]), " "))
    return n.groupBy("doc", "q").agg(join(0).alias("question"), join(1).alias("answer")).where("answer <> ''")


def banner(spans: DataFrame) -> DataFrame:
    """The title banner of a document's first page: the largest run of a colour other than the body's, larger than 13 points, title-shaped."""
    from studyloom.operators.layout import dominant_color, title_case

    body = dominant_color(spans).withColumnRenamed("color", "body")
    runs = spans.where("page = 0 AND size > 13").join(body, "doc").where("color <> body").where(title_case(F.col("text")) & ~F.col("text").rlike(r"(?i)^unit\b"))
    by = Window.partitionBy("doc").orderBy(F.desc("size"), F.desc(F.length("text")), "text")
    return runs.withColumn("r", F.row_number().over(by)).where("r = 1").select("doc", F.col("text").alias("title"))


def merged_headers(lines: DataFrame, least: int = 2, letters: int = 6) -> DataFrame:
    """doc, key, pages: lines that at least `least` pages print, by their letters; one that is the beginning of others counts with the longest of them, on
    the union of their pages. Keys of one document meet by their first letters, and only repeated ones do."""
    key = F.regexp_replace(F.upper("text"), r"[^\p{L}]", "")
    on = lines.select("doc", "page", key.alias("key")).where(F.length("key") >= letters).groupBy("doc", "key").agg(F.collect_set("page").alias("on")).where(F.size("on") >= least)
    on = on.withColumn("head", F.substring("key", 1, letters))
    full = on.alias("a").join(on.alias("b"), F.expr("a.doc = b.doc AND a.head = b.head AND startswith(b.key, a.key)"))
    best = full.groupBy("a.doc", "a.key").agg(F.max_by("b.key", F.struct(F.length("b.key"), "b.key")).alias("full_key"))
    return on.join(best, ["doc", "key"]).select("doc", F.col("full_key").alias("key"), F.explode("on").alias("page")).groupBy("doc", "key").agg(F.countDistinct("page").alias("pages"))


def compared(lines: DataFrame) -> DataFrame:
    """doc, number, side: heading numbers that any line is shaped like, against those `numbered` takes: found, small (none of its lines has heading size), or missing."""
    shaped = lines.withColumn("number", _number(1)).where("number <> ''").groupBy("doc", "number").agg(F.max("size").alias("size"))
    taken = numbered(lines).select("doc", "number", F.lit(True).alias("taken"))
    j = shaped.join(taken, ["doc", "number"], "full").join(calibration(lines).select("doc", "heading_size"), "doc", "left")
    side = F.when(F.col("taken"), "found").when(F.col("size") < F.col("heading_size") - 0.5, "small").otherwise("missing")
    return j.select("doc", "number", side.alias("side"))


def _two_part(lines: DataFrame) -> DataFrame:
    """Lines N.M Name, also of deeper numbers, with major and minor."""
    found = lines.withColumn("number", _number(1)).withColumn("name", F.trim(_number(2))).where((F.col("number") != "") & F.col("name").rlike(r"^\p{L}"))
    parts = F.split("number", r"\.")
    return found.withColumn("major", parts[0].cast("int")).withColumn("minor", parts[1].cast("int"))


def _once(found: DataFrame) -> DataFrame:
    """Of one number of a document the first line."""
    by = Window.partitionBy("doc", "number").orderBy(*ORDER)
    return found.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def capitals_numbered(lines: DataFrame) -> DataFrame:
    """Headings N.M of the number that most headings in capitals have: those in capitals, others in headline case only if their number goes on rising."""
    from studyloom.operators.layout import headline_fragment

    found = _two_part(lines).withColumn("sure", F.upper("name") == F.col("name"))
    votes = found.where("sure").groupBy("doc", "major").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct(*ORDER)).alias("seen"))
    top = votes.groupBy("doc").agg(F.min_by("major", F.struct((-F.col("votes")).alias("v"), "seen")).alias("major"))
    own = _once(found.join(top, ["doc", "major"]).where(F.col("sure") | headline_fragment(F.col("name"))))
    kept = rising(own.select("doc", *ORDER, "minor", "sure"))
    return own.join(kept, ["doc", *ORDER]).select("doc", *ORDER, "number", "name")


def highest_major(lines: DataFrame) -> DataFrame:
    """doc, major: the highest chapter number of a document's heading lines."""
    return _two_part(lines).groupBy("doc").agg(F.max("major").alias("major"))


def chapter_numbered(lines: DataFrame, chapters: DataFrame, garbled: Column) -> DataFrame:
    """Headings of a known chapter number (chapters: doc, major) that aren't garbled, while their numbers rise."""
    own = _once(_two_part(lines).join(chapters, ["doc", "major"]).where(~garbled)).withColumn("sure", F.lit(False))
    kept = rising(own.select("doc", *ORDER, "minor", "sure"))
    return own.join(kept, ["doc", *ORDER]).select("doc", *ORDER, "number", "name")


def revised(lines: DataFrame, topic: tuple[float, float], sub: tuple[float, float], box: str, recap: str = END, exercise: str = r"(?i)^\s*exercises?\b") -> DataFrame:
    """doc, kind, ordinal, name, text of books laid out by sizes: boxes that begin like `box` are dropped; lines of the topic's size begin a topic, those of the
    sub-topic's and items such as a) a sub-topic; from the first line like `recap` on there are no topics; what follows the first line like
    `exercise` is one exercise for each line. Lines of the first page before its first heading belong to nothing."""
    left = without_boxes(lines, box).where(F.trim("text") != "")
    doc = Window.partitionBy("doc")
    at = F.struct(*ORDER)
    left = left.withColumn("_end", F.min(F.when(F.col("text").rlike(recap), at)).over(doc)).withColumn("_task", F.min(F.when(F.col("text").rlike(exercise), at)).over(doc))
    item = F.col("text").rlike(r"^\s*[a-z]\)\s")
    tier = F.when(item, 2).when(F.col("size").between(*topic), 1).when(F.col("size").between(*sub), 2)
    by = doc.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tasks = left.where("_task IS NOT NULL AND struct(page, line_no) > _task")
    told = tasks.select("doc", F.lit("exercise").alias("kind"), F.row_number().over(doc.orderBy(*ORDER)).cast("long").alias("ordinal"), F.lit(None).cast("string").alias("name"), F.trim("text").alias("text"))
    body = left.where("(_end IS NULL OR struct(page, line_no) < _end) AND (_task IS NULL OR struct(page, line_no) < _task)").withColumn("tier", tier)
    body = body.withColumn("ordinal", F.sum(F.col("tier").isNotNull().cast("int")).over(by)).where("ordinal > 0")
    parts = F.array_sort(F.collect_list(F.when(F.col("tier").isNull(), F.struct(*ORDER, "text"))))
    text = F.array_join(F.transform(parts, lambda x: x["text"]), "\n")
    topics = body.groupBy("doc", "ordinal").agg(F.max("tier").alias("t"), F.max(F.when(F.col("tier").isNotNull(), F.trim("text"))).alias("name"), text.alias("text"))
    kind = F.when(F.col("t") == 1, "topic").otherwise("sub-topic")
    return topics.select("doc", kind.alias("kind"), "ordinal", "name", "text").unionByName(told)


def banner_runs(spans: DataFrame, least: float = 13) -> DataFrame:
    """doc, color, run, text, size: on each first page the spans of a colour other than the body's, larger than `least` points, put together: those of one row that
    follow each other within a letter's width, and rows of nearly one size under each other. A single capital set right before a row of its colour (a
    drop cap) is the row's first letter."""
    from studyloom.operators.layout import dominant_color

    body = dominant_color(spans).withColumnRenamed("color", "body")
    own = spans.where(F.col("page") == 0).where(F.col("size") > least).join(body, "doc").where(F.col("color") != F.col("body"))
    by = Window.partitionBy("doc", "color").orderBy("y0", "x0", "line_no")
    before = {c: F.lag(c).over(by) for c in ("y0", "x1", "size", "text")}
    row = (F.abs(F.col("y0") - before["y0"]) <= 0.3 * F.col("size")) & (F.col("x0") - before["x1"] <= F.col("size"))
    below = (F.col("y0") - before["y0"]).between(0, 1.6 * F.greatest(F.col("size"), before["size"])) & (F.abs(F.col("size") - before["size"]) <= 0.15 * before["size"])
    cap = row & (F.col("x0") - before["x1"] < 0.15 * F.col("size")) & F.trim(before["text"]).rlike(r"^\p{Lu}$")
    marked = own.withColumn("_new", (~F.coalesce(row | below, F.lit(False))).cast("int")).withColumn("_cap", F.coalesce(cap, F.lit(False)))
    marked = marked.withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    piece = F.struct("y0", "x0", "line_no", F.when(F.col("_cap"), F.trim("text")).otherwise(F.concat(F.lit(" "), F.trim("text"))).alias("t"))
    joined = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), ""))
    return marked.groupBy("doc", "color", "run").agg(joined.alias("text"), F.max("size").alias("size"))


def banner_title(runs: DataFrame) -> DataFrame:
    """doc, title: of runs shaped like a title and not named a unit, of colours that have one run, or two of which one is larger, the largest, then longest, then
    first by text."""
    from studyloom.operators.layout import title_case

    shaped = runs.where(title_case(F.col("text")) & ~F.col("text").rlike(r"(?i)^unit\b"))
    color = Window.partitionBy("doc", "color")
    n = shaped.withColumn("n", F.count(F.lit(1)).over(color)).withColumn("big", F.max("size").over(color)).withColumn("small", F.min("size").over(color))
    fit = n.where("n = 1 OR (n = 2 AND big > small AND size = big)")
    best = F.min_by("text", F.struct((-F.col("size")).alias("s"), (-F.length("text")).alias("l"), "text"))
    return fit.groupBy("doc").agg(best.alias("title"))
