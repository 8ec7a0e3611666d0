"""Problem 3: texts over a size limit cut at natural boundaries, with overlap.

Method: a recursive hierarchy of separators. A text over the limit is split into sections (before
heading lines); what is still too long into paragraphs, then sentences, words, and characters (never inside a grapheme: a base
character keeps its marks, joiners, variation and skin-tone signs). Consecutive atoms are packed greedily up to the limit. Each
piece but the first starts with up to `overlap` characters of the end of the one before, from the earliest sentence or else word
start inside that window. Pieces are spans of the text: without their overlaps they add up to it exactly.

Scale. One pass over the rows; a text never leaves its row before it is cut. The numbering of a topic's
chunks is shifted by the pieces of the chunks before: sums per run of 1,024 indexes first, then a window over those few sums and one within
each run, so no topic's rows meet in one task even if one topic holds a third of them.

Defined results: sizes are code points; texts up to the limit are one piece; a NULL or empty text has one
piece with that text; rows of one chunk_id and text are one chunk; without a NULL chunk_index nothing is shifted (NULL counts as 0).
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3000, 200

# starts of the units of each level, the break itself staying with the unit before
SECTION = re.compile(r"\n(?=[^\S\n]*(?:#{1,6} |\d+(?:\.\d+)+\.? +\S|(?:Chapter|CHAPTER|Unit|Activity|Exercises?)\b[^\n]{0,80}\n))")
PARAGRAPH = re.compile(r"\n[^\S\n]*\n+|(?<=[.!?।:\"”)])[^\S\n]*\n(?=[^\S\n]*\S)")
SENTENCE = re.compile(r"(?<!Fig\.)(?<!e\.g\.)(?<!i\.e\.)(?<=[.!?।])[\"'”’)\]]*\s+|\n+")
WORD = re.compile(r"\s+")
LEVELS = (SECTION, PARAGRAPH, SENTENCE, WORD)


def _glued(text: str, at: int) -> bool:
    """Whether a cut before text[at] would part a grapheme."""
    c, before = text[at], text[at - 1]
    return (
        unicodedata.category(c)[0] == "M"
        or c in "‍️︎"
        or before == "‍"
        or "\U0001f3fb" <= c <= "\U0001f3ff"
        or (before == "\r" and c == "\n")
        or unicodedata.combining(c) != 0
    )


def _characters(text: str, a: int, b: int, size: int) -> list[int]:
    ends, at = [], a
    while b - at > size:
        end = at + size
        low = max(at + 1, end - 64)
        while end > low and _glued(text, end):
            end -= 1
        if end == low:  # one endless grapheme
            end = at + size
        ends.append(end)
        at = end
    return [*ends, b]


def atoms(text: str, a: int, b: int, size: int, level: int = 0) -> list[int]:
    """Ends of consecutive units of at most `size` characters that make up text[a:b], at the coarsest level that allows it."""
    if b - a <= size:
        return [b]
    if level == len(LEVELS):
        return _characters(text, a, b, size)
    cuts = [m.end() for m in LEVELS[level].finditer(text, a, b) if a < m.end() < b]
    if not cuts:
        return atoms(text, a, b, size, level + 1)
    ends, at = [], a
    for end in (*cuts, b):
        ends.extend(atoms(text, at, end, size, level + 1))
        at = end
    return ends


def _overlap_start(text: str, low: int, end: int) -> int:
    """Where the repeated end of the piece before starts: at the earliest sentence, else word, else whole grapheme."""
    for level in (SENTENCE, WORD):
        for m in level.finditer(text, low, end):
            if low <= m.end() < end and (m.start() > low or level is WORD):
                return m.end()
    while low < end and low > 0 and _glued(text, low):
        low += 1
    return low


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, start of what is new, end) of each piece."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    ends = atoms(text, 0, len(text), limit - overlap)
    out: list[tuple[int, int, int]] = []
    start = new = 0
    at = 0
    for end in ends:
        if end - start > limit:
            out.append((start, new, at))
            new = at
            start = _overlap_start(text, max(out[-1][0], at - overlap), at)
        at = end
    out.append((start, new, at))
    return out


def _cut(limit: int, overlap: int):
    def run(batches):
        for batch in batches:
            keep, numbers, counts, fresh, texts = [], [], [], [], []
            for n, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spans = pieces(text, limit, overlap) if text else [(0, 0, 0)]
                for k, (start, new, end) in enumerate(spans):
                    keep.append(n)
                    numbers.append(k)
                    counts.append(len(spans))
                    fresh.append(new - start)
                    texts.append(text[start:end] if text else text)
            rest = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    *rest,
                    pa.array(numbers, pa.int32()),
                    pa.array(counts, pa.int32()),
                    pa.array(fresh, pa.int32()),
                    pa.array(texts, pa.string()),
                ],
                [*batch.schema.names[:-1], "piece_no", "pieces", "overlap", "text"],
            )

    return run


def cut_pieces(
    df: DataFrame, id_col: str = "chunk_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, carry: tuple[str, ...] = ()
) -> DataFrame:
    """chunk_id, carried columns, piece_no (from 0), pieces, overlap (characters repeated), text; one row for each piece."""
    rows = (
        df.select(
            F.col(id_col).cast("string").alias("chunk_id"), *carry, F.xxhash64(text).alias("_text"), F.col(text).cast("string").alias("text")
        )
        .dropDuplicates(["chunk_id", "_text"])
        .drop("_text")
    )
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(
        _cut(limit, overlap), f"chunk_id string{kinds}, piece_no int, pieces int, overlap int, text string"
    )


TOPIC = ("class", "subject", "source_file", "chapter", "topic", "topic_number")


def renumbered(df: DataFrame, run: int = 1024, **how) -> DataFrame:
    """The pieces with new_index: numbered on from chunk_index, later chunks of the topic making room for them."""
    cut = cut_pieces(df, carry=(*TOPIC, "chunk_index"), **how)
    at = F.coalesce(F.col("chunk_index"), F.lit(0))
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in TOPIC]
    extra = (
        cut.where("piece_no = 0 AND pieces > 1")
        .select(*key, at.alias("_at"), (F.col("pieces") - 1).alias("more"))
        .groupBy(*(f"_{c}" for c in TOPIC), "_at")
        .agg(F.max("more").alias("more"))
        .withColumn("_run", F.floor(F.col("_at") / run))
    )
    names = [f"_{c}" for c in TOPIC]
    runs = extra.groupBy(*names, "_run").agg(F.sum("more").alias("in_run"))
    before = Window.partitionBy(*names).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before_run", F.coalesce(F.sum("in_run").over(before), F.lit(0))).drop("in_run")
    within = Window.partitionBy(*names, "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    # (topic, index of a long chunk, pieces added up to and with it)
    steps = (
        extra.join(runs, [*names, "_run"])
        .withColumn("upto", F.col("before_run") + F.sum("more").over(within))
        .select(*names, "_at", "upto")
    )
    # runs without a long chunk take what the runs before have added
    keyed = cut.withColumns({f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in TOPIC}).withColumn("_at", at)
    places = (
        keyed.select(*names, "_at").distinct().withColumn("upto", F.lit(None).cast("long")).withColumn("_place", F.lit(0))
        .unionByName(steps.withColumn("_place", F.lit(1)))
        .withColumn("_run", F.floor(F.col("_at") / run))
    )
    top = places.groupBy(*names, "_run").agg(F.max("upto").alias("top"))
    top = top.withColumn("carried", F.coalesce(F.max("top").over(before), F.lit(0))).drop("top")
    inside = Window.partitionBy(*names, "_run").orderBy("_at", "_place").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        places.withColumn("seen", F.max("upto").over(inside))
        .where("_place = 0")
        .join(top, [*names, "_run"])
        .select(*names, "_at", F.coalesce("seen", "carried").alias("shift"))
    )
    return keyed.join(shift, [*names, "_at"]).select(
        "chunk_id", "chunk_index", (F.col("_at") + F.col("shift") + F.col("piece_no")).alias("new_index"), "piece_no", "pieces", "overlap", "text"
    )


def oversized(df: DataFrame, **how) -> DataFrame:
    """chunk_id of every chunk that had to be cut."""
    return cut_pieces(df, **how).where("pieces > 1 AND chunk_id IS NOT NULL").select("chunk_id").distinct()
