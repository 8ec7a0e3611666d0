"""Problem 10: texts cut off by field limits or in transfer.

Method. For every source the discrete hazard of each length (texts that end at it over texts that reach
it) is computed by window functions over the length histogram, for four measures: characters and bytes of the
text as it is and without what was put behind a cut (white space, ellipsis, half a tag). Each hazard is tested against
the pooled hazard of its neighbours with the Chernoff bound of the Poisson tail, and Benjamini-Hochberg control of the
false discovery rate over the lengths of a source picks the limits. A text is cut if its ending is certainly
incomplete (inside a word, number, tag or sentence), or if it has a significant length and ends without a closing mark (an item, a label's
list or a heading, which are whole endings at any other length).

Scale. Texts are read once, in one pass that returns a few numbers per text; the histogram is a partial
aggregation, and windows run over distinct lengths, not over texts. Limits are few and joined by key.

Defined results: NULL, empty and blank texts aren't cut; a NULL source is a source of its own; rows of one
repeated doc_id are one document, cut if one of its rows is; a NULL doc_id isn't reported; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.session import cut, spread

BEHIND = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\xad\ufe0f*_~`\u2600-\u27bf\U0001f000-\U0001faff]")  # one character that may follow a cut
NONE = "\x00"  # stands for a NULL source as a key
BREAKS = "\r\n\x0b\x0c\u2028\u2029"
TAIL = 300  # characters in which a mark behind a cut is looked for; no mark is longer
MARK = re.compile(r"(?:\.\.\.|…|\[(?:more|\.\.\.|…)\]|\((?:more|\.\.\.|…)\)|<\/?[a-zA-Z]{0,8}|&#?[a-zA-Z0-9]{0,8}|�+)$")
CLOSE = re.compile(r"[.!?।॥。！？]$")
QUOTED = re.compile(r"[.!?।॥。！？…][)\]\"'”’»]+$")
# an abbreviation or half a number at the end: the sentence went on
OPEN_STOP = re.compile(r"(?:\b(?:e\.g|i\.e|z\.B|Fig|Abb|No|vs|cf|approx|p\. ?ex)\.|\b(?:about|environ|etwa|Fig\.) \d+\.)$")
NUMBERING = re.compile(r"^(?:(?:Step|Q|Ex|No)\.?\s*)?\d{1,3}[.)]$|^\(?[a-zA-Zivx]{1,4}\)$")
# last lines that are whole without a closing mark
CLOSED_LINES = re.compile(
    r"^(?:\|.*\|"  # a row of a table
    r"|[-•>—–] ?\S.*"  # an item, a quoted rule, a signature
    r"|[^\W\d_]+: (?:[^\s,.]+, )*[^\s,.]+"  # a label with a list
    r"|[^\W\d_]+: [\d\W]*(?<=\d) \w+"  # a label with an amount
    r"|[^\W\d_]+: \S+(?:\s+\d+-\w+)+"  # a label with a key of answers
    r"|\w+ = [\d\s/+*×÷.,-]+"  # a formula
    r"|[^\W\d_]+(?: \w+){0,3} \d[\d./-]*"  # a short line that ends with a number
    r"|[\[(][^\])]*[\])]|.*[:;]-?[)(])$"  # all in brackets, a smiley
)


OPTIONS = re.compile(r"\d+\) [^.!?]")
NEXT_OPTION = re.compile(r"\s\d+\) [^.!?]")


def closed_line(line: str) -> bool:
    """Whether a last line is whole without a closing mark; options in a line are looked at in linear time."""
    return bool(CLOSED_LINES.match(line)) or bool(OPTIONS.match(line) and not re.search("[.!?]", line) and NEXT_OPTION.search(line, 4))


def ending(text: str) -> tuple[int, str]:
    """(how surely the text is cut: 0 not, 1 only at a suspicious length, 2 in any case; the text without what follows a cut)."""
    end, marked = len(text), False
    while True:
        while end and BEHIND.match(text, end - 1):
            end -= 1
        m = MARK.search(text[max(0, end - TAIL) : end])
        if not m or m.end() == m.start():
            break
        marked, end = True, end - (m.end() - m.start())
    core = text[:end]
    if not core.strip():
        return 0, text
    if marked:
        kept = core.rstrip()[-TAIL:]
        return (0 if CLOSE.search(kept) or QUOTED.search(kept) else 2), core
    line = core[max(core.rfind(c) for c in BREAKS) + 1 :].strip()
    if OPEN_STOP.search(line) or NUMBERING.match(line):
        return 2, core
    if CLOSE.search(line) or QUOTED.search(line):
        return 0, core
    if closed_line(line) or _closed_over_lines(core):
        return (0 if core[-1] in "|])" else 1), core
    if len(line.split(None, 6)) <= 6 and line[:1].isupper() and line == line.title() and "." not in line:
        return 1, core  # like a heading
    return 2, core


def _closed_over_lines(core: str) -> bool:
    """Whether a whole ending is only broken over two lines, or is in brackets that open before the line does."""
    if core[-1] in ")]":
        at = core.rfind("(" if core[-1] == ")" else "[")
        before = core[max(0, at - TAIL) : max(at, 0)].rstrip()
        return at >= 0 and (not before or core[at - 1] in "\r\n" or bool(CLOSE.search(before) or QUOTED.search(before)))
    lines = [x.strip() for x in re.split(f"[{BREAKS}]+", core)]
    if len(lines) < 2 or len(lines[-2]) + len(lines[-1]) > 60:
        return False
    both = f"{lines[-2]} {lines[-1]}"
    if both[0] in "-•>—–":  # an item goes on in the next line, it isn't followed by a new sentence
        return not lines[-1][:1].isupper() and len(lines[-1].split()) < 4
    return closed_line(both)


def _measured(batches):
    for batch in batches:
        ids, sources, texts = (c.to_pylist() for c in batch.columns)
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for i, s, t in zip(ids, sources, texts):
            if t is None or not t.strip():
                values = (i, s, 0, None, None, None, None)
            else:
                level, core = ending(t)
                raw, bare = len(t.encode("utf-8", "surrogatepass")), len(core.encode("utf-8", "surrogatepass"))
                values = (i, s, level, len(t), raw, len(core), bare)
            for column, value in zip(out, values):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4)
        names = ["doc_id", "source", "level", "chars", "bytes", "core_chars", "core_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def measured(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")
    )
    return spread(rows).mapInArrow(
        _measured, "doc_id long, source string, level int, chars long, bytes long, core_chars long, core_bytes long"
    )


def _long(m: DataFrame) -> DataFrame:
    kinds = ("chars", "bytes", "core_chars", "core_bytes")
    return m.where("chars IS NOT NULL").select(
        "doc_id",
        F.coalesce("source", F.lit(NONE)).alias("source"),
        F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("length")) for k in kinds))).alias("m"),
    ).select("doc_id", "source", "m.*")


def limits(m: DataFrame, **how) -> DataFrame:
    """source, measure, length, texts, expected: the lengths at which texts end too often."""
    return _limits(m, **how).withColumn("source", F.nullif(F.col("source"), F.lit(NONE)))


def _limits(m: DataFrame, near: int = 25, rate: float = 0.001, fewest: int = 3) -> DataFrame:
    """near: neighbours are the lengths at most so far away; rate: the false-discovery rate; fewest: texts that a limit needs."""
    counts = _long(m).groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("source", "measure").orderBy("length")
    down = by_length.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    around = by_length.rangeBetween(-near, near)
    hazard = (
        counts.withColumn("reach", F.sum("n").over(down))
        .withColumn("span", 1 + F.least(F.lit(near), F.col("length") - 1) + near)
        .withColumn("beside", F.sum("n").over(around) - F.col("n"))
        .withColumn("held", F.max("reach").over(around))
    )
    # pooled hazard of the neighbours, half a text added: at most one text per length is expected by chance
    expected = hazard.withColumn("expected", F.col("reach") * (F.col("beside") + 0.5) / (F.col("span") * F.col("held")))
    bound = F.expr("CASE WHEN n > expected THEN -(n * ln(n / expected) - n + expected) ELSE 0 END")
    ranked = (
        expected.withColumn("log_p", bound)
        .withColumn("rank", F.rank().over(Window.partitionBy("source", "measure").orderBy("log_p")))
        .withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy("source", "measure")))
    )
    passed = ranked.where(F.col("log_p") <= F.log(F.lit(rate) * F.col("rank") / F.col("tests"))).groupBy("source", "measure")
    last = passed.agg(F.max("rank").alias("last"))
    return (
        ranked.join(last, ["source", "measure"])
        .where((F.col("rank") <= F.col("last")) & (F.col("n") >= fewest))
        .select("source", "measure", "length", F.col("n").alias("texts"), F.round("expected", 4).alias("expected"))
    )


def judged(df: DataFrame, **how) -> DataFrame:
    """doc_id, source, cut (boolean), at_limit (boolean) of every row."""
    m = cut(measured(df))  # a few numbers per text, used three times: the texts are judged once
    at = _long(m).join(_limits(m, **how).select("source", "measure", "length"), ["source", "measure", "length"])
    found = at.select("doc_id").distinct().withColumn("at_limit", F.lit(True))
    return m.join(found, "doc_id", "left").select(
        "doc_id",
        "source",
        F.coalesce("at_limit", F.lit(False)).alias("at_limit"),
        ((F.col("level") == 2) | ((F.col("level") == 1) & F.coalesce("at_limit", F.lit(False)))).alias("cut"),
    )


def cut_documents(df: DataFrame) -> DataFrame:
    return judged(df).where("cut AND doc_id IS NOT NULL").select("doc_id").distinct()


def cut_shares(df: DataFrame) -> DataFrame:
    """How often each source cuts texts: texts, cut ones, the share, and how many of them at a field limit."""
    return (
        judged(df)
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.count_if("cut").alias("cut"),
            F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit"),
        )
        .withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
    )
