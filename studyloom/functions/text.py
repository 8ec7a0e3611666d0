"""Column expressions over text. White space means Unicode white space, as in `(?U)\\s`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(c: Column | str) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), "^ | $", "")


def single_spaced(c: Column | str) -> Column:
    """Stripped, runs of white space as one space, case kept."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def text_hash(c: Column | str) -> Column:
    return F.sha2(normal(c), 256)


def uniform(*parts: Column | str) -> Column:
    """A repeatable number in [0, 1) from a hash of the parts; equal in any engine that has SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def order_key(seed: str, c: Column | str) -> Column:
    """A seeded random order that is the same on every run."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), c), 256)


def word_set(c: Column | str) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(normal(c), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def natural_key(c: Column | str) -> Column:
    """Numbers of a dotted number, for sorting 1.10 behind 1.2."""
    return F.transform(F.filter(F.split(c, r"\D+"), lambda x: x != ""), lambda x: x.cast("int"))


#: fixed values: words that stay small inside a title
MINOR = (
    "a", "an", "the", "of", "in", "on", "and", "or", "to", "for", "at", "by", "with", "from", "as", "is", "are", "it", "its", "his", "her",
    "our", "your", "their", "up", "down", "into", "onto", "&",
)


def headline(c: Column | str) -> Column:
    """Headline case: minor words stay small but at the start."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    big = lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))
    core = lambda w: F.regexp_replace(w, r"^[.,:;!?()'\"]+|[.,:;!?()'\"]+$", "")
    return F.array_join(F.transform(words, lambda w, n: F.when((n > 0) & core(w).isin(*MINOR), w).otherwise(big(w))), " ")


def strip_fence(c: Column | str) -> Column:
    """The inside of one Markdown code fence, or the text itself."""
    inside = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inside != "", inside).otherwise(F.trim(c))


def collapse_runs(c: Column | str) -> Column:
    """A piece of two or more characters that stands three times or more in a row, once."""
    return F.regexp_replace(c, r"(.{2,}?)\1{2,}", "$1")


def sentences(c: Column | str) -> Column:
    """Split behind . ! ? and white space, but not behind Fig."""
    return F.split(c, r"(?<!Fig\.)(?<=[.!?])\s+")
