"""Names and formulas: cleaning of headings, garbled text, chemical identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyloom.functions.text import MINOR

#: fixed values: symbols of the elements in the order of their numbers
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


# fixed format: element symbols and groups in brackets, each with a number or none
def is_formula(c: Column) -> Column:
    """Element symbols and groups in brackets with numbers, every symbol an element."""
    symbols = F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]?)"), F.lit(1))
    return c.rlike(r"^(?:[A-Z][a-z]?\d*|\([A-Za-z0-9]+\)\d*)+$") & F.forall(symbols, lambda s: s.isin(*ELEMENTS))


def identities(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """term -> the substance it names, or NULL. aliases: identity, alias.

    A formula must agree in case; a name may differ; a lower-case formula counts if only one substance's is spelled so."""
    a = aliases.withColumn("low", F.lower("alias")).withColumn("formula", is_formula(F.col("alias")))
    exact = a.groupBy("alias").agg(F.min("identity").alias("i1"), F.countDistinct("identity").alias("n1"))
    names = a.where(~F.col("formula")).groupBy("low").agg(F.min("identity").alias("i2"))
    small = a.where("formula").groupBy("low").agg(F.min("identity").alias("i3"), F.countDistinct("identity").alias("n3"))
    t = terms.select("term").distinct().withColumn("l", F.lower("term"))
    return (
        t.join(exact, t["term"] == exact["alias"], "left").drop("alias")
        .join(names, F.col("l") == names["low"], "left").drop("low")
        .join(small, F.col("l") == small["low"], "left").drop("low")
        .select("term", F.coalesce(F.when(F.col("n1") == 1, F.col("i1")), F.col("i2"), F.when((F.col("n3") == 1) & (F.col("term") == F.col("l")), F.col("i3"))).alias("identity"))
    )


def garbled(text: Column, vocabulary: list[str], least: float = 0.35, words: int = 4) -> Column:
    """Fewer than `least` of at least `words` words are known, or control characters. The vocabulary is a bounded list."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{2,})"), F.lit(1))
    known = F.filter(found, lambda w: F.array_contains(F.array(*(F.lit(v) for v in vocabulary)), w))
    return ((F.size(found) >= words) & (F.size(known) < least * F.size(found))) | text.rlike(r"[\x10-\x1f]")


def clean_name(c: Column) -> Column:
    """A heading without control characters, glued letter spacing, stray space before marks and doubled white space."""
    plain = F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")
    glued = F.regexp_replace(plain, r"(?<=\b\p{Lu}) (?=\p{Lu}\b)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(glued, r"\s+([,.;:!?])", "$1"), r"\s+", " "))


def continues_title(c: Column) -> Column:
    """Whether a line carries a title on: capitals or half of its longer words with one; no prose openers, no closing mark."""
    t = F.trim(c)
    long_ = F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 3)
    big = F.filter(long_, lambda w: w.rlike(r"^\p{Lu}"))
    prose = t.rlike(r"(?i)^(the|this|these|it|in this|we|you|if|when|as|for example)\b.*\b(is|are|was|were|has|have|can)\b")
    return ~prose & ~t.rlike(r"[.!?]$") & ((F.upper(t) == t) | (F.size(big) * 2 >= F.size(long_)))


#: fixed values: abbreviations that stay in capitals
ACRONYMS = (
    "ac dc dna rna mrna trna rrna atp adp amp nad nadh nadp nadph fad fadh gdp gtp emf lcr mtp sti stis std stds hiv aids iucd iupac vsepr ph uv ir nmr "
    "co2 h2o who rch bod ddt pcr elisa"
).split()
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def glued(c: Column) -> Column:
    """Three or more single letters between spaces as one word; where words end inside such a run isn't known."""
    return F.regexp_replace(c, r"(?<=(?:^| )\p{L}) (?=\p{L} \p{L}(?: |$))|(?<=(?:^| )\p{L} \p{L}) (?=\p{L}(?: |$))", "")


def display_name(c: Column) -> Column:
    """A name as it is shown: single spaces, letter-spaced runs glued, capitals as headline case with small minor words and known abbreviations, no space before
    a mark. A name that isn't all capitals keeps its case."""
    bare = glued(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    words = F.split(bare, " ")
    has = lambda w: w.rlike("[A-Za-z]")
    first = F.array_position(F.transform(words, has), F.lit(True)) - 1
    runs = lambda w: F.regexp_extract_all(w, F.lit(f"[{LETTERS}]+|[^{LETTERS}]+"), F.lit(0))

    def cased(run: Column, n: Column) -> Column:
        low = F.lower(run)
        capital = F.concat(F.upper(F.substr(low, F.lit(1), F.lit(1))), F.substr(low, F.lit(2)))
        return F.when(low.isin(*ACRONYMS), F.upper(run)).when(low.isin(*MINOR) & (n != first), low).otherwise(capital)

    shown = F.transform(words, lambda w, n: F.when(has(w), F.array_join(F.transform(runs(w), lambda r: cased(r, n)), "")).otherwise(w))
    headline_ = F.regexp_replace(F.array_join(shown, " "), r"(?<=[’'])S\b", "s")
    capitals = (F.upper(bare) == bare) & has(bare)
    return F.regexp_replace(F.when(capitals, headline_).otherwise(bare), r"\s+([?:;,.])", "$1")


def garbled_lines(lines: DataFrame, vocabulary: DataFrame, least: float = 0.35, words: int = 4) -> DataFrame:
    """Lines (chunk_id, line) of at least `words` words of which fewer than `least` are in the vocabulary (word), a frame of any size; with both counts."""
    found = lines.select("chunk_id", "line", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("([a-z]{2,})"), F.lit(1))).alias("word"))
    known = vocabulary.select("word").distinct().withColumn("k", F.lit(1))
    n = found.join(known, "word", "left").groupBy("chunk_id", "line").agg(F.count(F.lit(1)).alias("words"), F.count("k").alias("known"))
    return n.where((F.col("words") >= words) & (F.col("known") < least * F.col("words")))
