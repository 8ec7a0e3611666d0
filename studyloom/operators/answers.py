"""Equivalent answers: chemical identities, reviewed aliases, and the grading of a typed answer, as expressions over small fixed tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyloom.operators.names import ELEMENTS, is_formula

#: fixed values: substances with their formulas and other names
SUBSTANCES = {
    "magnesium oxide": ("MgO",),
    "water": ("H2O",),
    "hydrogen peroxide": ("H2O2",),
    "carbon dioxide": ("CO2",),
    "carbon monoxide": ("CO",),
    "cobalt": ("Co",),
    "sodium chloride": ("NaCl",),
    "calcium oxide": ("CaO", "quicklime"),
    "calcium hydroxide": ("Ca(OH)2", "slaked lime"),
    "calcium carbonate": ("CaCO3",),
    "sodium hydroxide": ("NaOH",),
    "sodium carbonate": ("Na2CO3",),
    "sodium hydrogen carbonate": ("NaHCO3", "sodium bicarbonate"),
    "sulfuric acid": ("H2SO4", "sulphuric acid"),
    "hydrochloric acid": ("HCl",),
    "zinc sulfate": ("ZnSO4", "zinc sulphate"),
}
#: fixed values: reviewed equivalents that are no substances
TERMS = (
    ("large", "big"),
    ("deoxyribonucleic acid", "DNA"),
    ("hydrogen gas", "H2 gas"),
    ("photosynthesis", "the process of photosynthesis"),
    ("atom", "atoms"),
    ("molecule", "molecules"),
)


def formula_shaped(text: str) -> bool:
    """is_formula for one text: symbols of elements with numbers, groups in brackets."""
    shape = re.fullmatch(r"(?:[A-Z][a-z]?\d*|\([A-Za-z0-9]+\)\d*)+", text)
    return bool(shape) and all(s in ELEMENTS for s in re.findall(r"[A-Z][a-z]?", text))


def _unique(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """The keys that lead to one value only."""
    found: dict[str, set[str]] = {}
    for key, value in pairs:
        found.setdefault(key, set()).add(value)
    return {k: next(iter(v)) for k, v in found.items() if len(v) == 1}


ALIASES = [(name, alias) for name, aliases in SUBSTANCES.items() for alias in aliases]
BY_NAME = {name: name for name in SUBSTANCES} | {a.lower(): name for name, a in ALIASES if not formula_shaped(a)}
BY_ALIAS = _unique([(a, name) for name, a in ALIASES])
BY_SMALL = _unique([(a.lower(), name) for name, a in ALIASES if formula_shaped(a)])  # "co" is two substances, so none
TERM_LISTS = {term.lower(): list(group) for group in reversed(TERMS) for term in group}


def _looked_up(values: dict, key: Column) -> Column:
    flat = [x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.try_element_at(F.create_map(*flat), key)


def folded(c: Column) -> Column:
    """Case folding: small letters, and the letters that lower case keeps apart."""
    return F.replace(F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")), F.lit("ſ"), F.lit("s"))


def substance(c: Column) -> Column:
    """The substance a term names, else NULL: a name in any case, a formula as it is written, a small-letter formula only if one substance has it."""
    return F.coalesce(_looked_up(BY_NAME, folded(c)), _looked_up(BY_ALIAS, c), F.when(F.lower(c) == c, _looked_up(BY_SMALL, c)))


def accepted(c: Column) -> Column:
    """Reviewed equivalents of an answer, without the answer itself, in their order."""
    chemical = _looked_up({name: [name, *aliases] for name, aliases in SUBSTANCES.items()}, substance(c))
    others = F.coalesce(chemical, _looked_up(TERM_LISTS, folded(c)), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(others, lambda v: v != c))


def typed_right(key: Column, given: Column, numeric) -> Column:
    """Whether a typed answer is right. key, given: with single spaces, case kept; numeric: a column's plain number or NULL.

    An empty answer is wrong; a number must be that number; a substance any of its names; a formula itself; else case doesn't matter
    and reviewed equivalents count."""
    terms = F.exists(accepted(key), lambda v: folded(v) == folded(given))
    return (
        F.when(F.coalesce(given, F.lit("")) == "", False)
        .when(numeric(key).isNotNull(), numeric(key).eqNullSafe(numeric(given)))
        .when(substance(key).isNotNull(), substance(key).eqNullSafe(substance(given)))
        .when(is_formula(key), key == given)
        .otherwise((folded(key) == folded(given)) | terms)
    )
