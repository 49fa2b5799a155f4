"""Product lists whose elements run several products together, parted by ordered rules.

Every rule is a column expression over one element, which becomes one or more; the first that applies decides. Cuts are
set as marks by a pattern that takes all that stands before them, as Spark has no function that gives places of matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"
_F = "(?isU)"  # any case, dots take all, letters of all scripts

# Contexts that are no products of their own, and words that belong to what stands before them.
IGNORED = ["broad-spectrum", "anticancer", "peptide", "cyclic lipopeptide", "polyketide", "macrocyclic peptide", "polyene macrolide", "beta-lactam", "macrolide", "nucleoside", "antifungal polyketide"]
TAILS = ["phosphate", "carboxylate"]
IC_ACID = r"\b\w+?ic\b\s+acid"
MODIFIER = r"\b(?:N-?acyl|\w+yl)\b\s*"
ATE = r"\b\w+ate\b"
FATTY = r"\bfatty acid\s+(?:\w+yl\b|\w+esters?\b|\(?[a-z]{1,4}\)?\b)"
NAMED = r"\b(antibiotic|anti-?parasitic)s?(?:\s+\([^)]+\))?\s+(\w+in)\b"


def _pieces(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, MARK), lambda p: F.trim(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))), lambda p: p != "")


def _cut(item: Column, before: str, after: str = "") -> Column:
    """item with a mark behind the first match of before that after follows; without one as it is."""
    ahead = f"(?={after})" if after else ""
    return F.regexp_replace(item, f"{_F}^(.*?{before}){ahead}", f"$1{MARK}")


def _acid(item: Column, keep_all: bool) -> Column:
    number = lambda p: F.size(F.regexp_extract_all(item, F.lit(_F + p), F.lit(0)))
    # the first acid stays with what stands before it
    acids = F.regexp_replace(item, f"{_F}(?:{MODIFIER})?{IC_ACID}", f"{MARK}$0")
    rules = [
        (number(IC_ACID) > 1, _pieces(F.regexp_replace(acids, f"{_F}^(.*?){MARK}", "$1"))),
    ]
    for before, after in ((r"\bacid\s+", r"\w+(?:ine|one)\b"), (r"\bacid(?:\s+\([^)]+\))?\s+", r"\S+(?:ine|one)\b")):
        rules.append((item.rlike(f"{_F}{before}(?={after})"), _pieces(_cut(item, before, after))))
    rules.append((item.rlike(_F + FATTY), F.array(item)))
    acid, compound = r"\bacid(?!\s+\([\w-]+\))", r"\s+\(?[\w-]+(?:ine|one|acid|lactone|ol|al|ate|amide)?\b"
    rules.append((item.rlike(f"{_F}{acid}(?={compound})"), _pieces(_cut(item, acid, compound))))
    # two words in -ate
    behind = F.element_at(F.split(_cut(item, ATE), MARK), 2)
    last = lambda text: F.element_at(F.split(F.regexp_replace(text, r"(?U)\s+$", ""), r"(?U)\s+"), -1)
    between, before = last(F.regexp_extract(behind, f"{_F}^(.*?){ATE}", 1)), last(F.regexp_extract(item, f"{_F}^(.*?){ATE}", 1))
    second = F.regexp_extract(behind, f"{_F}^.*?({ATE})", 1)
    whole, first = F.array(item), _pieces(_cut(item, ATE))
    enzyme = F.instr(item, between) + F.length(between)
    at_enzyme = _pieces(F.concat(F.substring(item, F.lit(1), enzyme - 1), F.lit(MARK), F.substring(item, enzyme, F.length(item))))
    two = (
        F.when(F.left(behind, F.lit(1)).isin("-", "("), whole if keep_all else F.array().cast("array<string>"))
        .when(between.rlike(_F + r"\w+ase$"), at_enzyme)
        .when(before.endswith("yl"), first)
        .when(F.lower(second).isin(*TAILS), whole)
        .otherwise(first)
    )
    rules.append((number(ATE) > 1, two))
    out = F.when(item.isNull(), whole)
    for test, parts in rules:
        out = out.when(test, parts)
    return out.otherwise(whole)


def _null_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def split_acids(values: Column, keep_all: bool = True) -> Column:
    """A list with its elements parted at acids and at words in -ate; null elements stay; an empty list is null.

    In order: before each further `-ic acid` (and the `-yl` in front of it); behind `acid` before a word in -ine or -one,
    with or without brackets between; behind `acid` before any other word, but for fatty acid esters; behind the first
    of two words in -ate, or behind the enzyme between them, but not before a phosphate or carboxylate unless a `-yl`
    stands in front. Without keep_all an element whose first -ate is followed by a hyphen or bracket is lost.
    """
    return _null_if_empty(F.flatten(F.transform(values, lambda x: _acid(x, keep_all))))


def _antibiotic(item: Column) -> Column:
    pattern = _F + NAMED
    names = F.regexp_extract_all(item, F.lit(pattern), F.lit(2))
    gaps = F.transform(F.split(item, pattern, -1), lambda g: F.regexp_replace(g, r"(?U)^\s+|\s+$", ""))
    kept = lambda g: (g != "") & ~F.lower(g).isin(*IGNORED)
    both = F.flatten(F.zip_with(gaps, names, lambda g, n: F.concat(F.filter(F.array(g), kept), F.array_compact(F.array(n)))))
    generic = rf"(?iU)^\s*(?:{'|'.join(IGNORED)})?\s*antibiotics?\s*$"
    return (
        F.when(item.isNull(), F.array(item))
        .when(item.rlike(r"(?iU)\bantibiotic\s+resistance\b"), F.array().cast("array<string>"))
        .when(F.size(names) > 0, both)
        .when(item.rlike(generic), F.array(F.lit("antibiotic")))
        .otherwise(F.array(item))
    )


def split_antibiotics(values: Column) -> Column:
    """A list in which `antibiotic x-in` gives way to x-in and what stands around it; null elements stay; an empty list is null.

    Contexts that only tell the kind (IGNORED) go; elements on resistance go; a kind with `antibiotic` alone is `antibiotic`.
    """
    return _null_if_empty(F.flatten(F.transform(values, _antibiotic)))
