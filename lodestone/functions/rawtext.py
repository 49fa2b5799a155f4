"""Raw article text made ready for extraction, for products and for genes, whose capitals tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import unit_marks, without_citations, without_roots
from .rules import Rule, rewrite
from .terms import sentences_of

# Patterns below must equal the surveyed ones.
LINKS = [
    Rule(r"(?i)10.\d{4,9}/[-._;()/:A-Z0-9]+", ""),
    Rule(r"https?:(?://|\\{4})+[\w:#@%/;$()~?\\+-=.&]*", ""),
    Rule(r"\[\s\]\.", ""),
]
SPACES = [Rule(r"(?<=\d)\.(?=\d)", ""), Rule(r"(?U)\s+", " "), Rule('"', ""), Rule("±", " ")]
#: Roots that matter to genes and stay, and those that another takes the place of.
GENE_KEEPS = ["express", "activ", "effect", "increas", "accumulat"]
GENE_SWAPS = {"engineer": "frequen", "enhanc": "additionally"}


def lower_words(text: Column, keep: str | None = None) -> Column:
    """Words of two characters or more in lower case, but for those that match keep; everything else stays."""
    word = lambda t: t.rlike(r"(?U)^\w{2,}$") & (~t.rlike(keep) if keep else F.lit(True))
    # what is in lower case already is told without a pattern
    lowered = lambda t: F.when(F.lower(t) == t, t).when(word(t), F.lower(t)).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W+"), 0), lowered), "")


def hyphenated_bracket(text: Column) -> Column:
    """The first part in brackets with hyphens for its blanks, wherever the same part stands."""
    # an array of one element binds the text, which would be made again, by all rules before, at each mention otherwise
    found = F.transform(F.array(text), lambda t: F.struct(t.alias("t"), F.regexp_extract(t, r"\([^)]*\)", 0).alias("part")))
    joined = lambda x: F.replace(x["t"], x["part"], F.replace(x["part"], F.lit(" "), F.lit("-")))
    return F.transform(found, lambda x: F.when(x["part"] != "", joined(x)).otherwise(x["t"]))[0]


def raw_text(text: Column, gene: bool = False) -> Column:
    """Links, empty marks and citations out, units and decimal dots as words, one blank, the first bracket as one word, lower case.

    With gene, words in capitals with digits behind, and words that end in a capital, stay. Null stays null.
    """
    plain = hyphenated_bracket(rewrite(unit_marks(without_citations(rewrite(text, LINKS))), SPACES))
    return lower_words(plain, r"^[A-Z]{2,}\d*$|[A-Z]$" if gene else None)


def gene_roots(roots: list[str]) -> list[str]:
    """The roots to take out of texts on genes."""
    return [GENE_SWAPS.get(r, r) for r in roots if r not in GENE_KEEPS]


def gene_sentences(text: Column, roots: list[str]) -> Column:
    """Sentences of a text on genes: raw text, markup out, roots out, cut at sentence ends. Null stays null."""
    bare = F.regexp_replace(raw_text(text, gene=True), "<.*?>", "")
    return F.when(text.isNotNull(), sentences_of(without_roots(bare, gene_roots(roots))))
