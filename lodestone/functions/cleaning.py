"""Rule tables for product names and article text, and the functions that apply them in order."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import Rule, rewrite

# Letters and names, patterns, endings and replacements below must equal the surveyed ones, in this order.

GREEK = [
    ("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("ε", "epsilon"), ("ζ", "zeta"), ("η", "eta"), ("θ", "theta"),
    ("ι", "iota"), ("κ", "kappa"), ("λ", "lambda"), ("μ", "mu"), ("ν", "nu"), ("ξ", "xi"), ("ο", "omicron"), ("π", "pi"),
    ("ρ", "rho"), ("σ", "sigma"), ("τ", "tau"), ("υ", "upsilon"), ("φ", "phi"), ("χ", "chi"), ("ψ", "psi"), ("ω", "omega"),
]
SHARP_S = "ß"  # counts as a beta

NAME_ENDS = [
    (r"\(-\)$", ""),
    (r"-$", ""),
    (r"^\([pRrSsNno]\)[-,]", ""),
    (r"^[pLlDdNno]?[-,]", ""),
    (r"^\(?\d?[RrSsdD],\d?[RrSsdD]\)?[-,]", ""),
    (r"^ʟʀ", ""),
    (r"^,-", ""),
    (r"^[sSrR][sSrR]-", ""),
    (r"^-", ""),
    (r"^\(?\d+,\d+\)?[-,]", ""),
    (r"--", ""),
    (r"-,-", ""),
    (r"^[sSrRdD](\d+)", r"$1"),
]
NAME_ISOMERS = [(r"^r+", "r"), (r"^rac-", ""), (r"^(trans[-,])", ""), (r"^(cis[-,])+", "")]
NAME_MARKS = [(r"[()\[\],\.\{\} ]", ""), (r"[()\+\-\[\],\.\{\} ]", "")]

#: pattern, replacement, whether it is matched literally
FAMILIES = [
    ("(-hydroxybutyrate)", "(hydroxybutyrate)", True),
    ("((hydroxybutyrate)", "(hydroxybutyrate)", True),
    (r"poly(hydroxyalkanoate)s?", "polyhydroxyalkanoate", False),
    (r"poly(hydroxyalkanoicacid)s?", "polyhydroxyalkanoate", False),
    (r"\bpolyhydroxyalkanoates?\b", "pha", False),
    (r"\bpolyhydroxyalkanoicacids?\b", "pha", False),
    (r"\bpolyhydroxyalkanoates?phas?\b", "pha", False),
    (r"\bpolyhydroxyalkanoicacids?phas?\b", "pha", False),
    (r"\bfattyacid(s)?fa\b", "fattyacid", False),
    ("polyhydroxybutyrates?phb", "polyhydroxybutyrate", True),
    ("poly(hydroxybutyrate)s?", "polyhydroxybutyrate", True),
    (r"\bpolyhydroxybutyrates?\b", "phb", False),
    ("polyhydroxybutyratecohydroxyvalerate", "phbv", True),
    ("copolymerphbcohv", "phbv", True),
    ("polyhydroxybutyratecohydroxyhexanoate", "phbhhx", True),
    ("phbcohhx", "phbhhx", True),
    ("phbhhxphbhhx", "phbhhx", True),
    ("gammaaminobutyrate", "gamma-aminobutyric acid", True),
    ("rsbutanediol", "butanediol", True),
    ("rrbutanediol", "butanediol", True),
    ("ssbutanediol", "butanediol", True),
    ("spropanediol", "propanediol", True),
    (r"\brbutanediol\b", "butanediol", False),
    ("butane-diol", "butanediol", True),
    (r"\bbutanediolbdo\b", "butanediol", False),
    (r"\bbdo\b", "butanediol", False),
    (r"\bpropanediolpdo\b", "propanediol", False),
    (r"\bpdo\b", "propanediol", False),
    (r"\bdopa\b", "dihydroxyphenylalanine", False),
    ("biofuels", "biofuel", True),
    ("ssastaxanthin", "astaxanthin", True),
    ("isobutanol", "butanol", True),
    ("sbutanol", "butanol", True),
    ("gbioethanol", "ethanol", True),
    ("bioethanol", "ethanol", True),
    ("acetyldneuraminate", "acetylneuraminate", True),
    ("acetylneuraminates", "acetylneuraminate", True),
    ("-diene", "diene", True),
    ("dlactate", "lactate", True),
    (r"\bGA\b", "gibberellin", False),
]

UNITS = [
    (r"\b[mμµ]?[gLl] [mμµ]?[lLg]\b(\(?-1\)?)?", "units"),
    (r"(\d+)[mμµ]?[gLl] [mμµ]?[lLg]\b(\(?-1\)?)?", r"$1 units"),
    (r"\(\d+%\)", "units"),
    (r"\b[mμµ]?mol [mμµ]?[lLg]\b(\(?-1\)?)?", "units"),
    (r"(\d+)[mμµ]?mol [mμµ]?[lLg]\b(\(?-1\)?)?", r"$1 units"),
    (r"\b[mμµ]?[glL](\/[mμµ]?[lL])?\b(\(-1\))?", "units"),
    (r"(\d+)[mμµ]?[glL](\/[mμµ]?[lL])?\b(\(-1\))?", r"$1 units"),
    (r"\b[mμµ]?mol(\/[mμµ]?[lL])?\b(\(-1\))?", "units"),
    (r"(\d+)[mμµ]?mol(\/[mμµ]?[lL])?\b(\(-1\))?", r"$1 units"),
    (r"\bcell\/?h(-1)?\b", "units"),
    (r"\b[mμµ]?mol\b", "units"),
    (r"\bunits\/?[lL]\b", "units"),
    (r"\bunits\/?liter\b", "units"),
    (r"units-\d+", "units"),
    (r"units-(\w+)", r"units $1"),
    (r"units\/units", "units"),
    (r"(\d+\.?\d*)\s(units)", r"$1-$2"),
    (r"units-\(\+\)-(\w+)", r"units $1"),
]

CHEMICAL_ENDINGS = [
    "ene", "ide", "ane", "ine", "ite", "enol", "olic", "aryl", "ose", "diol", "oxyl", "syl", "nosid", "lactone",
    "anol", "cyanin", "anin", "celulos", "anin",
]

PHRASES = [
    (r"\bthe sigma factor\b", "the"),
    (r"\bcoding gene\b", "gene"),
    (r"\band another\b", "and"),
    (r"\bmutation in\b", "mutated"),
    (r"(\bto further\b\s)?\benhance production,", ","),
    (r"\bhave met with\b", "experienced"),
    (r"\bgenes causing increased ring formation\b", "genes"),
    (r"\bthe gene cluster regulator\b", ""),
    (r"(\bthe )?(relative )?\btranscription(al)? level(s)? of\b", "the expression of"),
    (r"\bover-", "over"),
    (r"\bdown-", "down"),
    (r"\bco-", "co"),
    (r"\bmutation of the regulator gene(s)?\b", "mutation of the gene"),
]

END_SECTIONS = ["References", "REFERENCES", "Acknowledgements", "ACKNOWLEDGEMENTS"]

JOURNAL = r"(\w{1,7}\s+){1,2}(\w{1,13}\s+){1,2}\(?\d+\)?\s*(\d+[:–;.])+(\s+)?\d+"
NOT_JOURNAL = r"(?i)^(over)?(expression|production)\b"
CITATIONS = [
    r"(?i)(\w{1,7}[\.,]{1,2}?\s+){1,2}(\w{1,13}[\.,]{1,2}?\s+){1,2}\(?\d+\)?\s*(\(?\d+\)[:–;.,]?)+(\s+)?\d+.\d+[:–;.,]?\s+\w{4}",
    r"(?i)DOI:?\s+(\w+[-.\/])+\d+",
    r"(?i)\w+(\s+)?\w+:\s+\d{1,2}\s+\w+\s+\d{4}",
    r"(?i)\w+(\s+)?\w+:\s+\w+\s+\d{1,2},?\s+\d{4}",
    r"(?i)\w+[\.:].+\w+\.(org|com)\/.+",
]

# End of the fixed values.

#: What a match of JOURNAL and of each of CITATIONS holds in any case: told in one quick scan, where these go back and forth.
JOURNAL_HOLDS = r"\d[:–;.]\s*\d"
CITATIONS_HOLD = [r"\d\)[:–;.,]?\s*\d", r"(?i)DOI", r":\s+\d{1,2}\s+\w+\s+\d{4}", r":\s+\w+\s+\d{1,2},?\s+\d{4}", r"(?i)\.(?:org|com)/."]


def _rules(pairs: list[tuple[str, str]]) -> list[Rule]:
    """Word characters and borders are told by Unicode."""
    return [Rule("(?U)" + p, r) for p, r in pairs]


def greek_names(text: Column) -> Column:
    """Every Greek letter, small or capital, by its name in lower case."""
    letters = [*GREEK, *((a.upper(), b) for a, b in GREEK), (SHARP_S, "beta")]
    return rewrite(text, [Rule(a, b, True) for a, b in letters])


def canonical_name(name: Column) -> Column:
    """A product's name without isomer marks, brackets, signs and blanks, in lower case and compatibility form.

    A leading Greek letter goes, also when it is spelt out. Null stays null; one application, where callers ask for two.
    """
    starts = [Rule(f"^{word}", SHARP_S if word == "beta" else letter) for letter, word in GREEK]
    letters = "".join(a + a.upper() for a, _ in GREEK) + SHARP_S
    isomer = (rf"^\d*[npdolʟʀr\+{letters}]?-", "")
    out = F.lower(rewrite(F.lower(rewrite(name, _rules(NAME_ENDS))), starts))
    out = rewrite(out, _rules([*NAME_ISOMERS, (f"^[{letters}]", ""), isomer, isomer]))
    return compatible(rewrite(F.lower(out), _rules(NAME_MARKS)))


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def family_name(name: Column) -> Column:
    """Spellings of one product family by one name."""
    return rewrite(name, [Rule(p if lit else "(?U)" + p, r, lit) for p, r, lit in FAMILIES])


def unit_marks(text: Column) -> Column:
    """Units of measure as the word `units`, tied to the number before."""
    return rewrite(text, _rules(UNITS))


def chemical_words(text: Column) -> Column:
    """Words with a chemical ending get `chemical` in its place."""
    return F.regexp_replace(text, rf"(?U)\b(\w*)({'|'.join(CHEMICAL_ENDINGS)})\b", "$1chemical")


def simpler_phrases(text: Column) -> Column:
    return rewrite(text, _rules(PHRASES))


def without_roots(text: Column, roots: list[str]) -> Column:
    """Words that contain any of the roots, with a hyphenated part before or behind, taken out."""
    return F.regexp_replace(text, rf"(?U)\b(\w*-?)({'|'.join(roots)})(\w*-?\w*)\b", "") if roots else text


def without_reference_marks(text: Column) -> Column:
    """Bracketed reference numbers and preprint figure marks out, white space to one blank."""
    return rewrite(text, [Rule(r"\s\[(?:\d++,?\s?)+\]", ""), Rule(r"biorxiv;[a-zA-Z0-9\/]*\s\w?\d:", ""), Rule(r"\s+", " ")])


def trimmed_clause(clause: Column, stops: list[str]) -> Column:
    """A clause without a first and a last word that is a stop word or ends in -ly; one without either stays as it is."""
    strip = lambda c: F.btrim(c, F.lit(",.; "))
    drop = lambda w: strip(F.lower(w)).isin(stops) | strip(F.lower(w)).endswith("ly")

    def kept(x) -> Column:
        first, last, words = x["first"], x["last"], x["words"]
        left = F.slice(words, F.lit(1) + first.cast("int"), F.greatest(F.size(words) - first.cast("int") - last.cast("int"), F.lit(0)))
        return F.when(first | last, strip(F.array_join(left, " "))).otherwise(clause)

    # arrays of one element bind the words and what is told of them
    told = F.transform(F.array(F.split(strip(clause), " ")), lambda w: F.struct(w.alias("words"), drop(F.element_at(w, 1)).alias("first"), drop(F.element_at(w, -1)).alias("last")))
    return F.transform(told, kept)[0]


@F.pandas_udf(T.StringType())
def without_citations(s: pd.Series) -> pd.Series:
    """Journal citations, DOIs, dates and links out.

    Of a journal citation only its last short word goes, everywhere in the text, as surveyed.
    """
    journal, held, other = re.compile(JOURNAL), re.compile(JOURNAL_HOLDS), re.compile(NOT_JOURNAL)
    rest = [(re.compile(h), re.compile(p)) for h, p in zip(CITATIONS_HOLD, CITATIONS, strict=True)]

    def one(t):
        if t is None:
            return None
        found = [m[1] for m in journal.finditer(t)] if held.search(t) else []
        t = reduce(lambda x, w: x.replace(w, ""), (w for w in found if not other.match(w)), t)
        return reduce(lambda x, p: p[1].sub("", x) if p[0].search(x) else x, rest, t)

    return s.map(one)


def highlight(text: Column, terms: list[str], escape) -> Column:
    """Escaped text with every term of two letters or more in marks, longer terms first."""
    wanted = sorted((t for t in terms if len(t) > 1), key=len, reverse=True)
    if not wanted:
        return escape(text)
    marked = F.regexp_replace(text, f"(?i)({'|'.join(re.escape(t) for t in wanted)})", "\x01$1\x02")
    return F.replace(F.replace(escape(marked), F.lit("\x01"), F.lit("<mark>")), F.lit("\x02"), F.lit("</mark>"))
