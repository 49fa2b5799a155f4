"""Text functions; those that JVM expressions can't say are vectorised Python functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import Rule, rewrite


def strip_markup(text: Column) -> Column:
    """Tags out, then anything but letters and digits to a blank."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), "[^a-zA-Z0-9]", " ")


def html_escape(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]
    return rewrite(text, [Rule(a, b, True) for a, b in pairs])


def cut_at(text: Column, markers: list[str]) -> Column:
    """What stands before the first of each marker, one marker after the other."""
    for m in markers:
        text = F.substring_index(text, m, 1)
    return text


def csv_cell(value: Column) -> Column:
    """A quoted cell that no spreadsheet takes for a formula."""
    plain = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(plain.rlike(r"^[\x00-\x20]*[=+\-@]"), F.concat(F.lit("'"), plain)).otherwise(plain)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def singular(word: Column) -> Column:
    return (
        F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?:ss|us|is)$") | (F.length(word) < 4), word)
        .when(word.rlike("s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def vowel_stem(word: Column) -> Column:
    """A word up to its last vowel, one letter earlier if i or o stands before that."""
    stem = F.regexp_extract(word, "^(.*?)[io]?[aeiou][^aeiou]*$", 1)
    return F.when(~word.rlike("[aeiou]"), word).when(stem == "", F.substring(word, 1, 1)).otherwise(stem)


#: Words that say nothing about a modification, and verbs that are stems already.
FILLERS = [
    "was", "were", "is", "are", "be", "been", "being", "the", "a", "an", "in", "or", "and", "for", "of", "when",
    "both", "with", "further", "its", "to", "would", "gene",
]
WHOLE = [
    "block", "coexpress", "express", "mutant", "knock", "repress", "disrupt", "not", "engineer", "lack", "insert",
]


def modification_stem(phrase: Column) -> Column:
    """`was overexpressed` as `overexpress`: fillers and anything but a-z and hyphens go, words are cut by vowel_stem."""
    words = F.regexp_replace(F.lower(phrase), rf"(?U)\b(?:{'|'.join(FILLERS)})\b", "")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(words, r"(?U)\s+", " "), "[^a-z -]+", "")), " +")
    return F.array_join(F.transform(words, lambda w: F.when(w.isin(*WHOLE, *(x + "s" for x in WHOLE)), w).otherwise(vowel_stem(w))), " ")


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Lower case without combining marks, trimmed."""
    mark = re.compile("[\u0300-\u036f]")
    return s.map(lambda t: None if t is None else mark.sub("", unicodedata.normalize("NFKD", t)).lower().strip())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("directions", T.ArrayType(T.StringType()))])))
def parse_genes(s: pd.Series) -> pd.Series:
    """A Python-dict literal {gene: direction or directions} as an ordered list; anything else raises."""
    import ast

    def one(t):
        if t is None or not t.strip():
            return []
        value = ast.literal_eval(t)
        if not isinstance(value, dict):
            raise ValueError(f"genes must be a mapping: {t[:80]}")
        return [{"name": str(k).strip(), "directions": [str(x).strip() for x in (v if isinstance(v, (list, tuple, set)) else [v])]} for k, v in value.items()]

    return s.map(one)


class Porter:
    """Porter's stemmer (1980), from the published description."""

    _CACHE: dict[str, str] = {}

    @staticmethod
    def _shape(w: str) -> str:
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
        return out

    @classmethod
    def _m(cls, w: str) -> int:
        return len(re.findall("v+c+", cls._shape(w)))

    @classmethod
    def _cvc(cls, w: str) -> bool:
        return cls._shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    @classmethod
    def stem(cls, w: str) -> str:
        if w not in cls._CACHE:
            if len(cls._CACHE) > 200_000:
                cls._CACHE.clear()
            cls._CACHE[w] = cls._stem(w)
        return cls._CACHE[w]

    @classmethod
    def _stem(cls, w: str) -> str:
        w = w.lower()
        if len(w) <= 2 or not w.isascii() or not w.isalpha():
            return w
        for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: len(w) - len(end)] + new
                break
        if w.endswith("eed"):
            w = w[:-1] if cls._m(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and "v" in cls._shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and cls._shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif cls._m(w) == 1 and cls._cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in cls._shape(w[:-1]):
            w = w[:-1] + "i"
        # fixed values: the suffixes of steps 2, 3 and 4
        two = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
        three = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
        four = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
        for table in (two, three):
            for end in sorted(table, key=len, reverse=True):
                if w.endswith(end):
                    if cls._m(w[: -len(end)]) > 0:
                        w = w[: -len(end)] + table[end]
                    break
        for end in sorted(four, key=len, reverse=True):
            if w.endswith(end):
                rest = w[: -len(end)]
                if cls._m(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                    w = rest
                break
        if w.endswith("e") and (cls._m(w[:-1]) > 1 or cls._m(w[:-1]) == 1 and not cls._cvc(w[:-1])):
            w = w[:-1]
        if w.endswith("ll") and cls._m(w) > 1:
            w = w[:-1]
        return w


@F.pandas_udf(T.StringType())
def stem_words(s: pd.Series) -> pd.Series:
    """Every run of ASCII letters by its Porter stem, joined by blanks."""
    return s.map(lambda t: None if t is None else " ".join(Porter.stem(w) for w in re.findall("[A-Za-z]+", t)))
