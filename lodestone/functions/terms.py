"""Rules on terms and sentences: aliases, parts of names, product lists, sentences and clauses of gene texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rule, rewrite

# Patterns, words and reasons below must equal the surveyed ones, in this order.
ALIASES = [
    ("e. coli", "escherichia coli"),
    ("e coli", "escherichia coli"),
    ("s. cerevisiae", "saccharomyces cerevisiae"),
    ("s cerevisiae", "saccharomyces cerevisiae"),
    ("c. glutamicum", "corynebacterium glutamicum"),
    ("c glutamicum", "corynebacterium glutamicum"),
]
ORGANISM_PARTS = [
    "escherichia", "coli", "cerevisiae", "saccharomyces", "pseudomonas", "halomona", "yeast", "bacillus", "subtilis", "clostridium",
    "thermocellum", "cyanobacteria", "meningoseptica", "plant", "human", "thermophillus", "spp", "synechococcus", "consortia", "streptomyces", "consortium",
]
OTHER_PARTS = ["not", "available", "saccharoperbutylacetonicum", "asexual", "reproduction", "estrogen", "sulfur", "biohydrogen", "lactic", "biogas", "straw", "thermophillic"]
PRODUCT_RULES = [
    Rule(r"(?U)\b(ligno)?cellulosic\b", ""),
    Rule(r"(?U)\bpure\b", ""),
    Rule(r"(?U)\bhuman\b", ""),
    Rule(r"(?U)\b(bio)(fuel|ethanol|butanol|diesel|ethylene|lipid)s?\b", "$2"),
    Rule(r"(?U)\bcell\s*growth\b", "biomass"),
    Rule(r"(?U)\s+genes?\b", ""),
]
FIRST_WORDS = ["three", "growth", "membrane", "and/or", "polymer", "precursor", "thermophilic", "microalgal", "microalgae"]
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
NO_PRODUCT = [
    (rf"(?i)^(?:{_MONTHS})\s+\d{{1,2}}(?:\s*,?\s*\d{{4}})?$", "date-like"),
    (r"^>?<?~?(units-)?\d+$", "plain-number"),
    (r"^(?:\[\s*\d+\s*\]|\(?\d+(-units)?-?1?%?\)?)$", "bracketed-number"),
    (r"(?i)^vol\.?\s*\d+$", "vol-number"),
]
ENDINGS = ["tion", "ment", "ness", "ary", "ence", "ent", "bly", "ade", "wide", "ant", "metric", "ries", "ties", "ble", "ity", "ous", "lar", "cial", "rial", "tral", "chiral", "tural", "ical", "ple", "ory", "tor"]
LEADING, TRAILING, NOTHING_LEFT = "removed leading suffix word", "removed trailing suffix word", "all words removed by suffix rules"
SENTENCE_ENDS = [
    r"(?<=[\w\)\]])\.(?=\s+[A-Z]|\s?$)",
    r":\s",
    r"(?<=[a-z])\.(?=\s+[a-z]|\s?$)",
    r"(?<=[\)\]])\.(?=\s+\w|\s?$)",
]
STRAY_ENDS = [r"\s\.\s", r"\.\s,"]
CLAUSE_MARKS = [r"\s\.\s\(", r"\s\.\s", r"\.\s,", r"\s{3,}", r"•\s", r"\s;\s", r"(?<=\w[\d\W])\.\s(?=\w+)", r"(?<=[a-z]\w[A-Z])\.\s(?=\w+)", r"\.\sthe\s"]
CLAUSE_WORDS = [
    r"\sunder\s", r"\swhich\s", r"\s\w+ly\s", r"\sby\s", r"\svia\s", r"\sin\s[A-Z].\s", r"\sresulted\s", r"\sin\saddition,",
    r"\sit\swas\salso\sfound\sthat\s", r"\sand\shence\s", r"ha[v|s]e?\sbeen\sreported\s", r"ha[v|s]e?\sbeen\sexplained\s",
    r"ha[v|s]e?\sbeen\sshown\s", r"ha[v|s]e?\sbeen\sused\s", r"\bwas\sused\b",
]


def with_aliases(text: Column) -> Column:
    """text in lower case with every short name written out, one alias after the other. Null stays null."""
    return rewrite(F.lower(text), [Rule(a, b, literal=True) for a, b in ALIASES])


def without_parts(text: Column, parts: list[str]) -> Column:
    """text in lower case without the parts, wherever they stand, one after the other. Null stays null."""
    return rewrite(F.lower(text), [Rule(p, "", literal=True) for p in parts])


def product_terms(values: Column) -> Column:
    """Products with replaced words, without a first word that names none, without empty ones; null where none is left."""
    bare = F.transform(values, lambda v: F.regexp_replace(rewrite(v, PRODUCT_RULES), r"(?U)^\s+|\s+$", ""))

    def rest(v: Column) -> Column:
        first = F.lower(F.regexp_extract(v, r"^(\S+)", 1)).isin(FIRST_WORDS)
        return F.when(first, F.array_join(F.slice(F.split(v, r"\s+"), F.lit(2), F.size(F.split(v, r"\s+"))), " ")).otherwise(v)

    kept = F.filter(F.transform(bare, rest), lambda v: v != "")
    return F.when(F.size(kept) > 0, kept)


def trimmed_products(values: Column) -> Column:
    """Per item of a list of products: (item, product, log), product null where the item goes, log with (value, reason).

    Dates, numbers and volumes go; a word of an ending that makes no product goes at the start, then at the end; an item
    without words left goes. Null items stay null without a log; a null list stays null.
    """
    entry = lambda value, reason: F.struct(value.alias("value"), reason.alias("reason"))
    ending = rf"(?i)(?:{'|'.join(ENDINGS)})(?:al)?s?$"

    def one(item: Column) -> Column:
        plain = F.regexp_replace(item, r"(?U)^\s+|\s+$", "")
        reason = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern, name in NO_PRODUCT:
            reason = reason.when(plain.rlike(pattern), F.lit(name))

        def by_words(w: Column) -> Column:
            lead = F.coalesce(F.get(w, F.lit(0)).rlike(ending), F.lit(False))
            trail = (F.size(w) > lead.cast("int")) & F.coalesce(F.element_at(w, -1).rlike(ending), F.lit(False))
            n = F.size(w) - lead.cast("int") - trail.cast("int")
            log = F.filter(
                F.array(
                    F.when(lead, entry(F.get(w, F.lit(0)), F.lit(LEADING))),
                    F.when(trail, entry(F.try_element_at(w, F.lit(-1)), F.lit(TRAILING))),
                    F.when(n == 0, entry(item, F.lit(NOTHING_LEFT))),
                ),
                lambda e: e.isNotNull(),
            )
            return F.struct(item.alias("item"), F.when(n > 0, F.array_join(F.slice(w, 1 + lead.cast("int"), n), " ")).alias("product"), log.alias("log"))

        words = F.filter(F.split(plain, r"\s+"), lambda x: x != "")
        gone = F.struct(item.alias("item"), F.lit(None).cast("string").alias("product"), F.array(entry(item, reason)).alias("log"))
        empty = F.struct(item.alias("item"), F.lit(None).cast("string").alias("product"), F.filter(F.array(entry(item, F.lit(""))), lambda e: F.lit(False)).alias("log"))
        # an array of one element binds the words
        return F.when(item.isNull(), empty).when(reason.isNotNull(), gone).otherwise(F.get(F.transform(F.array(words), by_words), F.lit(0)))

    return F.transform(values, one)


# The lists above as one pattern each: what begins with the same character is told behind it, in the order of the list.
_ENDS_ONCE = r"\.(?:(?<=[\w\)\]]\.)(?=\s+[A-Z]|\s?$)|(?<=[a-z]\.)(?=\s+[a-z]|\s?$)|(?<=[\)\]]\.)(?=\s+\w|\s?$))|:\s"
_STRAY_ONCE = r"\s\.\s|\.\s,"
_MARKS_ONCE = r"\s(?:\.\s\(|\.\s|\s{2,}|;\s)|\.\s(?:,|(?<=\w[\d\W]\.\s)(?=\w)|(?<=[a-z]\w[A-Z]\.\s)(?=\w)|the\s)|•\s"
_WORDS_ONCE = (
    r"\s(?:under\s|which\s|\w+ly\s|by\s|via\s|in\s[A-Z].\s|resulted\s|in\saddition,|it\swas\salso\sfound\sthat\s|and\shence\s)"
    r"|ha[v|s]e?\sbeen\s(?:reported|explained|shown|used)\s|\bwas\sused\b"
)
_CUT = "\x01"


def _split(text: Column, pattern: str) -> Column:
    """F.split(), which makes its pattern anew for each text; here it is made once, and a character tells the cuts.

    pattern matches no empty string; a text that holds the character is split the plain way.
    """
    return F.when(F.contains(text, F.lit(_CUT)), F.split(text, pattern)).otherwise(F.split(F.regexp_replace(text, pattern, _CUT), _CUT))


def sentences_of(text: Column) -> Column:
    """The sentences of a text; names like `E. coli` hold together. Null and empty texts have none."""
    cut = lambda t: _split(t, f"(?U){_ENDS_ONCE}")
    whole = lambda c: F.when(F.element_at(c, -1) == "", F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)
    # arrays of one element bind the text and its cuts, which would be made again at each mention otherwise
    parts = lambda t: F.flatten(F.transform(F.flatten(F.transform(F.array(cut(t)), whole)), lambda s: _split(s, f"(?U){_STRAY_ONCE}")))
    none = F.expr("cast(array() as array<string>)")
    return F.transform(F.array(text), lambda t: F.when(F.length(t) > 0, parts(t)).otherwise(none))[0]


def gene_clauses(sentences: Column) -> Column:
    """Distinct clauses of two words or more, in order of place: sentences cut at marks, and these at words."""
    trimmed = lambda parts: F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" .,"))), lambda s: s.rlike(r"(?U)\S\s+\S"))
    cut = lambda values, pattern: F.array_distinct(F.flatten(F.transform(values, lambda s: trimmed(_split(s, f"(?U){pattern}")))))
    return cut(cut(sentences, _MARKS_ONCE), _WORDS_ONCE)
