"""Relations cleaned by the sentence they come from: metabolites, pathway names and products out, denials in, repeated names out.

All rules are expressions over rows (paper, place, sentence, relation); patterns hold the gene of the row. A relation is
`gene -> action`; rows that aren't are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and words below must equal the surveyed ones.
NEVER_GENES = ["PEP", "IPP", "DMAPP", "DCW", "ALA", "fed", "ACP", "PCA"]
METABOLITES = {
    "GAP": ["glyceraldehyde-3-phosphate"],
    "E4P": ["erythrose-4-phosphate"],
    "F6P": ["fructose-6-phosphate"],
    "PGA": ["3-phosphoglycerate"],
    "NADH": ["nicotinamide adenine dinucleotide"],
    "NADPH": ["nicotinamide adenine dinucleotide phosphate"],
    "ATP": ["adenosine triphosphate"],
    "ADP": ["adenosine diphosphate"],
    "AMP": ["adenosine monophosphate", "adenosine 5'-monophosphate"],
    "FAD": ["flavin adenine dinucleotide"],
}
AMOUNTS = "pool|availability|accumulation|formation|amount|supply|content|level|available|compound|precursor|metabol"
STOCKS = "pool|availability|bioavailability|content|tolerance|transport|supply|formation|accumulation|excretion"
STOCK_STARTS = "(?:bio)?availability|pool|content|tolerance|transport|supply|formation|accumulation"
MAKING = "production|biosynthesis|productivity"
ENZYMES = "synthase|decarboxylase|transferase|kinase|carboxykinase|dehydrogenase|carboxylase|isomerase|mutase|reductase|oxidase|hydrogenase|lyase|ligase"
GENE_SIGNS = "expression|activity|gene|promoter|transcript"
ENZYME_SIGNS = "substrate|enzyme|catalyze|catalyses|active site|kinetic|mutant|modeling|structure"
#: Denials in the order in which they count, and how they are written.
DENIALS = [(r"\bnot\b", "was not"), (r"\bnever\b", "was never"), (r"\bno\b", "no"), (r"\bfailed\s+to\b", "failed to")]


def _quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))


def _holds(text: Column, *parts: Column | str) -> Column:
    """Whether a pattern made of parts occurs in text, whatever the case."""
    return F.regexp_like(text, F.concat(F.lit("(?iU)"), *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _in_brackets(gene: Column) -> Column:
    return F.concat(F.lit(r"[\(\[\{]?\b"), _quoted(gene), F.lit(r"\b[\)\]\}]?"))


def is_capital(gene: Column) -> Column:
    return (F.upper(gene) == gene) & (F.lower(gene) != gene)


def is_metabolite(sentence: Column, gene: Column) -> Column:
    """Names that never are genes, and known metabolites whose full name or an amount of which the sentence tells."""
    full = F.when(F.lit(False), F.lit(False))
    for short, names in METABOLITES.items():
        full = full.when(gene == short, sentence.rlike(rf"(?i)\b(?:{'|'.join(names)})\b"))
    amount = gene.isin(list(METABOLITES)) & _holds(sentence, rf"(?:{AMOUNTS})\s+(?:of\s+)?", _in_brackets(gene))
    return gene.isin(NEVER_GENES) | F.coalesce(full, F.lit(False)) | amount


def is_pathway(sentence: Column, gene: Column) -> Column:
    """Capital names of a pathway, a cycle or a synthesis, or of its genes.

    `X genes` stays if what stands before its first place is `and`, `or` or a word of capitals and digits, as the genes are listed then.
    """
    name = _quoted(gene)
    loose = _in_brackets(gene)
    named = _holds(sentence, loose, r"\s+(?:pathway|cycle)\b(?!\s+genes)|\b(?:pathway|cycle)\s+", loose, r"|\b", name, r"\b\s+synthesis")
    genes = F.concat(F.lit(r"\b"), name, F.lit(r"\b\s+(?:pathway\s+genes|cycle\s+genes|genes)\b"))
    before = F.call_function("regexp_extract", sentence, F.concat(F.lit("(?isU)^(.*?)"), genes), F.lit(1))
    word = F.regexp_extract(before, r"(\w+)\s*$", 1)
    return is_capital(gene) & (named | (_holds(sentence, genes) & ~(F.lower(word).isin("and", "or") | word.rlike("^[A-Z0-9]+$"))))


def is_product(sentence: Column, gene: Column) -> Column:
    """Capital names of what is stored, made, converted, or part of an enzyme's name."""
    name, loose = F.concat(F.lit(r"\b"), _quoted(gene), F.lit(r"\b")), _in_brackets(gene)
    listed = F.concat(name, F.lit(r"(?:[\s,]+(?:and|or)\s+[A-Z0-9]{2,6})?\s+"))
    out = _holds(
        sentence, listed, rf"(?:{STOCKS}|{MAKING})\b|", loose, rf"(?:\s+(?:{STOCK_STARTS}|{MAKING})|[-\s]+\w*(?:{ENZYMES})\s*\(\w+\))|\w+\s*\(", loose,
        rf"\)[-\s]+\w*(?:{ENZYMES})|\b", loose, rf"[-\s]*(?:{ENZYMES})",
    )
    converted = (F.length(gene) <= 5) & _holds(sentence, r"converting\s+", loose) & ~_holds(sentence, loose, rf"\s+(?:{GENE_SIGNS}|{ENZYME_SIGNS})")
    return is_capital(gene) & (out | converted)


def with_denial(sentence: Column, action: Column) -> Column:
    """An action of `was` or `were` as a denial, where the sentence denies it between that word and the action's; else the action."""
    word = F.regexp_extract(action, r"(?i)(?:^|\s)(?:was|were)\s+(\S+)", 1)
    free = r"(?:(?!\b(?:was|were)\b).)*?"
    told = F.concat(F.lit(rf"(?isU)\b(?:was|were)\b({free}(?:{'|'.join(p for p, _ in DENIALS)}){free})\b"), _quoted(word), F.lit(r"\b"))
    between = F.call_function("regexp_extract", sentence, told, F.lit(1))
    last = F.regexp_extract(action, r"(\S+)\s*$", 1)
    out = F.when(word == "", action)
    for pattern, text in DENIALS:
        out = out.when(between.rlike(f"(?i){pattern}"), F.concat(F.lit(f"{text} "), last))
    return out.otherwise(action)


def without_own_name(relation: Column) -> Column:
    """`x -> action x` and `x -> x action` as `x -> action`; the first of these that holds, and nothing else, counts.

    What stands behind the name at the end goes with it. An action is never lost as a whole."""
    ends = r"^(\w+)\s*->\s*([A-Za-z0-9_][A-Za-z0-9_\s]*?)\s*\1\b.*$"
    starts = r"^(\w+)\s*->\s*\1\s+([A-Za-z0-9_\s]+)\b.*$"
    short = lambda p: F.concat(F.regexp_extract(relation, p, 1), F.lit(" -> "), F.trim(F.regexp_extract(relation, p, 2)))
    return F.when(relation.rlike(ends), short(ends)).when(relation.rlike(starts), short(starts)).otherwise(relation)


def cleaned(found: DataFrame) -> DataFrame:
    """(paper, sentence, relation) as (paper, relation), each once; papers without a relation left have no row.

    Rows with null sentences or relations, or relations of another form, are left out; so are repeated rows.
    """
    halves = F.split("relation", " -> ")
    rows = found.where("sentence is not null and relation is not null").select("paper", "sentence", halves.alias("h")).where("size(h) = 2 and h[0] <> ''")
    rows = rows.select("paper", "sentence", F.col("h")[0].alias("gene"), F.col("h")[1].alias("action")).distinct()
    # an array of one element binds sentence and gene, which would be written into every use of them otherwise
    stays = lambda r: ~(is_metabolite(r["sentence"], r["gene"]) | is_pathway(r["sentence"], r["gene"]) | is_product(r["sentence"], r["gene"]))
    kept = rows.where(F.exists(F.array(F.struct("sentence", "gene")), stays))
    told = kept.select("paper", "gene", with_denial(F.col("sentence"), F.col("action")).alias("action")).select("paper", F.concat_ws(" -> ", "gene", "action").alias("relation"))
    return told.select("paper", without_own_name(F.col("relation")).alias("relation")).distinct()
