"""Queries of the rule tables and of places over whole tables, with DuckDB's SQL written from the same fixed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning, text
from ..operators import explorer, ranking
from .extra import _FOUND, _SCORE, REQUEST, query, records, table

#: Worked product names; each row of `part` takes one, so that every rule is met.
NAMES = ["L-lactate", "alpha-pinene", "Betacarotene", "(R)-limonene", "2,3-butanediol", "(2R,3R)-2,3-butanediol", "rac-menthol", "trans-cinnamate", "cis-cis-muconate", "poly-(3-hydroxybutyrate)", "rs-butanediol", "d2-x", "tocopherol(-)", "γ-valerolactone", "N-acetyl", "α,β-unsaturated", "rrr-x", "Psi-y"]
FAMILY_NAMES = ["polyhydroxyalkanoates", "polyhydroxyalkanoicacid", "polyhydroxyalkanoatespha", "fattyacidsfa", "polyhydroxybutyrate", "polyhydroxybutyratecohydroxyvalerate", "copolymerphbcohv", "phbcohhx", "gammaaminobutyrate", "ssbutanediol", "rbutanediol", "bdo", "pdo", "dopa", "biofuels", "isobutanol", "gbioethanol", "acetyldneuraminate", "buta-diene", "dlactate", "GA", "GABA"]
AMOUNTS = ["34 mg/L", "5 g l(-1)", "12mmol l-1", "(45%)", "3.5 g", "7 mmol/L", "10 cell/h", "2 umol", "8 units/l", "units-3", "units-glucose", "4 ml per mol", "1 l/L"]
CLAUSES = ["the transcriptional levels of lacZ rose", "over-expression, and another co-factor", "mutation in pfkA", "cells to further enhance production, have met with loss", "mutation of the regulator genes", "the coding gene down-regulated", "the sigma factor"]
CITED = ["as said [1, 2] before", "biorxiv;10a/b 3: see", "in text [12,14 15]  and", "none [a]"]
STOPS = ["the", "of", "and", "in", "a", "to", "is", "der", "die", "das", "und", "le", "la", "les", "de", "et", "el", "los", "las", "que"]
ROOTS = ["improv", "efficien", "high(level| titer)?", "yield", "one-pot", "metaboli", "tion"]


def _pick(values: list[str], key: str = "p_partkey"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _duck_list(values: list[str]) -> str:
    return f"list_value({', '.join(map(_quoted, values))})"


def _duck_pick(values: list[str], key: str = "p_partkey") -> str:
    return f"{_duck_list(values)}[{key} % {len(values)} + 1]"


def _duck_fold(x: str, rules, literal=lambda r: False) -> str:
    for r in rules:
        pattern, new = _quoted(r[0].replace("\\d++", "\\d+")), _quoted(r[1].replace("$", "\\"))
        x = f"replace({x}, {pattern}, {new})" if literal(r) else f"regexp_replace({x}, {pattern}, {new}, 'g')"
    return x


_LETTERS = "".join(a + a.upper() for a, _ in cleaning.GREEK) + "ß"


def _duck_canonical(x: str) -> str:
    x = f"lower({_duck_fold(x, cleaning.NAME_ENDS)})"
    x = f"lower({_duck_fold(x, [('^' + w, 'ß' if w == 'beta' else a) for a, w in cleaning.GREEK])})"
    isomer = (rf"^\d*[npdolʟʀr\+{_LETTERS}]?-", "")
    x = _duck_fold(x, [*cleaning.NAME_ISOMERS, (f"^[{_LETTERS}]", ""), isomer, isomer])
    return _duck_fold(f"lower({x})", cleaning.NAME_MARKS)


@query("STR18", f"select p_partkey, {_duck_fold(_duck_pick(NAMES), [(a, b) for a, b in cleaning.GREEK] + [(a.upper(), b) for a, b in cleaning.GREEK] + [('ß', 'beta')], lambda r: True)} as name from part")
def str18(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.greek_names(_pick(NAMES)).alias("name"))


@query("STR19", f"select p_partkey, {_duck_canonical(_duck_canonical(_duck_pick(NAMES)))} as name from part")
def str19(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.canonical_name(cleaning.canonical_name(_pick(NAMES))).alias("name"))


@query("STR20", f"select p_partkey, {_duck_fold(_duck_pick(FAMILY_NAMES), cleaning.FAMILIES, lambda r: r[2])} as name from part")
def str20(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.family_name(_pick(FAMILY_NAMES)).alias("name"))


@query("STR24", f"select p_partkey, {_duck_fold(_duck_pick(AMOUNTS), cleaning.UNITS)} as amount from part")
def str24(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.unit_marks(_pick(AMOUNTS)).alias("amount"))


@query("STR32", f"select p_partkey, {_duck_fold(_duck_pick(CLAUSES), cleaning.PHRASES)} as clause from part")
def str32(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.simpler_phrases(_pick(CLAUSES)).alias("clause"))


@query("STR8", f"select doc_id, regexp_replace(text, '([\\p{{L}}\\p{{M}}\\p{{N}}_]*)({'|'.join(cleaning.CHEMICAL_ENDINGS)})($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1chemical\\3', 'g') as chemical from documents")
def str8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.chemical_words(F.col("text")).alias("chemical"))


@query("STR23")
def str23(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.without_citations("text").alias("plain"))


_WORD = r"[\p{L}\p{M}\p{N}_]"


@query("STR27", f"select doc_id, regexp_replace(text, '({_WORD}*-?)({'|'.join(ROOTS)})({_WORD}*-?{_WORD}*)', '', 'g') as plain from documents")
def str27(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.without_roots(F.col("text"), ROOTS).alias("plain"))


_STRIP = "trim(array_to_string(list_slice(w, 1 + f::int, len(w) - l::int), ' '), ',.; ')"
_DROP = f"(list_contains({_duck_list(STOPS)}, {{0}}) or ends_with({{0}}, 'ly'))"
_END = "trim(lower(w[{0}]), ',.; ')"


@query(
    "STR31",
    f"select conv_id, turn, case when f or l then {_STRIP} else text end as clause from (select *, {_DROP.format(_END.format(1))} as f, {_DROP.format(_END.format(-1))} as l from "
    "(select conv_id, turn, text, string_split(trim(text, ',.; '), ' ') as w from conversations) x) y",
)
def str31(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cleaning.trimmed_clause(F.col("text"), STOPS).alias("clause"))


@query("STR34", f"select p_partkey, {_duck_fold(_duck_pick(CITED), [(chr(92) + 's' + chr(92) + '[(?:' + chr(92) + 'd+,?' + chr(92) + 's?)+' + chr(92) + ']', ''), ('biorxiv;[a-zA-Z0-9/]*' + chr(92) + 's' + chr(92) + 'w?' + chr(92) + 'd:', ''), (chr(92) + 's+', ' ')])} as plain from part")
def str34(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.without_reference_marks(_pick(CITED)).alias("plain"))


_TAIL = "concat(text, ' ', source, ' References ', lang, ' Acknowledgements x')"


@query("STR35", "select doc_id, string_split(string_split(string_split(string_split(" + _TAIL + ", 'References')[1], 'REFERENCES')[1], 'Acknowledgements')[1], 'ACKNOWLEDGEMENTS')[1] as body from documents")
def str35(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_at(F.expr(_TAIL), cleaning.END_SECTIONS).alias("body"))


_TAGS = "(?i)</?(?:b|i|sup|sub)>"


def _duck_escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    return x


_MARKED = _duck_escape("regexp_replace(html, '(?i)(article|the)', chr(1) || '\\1' || chr(2), 'g')")


@query("STR11", f"select page_id, {_duck_escape(f'''regexp_replace(html, '{_TAGS}', '', 'g')''')} as safe, replace(replace({_MARKED}, chr(1), '<mark>'), chr(2), '</mark>') as marked, regexp_replace(url, '[.*+?^${{}}()|\\[\\]\\\\]', '\\\\\\0', 'g') as literal from pages")
def str11(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    safe = text.html_escape(F.regexp_replace("html", _TAGS, ""))
    marked = cleaning.highlight(F.col("html"), ["the", "article", "x"], text.html_escape)
    return p.select("page_id", safe.alias("safe"), marked.alias("marked"), F.regexp_replace("url", r"[.*+?^${}()|\[\]\\]", r"\\$0").alias("literal"))


# ---- places ----------------------------------------------------------------------------------------


@query("WIN3", "select o_orderkey, row_number() over (order by o_orderstatus, o_totalprice desc, o_orderkey) as place from orders")
def win3(spark, sf_dir):
    return ranking.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [F.col("o_orderstatus"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "place")


@query("AGG19", "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 500 as batch from orders")
def agg19(spark, sf_dir):
    o = ranking.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    return o.select("o_orderkey", F.expr("(place - 1) div 500").alias("batch"))


@query("AGG20", "select batch, list(c_custkey order by c_custkey) as ids from (select c_custkey, (row_number() over (order by c_custkey) - 1) // 100 as batch from customer) x group by batch")
def agg20(spark, sf_dir):
    c = ranking.numbered(table(spark, sf_dir, "customer").select("c_custkey"), [F.col("c_custkey")])
    return c.groupBy(F.expr("(place - 1) div 100").alias("batch")).agg(F.array_sort(F.collect_list("c_custkey")).alias("ids"))


@query("TOP7", "select doc_id, (r - 1) // 20 + 1 as page from (select doc_id, row_number() over (order by n_chars desc, doc_id) as r, count(*) over () as n from documents) x where (r - 1) // 20 + 1 = least(7, (n - 1) // 20 + 1)")
def top7(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    page = F.lit(min(7, max(1, -(-d.count() // 20))))
    placed = ranking.numbered(d, [F.desc("n_chars"), F.col("doc_id")])
    return placed.withColumn("page", F.expr("(place - 1) div 20 + 1")).where(F.col("page") == page).select("doc_id", "page")


_ORDERS = {"year-desc": "year desc, lower(title), pmid", "year-asc": "year, lower(title), pmid", "title": "lower(title), pmid", "relevance": f"{_SCORE} desc, year desc, pmid"}


@query("TOP5", " union all ".join(f"select '{m}' as sort, pmid, row_number() over (order by {o}) as place from ({_FOUND}) x" for m, o in _ORDERS.items()))
def top5(spark, sf_dir):
    from dataclasses import replace

    found = explorer.matches(explorer.search_view(records(spark, sf_dir)), REQUEST)
    out = None
    for sort in _ORDERS:
        each = ranking.numbered(found, explorer.order(replace(REQUEST, sort=sort))).select(F.lit(sort).alias("sort"), "pmid", "place")
        out = each if out is None else out.unionByName(each)
    return out
