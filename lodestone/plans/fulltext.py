"""Queries of full texts: sections, raw text, names of organisms, enzymes by organism, relations cleaned by their sentences.

Their oracles are written apart from the operators, from the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rawtext, sections, terms
from ..functions.rules import without_words
from ..operators import curation, lexicon, organisms, reaction_groups, relation_cleanup, scratch, taxa, vectors
from . import dialect, mechanisms

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- sections: five lines of a document each, under headings by its id ------------------------------------

_FIRST = """case when doc_id % 6 = 0 then 'I. Introduction. ' when doc_id % 6 = 1 then 'Background: ' when doc_id % 6 = 2 then '2 Review. ' when doc_id % 6 = 3 then 'Summary ' when doc_id % 6 = 4 then 'INTRODUTION ' else 'Abstract ' end"""
_LATER = """case when (doc_id + j) % 9 = 0 then 'Author contributions' when (doc_id + j) % 9 = 1 then 'Materials and methods of authors' when (doc_id + j) % 9 = 2 then 'Funding' when (doc_id + j) % 9 = 3 then 'Supporting information'
when (doc_id + j) % 9 = 4 then 'Results, see supporting information' when (doc_id + j) % 9 = 5 then 'Ethics statement' when (doc_id + j) % 9 = 6 then 'Acknowledgements' when (doc_id + j) % 9 = 7 then 'Supplementary data' else 'Results' end"""
_MARKED = """case when doc_id % 4 = 0 then array('Much is known. ', 'In this study we used 5′-ACGTTG-3′. ') else array(' ') end"""
SECTIONS = f"""select doc_id, cast(j as int) as place, aconcat(array(case when j = 0 then {_FIRST} else {_LATER} end), aconcat(case when j = 0 then {_MARKED} else array('in short') end, aslice(lines, cast(5 * j + 1 as int), 5))) as chunks
from (select doc_id, lines, unnest(seq(cast(0 as bigint), cast(idiv(asize(lines) - 1, 5) as bigint))) as j from (select doc_id, ssplit(text, chr(10)) as lines from documents where text is not null) x) y"""

_METHODS = "(starts_with(o, 'materials') or starts_with(o, 'methods'))"
_KEPT = f"""(select doc_id, place, chunks from (select *, lower(array_to_string(list_slice(chunks, 1, 2), ' ')) as o from ({dialect.duck_text(SECTIONS)}) x) y
where not (contains(o, 'acknowledgements') or contains(o, 'funding') or contains(o, 'supplementary') or (contains(o, 'supporting information') and not contains(o, 'see supporting information'))
or (not {_METHODS} and (contains(o, 'author') or contains(o, 'ethics statement') or contains(o, 'ethic approval')))))"""
_MARK = "|".join(sections.MARKERS).replace("'", "''")
_INTRO = rf"""(select doc_id, place, chunks, case when list_has_any(heads, ['background', 'introduction', 'review', 'introdution']) then array_to_string(case when hit > 0 then list_slice(ss, hit, len(ss)) else list_slice(ss, greatest(len(ss) - 5, 1), len(ss)) end, ' ') end as kept
from (select *, coalesce(list_position(list_transform(ss, lambda x: regexp_matches(x, '(?i)^\s*(?:{_MARK})')), true), 0) as hit from (select doc_id, place, chunks,
string_split(regexp_replace(regexp_replace(array_to_string(chunks, ''), '\.\s+', '.', 'g'), '\.([A-Z])', '.' || chr(1) || '\1', 'g'), chr(1)) as ss,
list_transform(list_slice(chunks, 1, 2), lambda c: regexp_replace(regexp_extract(regexp_replace(lower(regexp_replace(c, '^(?i)[ivxlcdm]+\.', '')), '^[^a-z]*', ''), '^\S+'), '[^a-z]', '', 'g')) as heads
from {_KEPT} k where place = 0) a) b)"""
_LINES = "array_to_string(list_transform(string_split(t, chr(10)), lambda p, k: p || case when k = len(string_split(t, chr(10))) then '' when regexp_matches(right(p, 1), '^[A-Z]$') or regexp_matches(left(string_split(t, chr(10))[k + 1], 1), '^[A-Z]$') then chr(10) else ' ' end), '')"


def _sections(spark, sf_dir):
    return dialect.run_sql(spark, sf_dir, SECTIONS)


@query("STR37", f"select doc_id, place, len(chunks) as n_chunks from {_KEPT} k")
def str37(spark, sf_dir):
    """Sections that aren't back matter."""
    return _sections(spark, sf_dir).where(~sections.is_back_matter(F.col("chunks"))).select("doc_id", "place", F.size("chunks").alias("n_chunks"))


@query("STR36", f"select doc_id, kept from {_INTRO} i where kept is not null")
def str36(spark, sf_dir):
    """What introductions tell of the work itself."""
    first = _sections(spark, sf_dir).where((F.col("place") == 0) & ~sections.is_back_matter(F.col("chunks")))
    return first.select("doc_id", sections.introduction(F.col("chunks")).alias("kept")).where("kept is not null")


@query(
    "STR33",
    rf"""select doc_id, place, regexp_replace({_LINES}, '5′-?[ACGTNacgnt]+-?3′', '', 'g') as plain from (select doc_id, place, regexp_replace(t, '\s{{2,}}', ' ', 'g') as t
    from (select doc_id, place, array_to_string(chunks, ' ') as t from {_KEPT} k where place > 0 union all select doc_id, place, 'Introduction:' || chr(10) || kept from {_INTRO} i where kept is not null) u) v""",
)
def str33(spark, sf_dir):
    """Full texts section by section: back matter out, introductions trimmed, lines joined, primers out."""
    kept = _sections(spark, sf_dir).where(~sections.is_back_matter(F.col("chunks")))
    return kept.select("doc_id", "place", sections.without_primers(sections.section_text(F.col("place"), F.col("chunks"))).alias("plain")).where("plain is not null")


# ---- raw text ---------------------------------------------------------------------------------------------


@query("STR25")
def str25(spark, sf_dir):
    """Raw text for products and for genes."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", rawtext.raw_text(F.col("text")).alias("plain"), rawtext.raw_text(F.col("text"), gene=True).alias("gene_plain"))


@query("RST22")
def rst22(spark, sf_dir):
    """Sentences of order texts, made ready for genes."""
    texts = dialect.run_sql(spark, sf_dir, mechanisms.TEXTS)
    return texts.select("article", rawtext.gene_sentences(F.col("text"), ["effic", "improv", "robust", "novel", "express", "engineer"]).alias("sentences"))


# ---- names of organisms -----------------------------------------------------------------------------------

_ARTICLES = dialect.duck_text(mechanisms.ARTICLES)
_TAXONOMY = dialect.duck_text(mechanisms.TAXONOMY)


def _families_out(text: str) -> str:
    for family in taxa.FAMILIES:
        text = rf"regexp_replace({text}, '\b{family}\b', '', 'g')"
    return text


_PLAIN = r"replace(regexp_replace(regexp_replace(whole, '<.*?>', '', 'g'), '[^a-zA-Z0-9 ]+', ' ', 'g'), 'sp strain ', 'sp strain')"


@query(
    "STR38",
    f"""with t as (select article, string_split(trim(regexp_replace({_families_out(_PLAIN)}, '\\s+', ' ', 'g')), ' ') as ws from ({_ARTICLES}) a),
    u as (select article, unnest(ws) as w, generate_subscripts(ws, 1) as pos from t), g as (select distinct genus from ({_TAXONOMY}) x),
    k as (select *, row_number() over (partition by article, w order by pos) as nth from u where w <> '')
    select t.article, coalesce(ws2, []) as words from t left join (select article, list(w order by pos) as ws2 from k
    where (length(w) > 2 and nth = 1) or regexp_full_match(w, '[0-9]{{1,2}}') or w = 'sp' or w in (select genus from g) or w in (select left(genus, 1) from g) group by article) y using (article)""",
)
def str38(spark, sf_dir):
    return taxa.name_words(dialect.run_sql(spark, sf_dir, mechanisms.ARTICLES), dialect.run_sql(spark, sf_dir, mechanisms.TAXONOMY), "whole")


#: Pairs of words of parts get new names, and so do some first words alone.
_SYNONYMS = "select distinct p_name as old, concat('N', textof(codepoints(p_name)), upper(p_name)) as new from part where codepoints(p_name) % 2 = 0 union all select distinct substr(p_name, 1, ordinal(p_name, ' ') - 1) as old, concat('F', textof(ordinal(p_name, ' '))) as new from part where ordinal(p_name, ' ') < 5"


@query(
    "STR39",
    f"""with s as ({dialect.duck_text(_SYNONYMS)}), t as (select article, unnest(string_split(whole, ' ')) w, generate_subscripts(string_split(whole, ' '), 1) pos from ({_ARTICLES}) a),
    n as (select *, lower(w || ' ' || lead(w) over (partition by article order by pos)) as pair from t),
    m as (select n.*, p.new as two, o.new as one, lag(p.new) over (partition by article order by pos) as before from n left join s p on n.pair = p.old left join s o on lower(n.w) = o.old)
    select article, coalesce(string_agg(coalesce(two, one, w), ' ' order by pos) filter (where before is null), '') as whole from m group by article""",
)
def str39(spark, sf_dir):
    articles = dialect.run_sql(spark, sf_dir, mechanisms.ARTICLES).select("article", "whole")
    return taxa.replace_names(articles, dialect.run_sql(spark, sf_dir, _SYNONYMS), "whole")


@query(
    "STR40",
    rf"""select doc_id, trim(regexp_replace(array_to_string(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+'),
    lambda w: not regexp_full_match(w, '(?i)({'|'.join(dict.fromkeys([*taxa.COMMON_TITLE, *taxa.COMMON_ABSTRACT, *taxa.COMMON_TEXT]))})e?s?d?i?n?g?')), ''), '\s+', ' ', 'g')) as kept from documents""",
)
def str40(spark, sf_dir):
    """Texts without the words that most papers hold."""
    common = list(dict.fromkeys([*taxa.COMMON_TITLE, *taxa.COMMON_ABSTRACT, *taxa.COMMON_TEXT]))
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(without_words(F.col("text"), common, "esding"), r"\s+", " ")).alias("kept"))


def _found(spark, sf_dir, *sources):
    """(article, organisms) of each source. Articles and what is found are written, as both are read more than once."""
    names = organisms.dictionary(dialect.run_sql(spark, sf_dir, mechanisms.TAXONOMY))
    articles = scratch.written(mechanisms._articles(spark, sf_dir).select("article", *sources))
    return [scratch.written(organisms.detect(articles.select("article", s), names, s).select("article", "organisms")) for s in sources]


_FULL = """k as (select left(name, 1) || ' ' || split_part(name, ' ', 2) as short, max(split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2)) as long from (select unnest(organisms) as name from known) z
    where strpos(name, ' ') > 1 and length(split_part(name, ' ', 1)) > 1 group by 1),
    e as (select article, unnest(organisms) as name, generate_subscripts(organisms, 1) as pos from f),
    r as (select article, list(n order by pos) as names from (select article, pos, case when length(split_part(name, ' ', 1)) = 1 and name not in ('C roseus', 'M separata', 'O furnacalis', 'P sibirica', 'E superba') then long else name end as n
    from e left join k on name = short) z where n is not null group by article)"""


@query(
    "STR41",
    f"""with articles as ({_ARTICLES}), f as (select * from {mechanisms._detected_sql('whole')} x), known as (select organisms from f), {_FULL}
    select f.article, r.names as organisms from f left join r using (article)""",
)
def str41(spark, sf_dir):
    """Names found in articles, abbreviated ones in full by the names that the corpus holds."""
    (found,) = _found(spark, sf_dir, "whole")
    return taxa.full_names(found, found.select(F.explode("organisms").alias("name")))


@query(
    "Q3",
    f"""with articles as ({_ARTICLES}), known as (select organisms from {mechanisms._detected_sql('whole')} x),
    f as (select article, case when organisms = ['yeast'] then null else organisms end as organisms from {mechanisms._detected_sql('title')} y), {_FULL}
    select f.article, f.organisms, case when r.names is null and f.organisms is not null then ['Saccharomyces cerevisiae'] else r.names end as names from f left join r using (article)""",
)
def q3(spark, sf_dir):
    """Organisms of titles: `yeast` alone is none; who has an organism and no full name is the default yeast."""
    title, whole = _found(spark, sf_dir, "title", "whole")
    title = title.withColumn("organisms", F.when(F.col("organisms") != F.array(F.lit(taxa.YEAST)), F.col("organisms"))).withColumn("names", F.col("organisms"))
    full = taxa.full_names(title, whole.select(F.explode("organisms").alias("name")), names="names")
    return full.withColumn("names", taxa.with_default_yeast(F.col("organisms"), F.col("names")))


_SPECIES = """select p_partkey as tax_id, case when p_size % 8 = 0 then concat('Candidatus ', g, ' ', s) when p_size % 8 = 1 then concat('''', g, '['' ', s) when p_size % 8 = 2 then concat(p_name, ' x') when p_size % 8 = 3 then concat('Mixed Culture ', g)
when p_size % 8 = 4 then g when p_size % 8 = 5 then concat('[', g, ' ', s, '] ', lower(p_brand)) when p_size % 8 = 6 then concat('Candidatus of ', s) else concat(g, ' ', s) end as species
from (select *, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2, ordinal(p_name, ' ') - 2)) as g, substr(p_name, ordinal(p_name, ' ') + 1) as s from part) x"""


@query(
    "STR47",
    f"""select min(tax_id) as tax_id, trim(trim(trim(trim(trim(n, ''''), '('), ')'), '['), ']') as full_name, g as genus, left(g, 1) || '. ' || case when strpos(n, ' ') > 0 then substr(n, strpos(n, ' ') + 1) end as species
    from (select tax_id, n, trim(trim(trim(split_part(n, ' ', 1), ''''), '['), ']') as g from (select tax_id, string_split(species, 'Candidatus ')[-1] as n from ({dialect.duck_text(_SPECIES)}) a where not contains(lower(species), 'mixed culture')) b) c
    where not (lower(g) = g and upper(g) <> g) and not (g = 'Candidatus' and contains(n, ' of ')) group by n, g""",
)
def str47(spark, sf_dir):
    return taxa.species_table(dialect.run_sql(spark, sf_dir, _SPECIES))


# ---- enzymes: nations are organisms, their suppliers' lines know genes --------------------------------------

_EC = """select n_name as organism, concat('g', textof(l_partkey % 60)) as gene, case when l_linenumber = 7 then '0' else concat(' 1.1.', textof(l_suppkey % 5), '.', textof(l_linenumber)) end as ec
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where"""
_KNOWN, _LISTED = f"{_EC} l_quantity > 48 and l_partkey % 60 < 40", f"{_EC} l_quantity < 3 and l_partkey % 60 between 20 and 50"
_WANTED = "select n_name as organism, concat('g', textof(o_orderkey % 60)) as gene from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
_RANKS = [f"NATION_{i}" for i in (7, 3, 11, 19, 2, 5)]
_IN_RANKS = f"list_position({dialect.duck_text('array(' + ', '.join(repr(r) for r in _RANKS) + ')')}, organism)"


@query(
    "JN15",
    f"""with known as ({dialect.duck_text(_KNOWN)}), listed as ({dialect.duck_text(_LISTED)}), wanted as (select distinct * from ({dialect.duck_text(_WANTED)}) x),
    own as (select organism, gene, coalesce(list_sort(list(distinct trim(ec)) filter (where trim(ec) not in ('', '0'))), []) as e from known group by 1, 2),
    first as (select gene, min({_IN_RANKS}) as rnk from listed where {_IN_RANKS} > 0 and trim(ec) not in ('', '0') group by gene),
    pop as (select gene, list_sort(list(distinct trim(ec))) as e from listed join first using (gene) where {_IN_RANKS} = rnk and trim(ec) not in ('', '0') group by gene),
    every as (select gene, list_sort(list(distinct trim(ec))) as e from known where {_IN_RANKS} > 0 and trim(ec) not in ('', '0') group by gene)
    select w.organism, w.gene, case when own.e is not null then own.e when {_IN_RANKS.replace('organism', 'w.organism')} > 0 and pop.e is not null then pop.e else coalesce(every.e, []) end as ecs,
    case when own.e is not null then 'exact' when {_IN_RANKS.replace('organism', 'w.organism')} > 0 and pop.e is not null then 'popular' when every.e is not null then 'across' else 'none' end as step
    from wanted w left join own on own.organism = w.organism and own.gene = w.gene left join pop on pop.gene = w.gene left join every on every.gene = w.gene""",
)
def jn15(spark, sf_dir):
    ask = lambda sql: dialect.run_sql(spark, sf_dir, sql)
    return taxa.enzymes(ask(_WANTED), ask(_KNOWN), ask(_LISTED), _RANKS)


# ---- relations: an order is a paper, its lines are sentences with one relation ---------------------------------

_GENE = "case when l_partkey % 7 = 0 then 'ATP' when l_partkey % 7 = 1 then 'PEP' when l_partkey % 7 = 2 then concat('gen', textof(l_suppkey % 9)) when l_partkey % 7 = 3 then 'NADH' else concat('GN', textof(l_suppkey % 9)) end"
_ACTION = "case when l_suppkey % 5 = 0 then 'was overexpressed' when l_suppkey % 5 = 1 then 'were deleted' when l_suppkey % 5 = 2 then 'deletion' when l_suppkey % 5 = 3 then concat(g, ' knockout') else concat('expression ', g) end"
_CASES = [
    "the G cycle was slow", "the (G) pathway grew", "the pathway [G] grew", "AB and G genes", "the G pathway genes were deleted, XY G genes", "G synthesis", "the pool of G",
    "nicotinamide adenine dinucleotide (G)", "G and XYZ pool", "(G) supply", "G production", "G synthase (abc)", "pyruvate (G) kinase", "converting G fast", "converting G gene",
    "G was not overexpressed", "the genes of G were never deleted", "G was seen and was overexpressed, not deleted", "G was no longer overexpressed", "G was deleted", "G were not seen but never deleted", "it was failed to be overexpressed",
]
_SAID = "case " + " ".join(f"when (l_orderkey + l_linenumber) % {len(_CASES)} = {i} then '{c}'" for i, c in enumerate(_CASES)) + " end"
_FOUND = f"select paper, replace(said, 'G', g) as sentence, concat(g, ' -> ', act) as relation from (select *, {_ACTION} as act from (select l_orderkey as paper, l_suppkey, {_GENE} as g, {_SAID} as said from lineitem) x) y"
_B, _E = r"'[\(\[\{]?\b' || g || '\b[\)\]\}]?'", relation_cleanup.ENZYMES


@query(
    "Q5",
    rf"""with f as (select distinct paper, sentence as s, split_part(relation, ' -> ', 1) as g, split_part(relation, ' -> ', 2) as act from ({dialect.duck_text(_FOUND)}) x),
    m as (select *, upper(g) = g as cap from f where g <> 'PEP' and not (g = 'NADH' and regexp_matches(s, '(?i)\bnicotinamide adenine dinucleotide\b')) and not (g = 'ATP' and regexp_matches(s, '(?i)\badenosine triphosphate\b'))
      and not (g in ('ATP', 'NADH') and regexp_matches(s, '(?i)({relation_cleanup.AMOUNTS})\s+(of\s+)?' || {_B}))),
    p as (select *, regexp_extract(s, '(?is)^(.*?)\b' || g || '\b\s+(?:pathway\s+genes|cycle\s+genes|genes)\b', 1) as lead from m),
    w as (select *, regexp_extract(lead, '(\w+)\s*$', 1) as word from p),
    k as (select * from w where not cap or not (
      len(regexp_extract_all(s, '(?i)' || {_B} || '\s+(?:pathway|cycle)\b')) > len(regexp_extract_all(s, '(?i)' || {_B} || '\s+(?:pathway|cycle)\b\s+genes')) or regexp_matches(s, '(?i)\b(?:pathway|cycle)\s+' || {_B}) or regexp_matches(s, '(?i)\b' || g || '\b\s+synthesis')
      or (regexp_matches(s, '(?i)\b' || g || '\b\s+(?:pathway\s+genes|cycle\s+genes|genes)\b') and not (lower(word) in ('and', 'or') or regexp_full_match(word, '[A-Z0-9]+'))))),
    n as (select * from k where not cap or not (
      regexp_matches(s, '(?i)\b' || g || '\b(?:[\s,]+(?:and|or)\s+[A-Z0-9]{{2,6}})?\s+(pool|availability|bioavailability|content|tolerance|transport|supply|formation|accumulation|excretion|production|biosynthesis|productivity)\b')
      or regexp_matches(s, '(?i)' || {_B} || '\s+((bio)?availability|pool|content|tolerance|transport|supply|formation|accumulation|production|biosynthesis|productivity)')
      or regexp_matches(s, '(?i)' || {_B} || '[-\s]+\w*({_E})\s*\(\w+\)') or regexp_matches(s, '(?i)\w+\s*\(' || {_B} || '\)[-\s]+\w*({_E})') or regexp_matches(s, '(?i)\b' || {_B} || '[-\s]*({_E})')
      or (length(g) <= 5 and regexp_matches(s, '(?i)converting\s+' || {_B}) and not regexp_matches(s, '(?i)' || {_B} || '\s+(expression|activity|gene|promoter|transcript|substrate|enzyme|catalyze|catalyses|active site|kinetic|mutant|modeling|structure)')))),
    v as (select *, regexp_extract(act, '(?i)(?:^|\s)(?:was|were)\s+(\S+)', 1) as verb, list_slice(string_split(regexp_replace(s, '(?i)\b(was|were)\b', chr(1), 'g'), chr(1)), 2, 99) as parts from n),
    b as (select *, list_filter(list_transform(parts, lambda x: regexp_extract(x, '(?is)^(.*?\b(?:not|never|no|failed\s+to)\b.*?)\b' || verb || '\b', 1)), lambda x: x <> '')[1] as said from v),
    d as (select paper, g, case when verb = '' or said is null then act when regexp_matches(said, '(?i)\bnot\b') then 'was not ' || split_part(act, ' ', -1) when regexp_matches(said, '(?i)\bnever\b') then 'was never ' || split_part(act, ' ', -1)
      when regexp_matches(said, '(?i)\bno\b') then 'no ' || split_part(act, ' ', -1) else 'failed to ' || split_part(act, ' ', -1) end as act from b)
    select distinct paper, g || ' -> ' || case when ends_with(act, ' ' || g) then left(act, length(act) - length(g) - 1) when starts_with(act, g || ' ') then substr(act, length(g) + 2) else act end as relation from d""",
)
def q5(spark, sf_dir):
    """Metabolites, pathways and products out by the sentence, denials told, repeated names out."""
    return relation_cleanup.cleaned(dialect.run_sql(spark, sf_dir, _FOUND))


# ---- terms ---------------------------------------------------------------------------------------------------

_NAMES = "select l_orderkey, l_linenumber, l_partkey, concat(case when l_suppkey % 4 = 0 then 'E. coli ' when l_suppkey % 4 = 1 then 'S cerevisiae yeast ' when l_suppkey % 4 = 2 then 'human Bacillus C glutamicum ' else 'lactic sulfur ' end, p_name) as name from lineitem join part on l_partkey = p_partkey"


def _replaced(text: str, pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new}')"
    return text


@query("STR10", f"select l_orderkey, l_linenumber, l_partkey, {_replaced('lower(name)', terms.ALIASES)} as name from ({dialect.duck_text(_NAMES)}) x")
def str10(spark, sf_dir):
    return dialect.run_sql(spark, sf_dir, _NAMES).withColumn("name", terms.with_aliases(F.col("name")))


@query(
    "STR7",
    f"select l_orderkey, l_linenumber, l_partkey, {_replaced('lower(name)', [(p, '') for p in terms.ORGANISM_PARTS])} as organism_free, {_replaced('lower(name)', [(p, '') for p in terms.OTHER_PARTS])} as other_free from ({dialect.duck_text(_NAMES)}) x",
)
def str7(spark, sf_dir):
    """Names without parts that name organisms, and without other ones, in words too."""
    rows = dialect.run_sql(spark, sf_dir, _NAMES)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", terms.without_parts(F.col("name"), terms.ORGANISM_PARTS).alias("organism_free"), terms.without_parts(F.col("name"), terms.OTHER_PARTS).alias("other_free"))


#: Lists of products as an order's lines tell them, with what is none.
_LISTS = """select l_orderkey as article, alistby(item, place) as items from (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as place,
case when l_suppkey % 16 = 0 then 'March 12, 2004' when l_suppkey % 16 = 1 then concat('~', textof(l_partkey)) when l_suppkey % 16 = 2 then concat('[ ', textof(l_partkey), ' ]') when l_suppkey % 16 = 3 then 'Vol. 12' when l_suppkey % 16 = 4 then 'Production'
when l_suppkey % 16 = 5 then concat('industrial ', p_name) when l_suppkey % 16 = 6 then concat(' ', p_name, ' Fermentations ') when l_suppkey % 16 = 7 then concat('active  variant ', p_name, ' supplement') when l_suppkey % 16 = 8 then '' when l_suppkey % 16 = 9 then 'stable element'
when l_suppkey % 16 = 10 then concat('pure bioethanol ', p_name) when l_suppkey % 16 = 11 then concat('Growth ', p_name, ' genes') when l_suppkey % 16 = 12 then 'lignocellulosic' when l_suppkey % 16 = 13 then 'cell growth' else p_name end as item
from lineitem join part on l_partkey = p_partkey) x group by l_orderkey"""
_STRIPPED = r"regexp_replace(item, '^\s+|\s+$', '', 'g')"
_EXPLODED = f"(select article, unnest(items) as item, generate_subscripts(items, 1) as pos from ({dialect.duck_text(_LISTS)}) x)"


def _product_sql(text: str) -> str:
    for rule in terms.PRODUCT_RULES:
        new = rule.replacement.replace("$", "\\")
        text = f"regexp_replace({text}, '{rule.pattern.removeprefix('(?U)')}', '{new}', 'g')"
    return text


@query(
    "STR22",
    rf"""with v as (select article, pos, regexp_replace({_product_sql('item')}, '^\s+|\s+$', '', 'g') as v from {_EXPLODED} e),
    r as (select article, pos, case when list_contains({dialect.duck_text('array(' + ', '.join(repr(w) for w in terms.FIRST_WORDS) + ')')}, lower(split_part(v, ' ', 1))) then array_to_string(list_slice(regexp_split_to_array(v, '\s+'), 2, 99), ' ') else v end as v from v)
    select o.article, l.items from (select distinct article from v) o left join (select article, list(v order by pos) as items from r where v <> '' group by article) l using (article)""",
)
def str22(spark, sf_dir):
    return dialect.run_sql(spark, sf_dir, _LISTS).select("article", terms.product_terms(F.col("items")).alias("items"))


_ENDING = rf"(?i)(?:{'|'.join(terms.ENDINGS)})(?:al)?s?$"


@query(
    "ARR6",
    rf"""with p as (select *, {_STRIPPED} as s from {_EXPLODED} e), w as (select *, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') as ws,
    case {' '.join(f"when regexp_matches(s, '{p}') then '{r}'" for p, r in terms.NO_PRODUCT)} end as reason from p),
    a as (select *, len(ws) > 0 and regexp_matches(ws[1], '{_ENDING}') as lead from w), b as (select *, case when lead then ws[2:] else ws end as w2 from a),
    c as (select *, len(w2) > 0 and regexp_matches(w2[-1], '{_ENDING}') as trail from b), d as (select *, case when trail then w2[:-2] else w2 end as w3 from c)
    select article, cast(pos as int) as place, item, case when reason is null and len(w3) > 0 then array_to_string(w3, ' ') end as product,
    case when reason is not null then item || ': ' || reason else concat_ws('; ', case when lead then ws[1] || ': {terms.LEADING}' end, case when trail then w2[-1] || ': {terms.TRAILING}' end, case when len(w3) = 0 then item || ': {terms.NOTHING_LEFT}' end) end as log from d""",
)
def arr6(spark, sf_dir):
    """Items of product lists with what is left of them and why the rest went."""
    rows = dialect.run_sql(spark, sf_dir, _LISTS).select("article", F.posexplode(terms.trimmed_products(F.col("items"))).alias("i", "x"))
    log = F.array_join(F.transform("x.log", lambda e: F.concat(e["value"], F.lit(": "), e["reason"])), "; ")
    return rows.select("article", (F.col("i") + 1).alias("place"), "x.item", "x.product", log.alias("log"))


@query("STR29")
def str29(spark, sf_dir):
    """Sentences of the corpus."""
    return table(spark, sf_dir, "documents").select("doc_id", terms.sentences_of(F.col("text")).alias("sentences"))


@query("STR30")
def str30(spark, sf_dir):
    """Clauses of the corpus by the marks and words at which gene texts are cut."""
    return table(spark, sf_dir, "documents").select("doc_id", terms.gene_clauses(terms.sentences_of(F.col("text"))).alias("clauses"))


# ---- lexicons: first words of parts are adjectives, second ones nouns ------------------------------------------

_ADJECTIVES = "select distinct substr(p_name, 1, ordinal(p_name, ' ') - 1) as word from part union all select '12' as word from region"
_NOUNS = "select distinct substr(p_name, ordinal(p_name, ' ') + 1) as word from part"
_TEXTS = mechanisms.TEXTS


def _lexicon_sql(words: str, more: str = "") -> str:
    return rf"""with t as (select article, text from ({dialect.duck_text(_TEXTS)}) x), w as (select article, unnest(ws) as w, generate_subscripts(ws, 1) as pos from (select article, regexp_split_to_array(text, '\s+') as ws from t) y)
    select t.article, coalesce(k, '') as text from t left join (select article, string_agg(w, ' ' order by pos) as k from w where w <> '' and w not in (select word from ({dialect.duck_text(words)}) l {more}) group by article) z using (article)"""


@query("STR4", _lexicon_sql(_ADJECTIVES, "where not regexp_full_match(word, '[0-9]+')"))
def str4(spark, sf_dir):
    """Texts without adjectives, told as they are written; numbers stay."""
    return lexicon.without_lexicon(dialect.run_sql(spark, sf_dir, _TEXTS), dialect.run_sql(spark, sf_dir, _ADJECTIVES), numbers=False)


@query("STR5", _lexicon_sql(_NOUNS))
def str5(spark, sf_dir):
    """Texts without nouns."""
    return lexicon.without_lexicon(dialect.run_sql(spark, sf_dir, _TEXTS), dialect.run_sql(spark, sf_dir, _NOUNS))


# ---- reaction groups: what Q7 chooses, with the organisms of the orders' lines -----------------------------------

_LIVED = "select l_orderkey as paper, concat('org', textof(l_suppkey % 6)) as organism from lineitem where l_quantity < 40"


@query(
    "Q8",
    f"""with q as (select * from ({mechanisms._CHOSEN}) z), r as (select paper, gene, stage as class, split_part(e, '=', 1) as xref, reactions as ids, array_to_string(list_sort(list_distinct(string_split(split_part(e, '=', 2), ';'))), ',') as ec_key from (select *, unnest(chosen_ecs) as e from q) y),
    o as ({dialect.duck_text(_LIVED)}),
    g as (select xref, ec_key, min((paper, gene)) as first, list_sort(list(distinct gene)) as genes, list_sort(list(distinct paper)) as papers, list_sort(list(distinct class)) as classes, list_sort(list_distinct(flatten(list(ids)))) as ids from r group by 1, 2),
    l as (select xref, ec_key, list_sort(list(distinct organism)) as organisms from r join o using (paper) group by 1, 2), t as (select xref, count(distinct paper) as n from r group by 1)
    select xref || '_' || row_number() over (partition by xref order by first, ec_key) as grp, xref, ec_key, genes, papers, classes, ids, coalesce(organisms, []) as organisms, len(papers) as n_papers, round(len(papers) / n, 6) as share
    from g left join l using (xref, ec_key) join t using (xref)""",
)
def q8(spark, sf_dir):
    chosen = mechanisms.q7(spark, sf_dir).select("paper", "gene", F.col("stage").alias("class"), F.col("reactions").alias("ids"), F.explode("chosen_ecs").alias("e"))
    rows = chosen.select("paper", "gene", "class", "ids", F.substring_index("e", "=", 1).alias("xref"), F.split(F.substring_index("e", "=", -1), ";").alias("ecs"))
    return reaction_groups.reaction_groups(rows, dialect.run_sql(spark, sf_dir, _LIVED))


# ---- vectors and curation ----------------------------------------------------------------------------------------


@query(
    "ML1",
    r"""with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]{2,}')) as term from documents), c as (select doc_id, term, count(*) as x from w group by 1, 2),
    t as (select term, count(*) as df from c group by 1), n as (select count(*)::double as n from documents),
    m as (select doc_id, term, x, ln((1 + n) / (1 + df)) + 1 as idf, df <= 0.85 * n as rare from c join t using (term), n),
    u as (select doc_id, term, 'counts' as kind, x::double as v, 1.0::double as l from m where rare
    union all select doc_id, term, 'tfidf', x * idf, sqrt(sum((x * idf) * (x * idf)) over (partition by doc_id)) from m where rare
    union all select doc_id, term, 'tfidf_all', x * idf, sqrt(sum((x * idf) * (x * idf)) over (partition by doc_id)) from m
    union all select doc_id, term, 'tfidf_twice', x * idf * idf, sqrt(sum((x * idf * idf) * (x * idf * idf)) over (partition by doc_id)) from m)
    select doc_id, kind, count(*) as n_terms, round(sum(v / l), 6) as total, round(max(v / l), 6) as top, min(term) as first from u group by doc_id, kind""",
)
def ml1(spark, sf_dir):
    """The four weightings of every document, as sums over its words."""
    rows = vectors.sums(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "kind", "n_terms", F.round("total", 6).alias("total"), F.round("top", 6).alias("top"), "first")


_DOI = "concat('10.1000/', textof(page_id % 50), case when page_id % 7 = 0 then 'A+' else 'a' end)"
_FETCHED = f"select page_id as pm_id, {_DOI} as doi, url as title, textof(codepoints(html)) as abstract from pages union all select page_id as pm_id, {_DOI} as doi, url as title, textof(codepoints(html)) as abstract from pages where page_id % 3 = 0"
_EXPECTED = "select page_id as pm_id, concat('\"10.1000/', textof(page_id % 50), case when page_id % 11 = 0 then 'b' when page_id % 5 = 0 then 'A see' else 'a' end, '\"') as doi, concat('\"', url, '\"') as title from pages"
_CORRECTIONS = "select concat('10.1000/', textof(item_id % 60), 'b') as doi, text as abstract from benchmark"


@query(
    "Q12",
    rf"""with a as (select distinct pm_id, doi, title, abstract from ({dialect.duck_text(_FETCHED)}) x), e as (select pm_id, trim(doi, '"') as doi, trim(title, '"') as title from ({dialect.duck_text(_EXPECTED)}) y),
    f as (select pm_id, min(split_part(trim(trim(lower(doi)), '+'), ' ', 1)) as has from a group by pm_id), w as (select e.pm_id from e join f using (pm_id) where split_part(trim(trim(lower(e.doi)), '+'), ' ', 1) <> has)
    select *, 'fetched' as origin from a where pm_id not in (select pm_id from w) union all
    select null as pm_id, c.doi, t.title, c.abstract, 'curated' as origin from (select distinct * from ({dialect.duck_text(_CORRECTIONS)}) z) c left join (select distinct doi, title from e) t on t.doi = c.doi""",
)
def q12(spark, sf_dir):
    ask = lambda sql: dialect.run_sql(spark, sf_dir, sql)
    return curation.curated(ask(_FETCHED), ask(_EXPECTED), ask(_CORRECTIONS))
