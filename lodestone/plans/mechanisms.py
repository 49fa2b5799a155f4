"""Queries of the operators that need a mechanism of their own: reaction choice, lineage, organisms, sentences, publishing.

Their oracles are written apart from the operators, from the rules.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import phrases, splitters
from ..operators import explorer, learners, lineage, organisms, publish, reactions, relations, scratch, sentences
from . import dialect

QUERIES, ORACLE = {}, {}
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- reactions: candidates of a gene in a paper, by the lines of an order ---------------------------------

_CASES = """(0, 'gpd1', array('1.1.1.8'), array('GLYCLTDX', 'G3PD2', 'GAPD')), (1, 'tdh3', array('1.1.1.8', '1.2.1.12'), array('GLYCLTDX', 'G3PD2', 'GAPD')),
(2, 'glk', array('2.7.1.1'), array('ATPM', 'HEX4', 'HEX7', 'HEX1')), (3, 'glkA', array('2.7.1.2'), array('ATPM', 'HEX1', 'HEX4')), (4, 'ldhA', array('1.1.1.27'), array('LDH_D', 'MDH')),
(5, 'lctE', array('1.1.1.27', '1.4.1.9'), array('LDH_D', 'MDH')), (6, 'yqeF', array('2.3.1.9', '2.3.1.16'), array('ACACT1r', 'ACACT2r')), (7, 'fadA', array('2.3.1.16'), array('ACACT1r', 'ACACT2r', '3OXCOAT')),
(8, 'atf1p', array('3.1.2.20', '2.3.1.84'), array('FACOAE80', 'FACOAE60', 'FACOAE181')), (9, 'pykF', array('2.7.1.40'), array('PYK', 'PPS')), (10, 'ptsG', array('2.7.1.69', '6.1.1.18'), array('GLNTRS', 'TREPTSpp')),
(11, 'mdhX', array('1.1.1.27'), array('LDH_D', 'MDH')), (12, 'pdc1', array('4.1.1.1'), array('PYRDC', 'ACALD', 'ALCD2x'))"""
CANDIDATES = f"""select gene, l_orderkey as paper, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as int) as ord, concat('R', textof(l_partkey)) as reaction, at(xrefs, 1 + l_linenumber % asize(xrefs)) as xref,
case when l_quantity > 49 then aconcat(ecs, array('9.9.9.9')) when l_linenumber % 2 = 0 then aslice(ecs, 1, 1) else ecs end as ecs,
case when l_orderkey % 3 = 0 then 0 when l_orderkey % 3 = 1 then 2 else cast(l_quantity as int) % 3 end as specific,
case when l_orderkey % 2 = 0 then 1 else cast(l_quantity as int) % 2 end as matches,
case when l_orderkey % 5 < 3 then 1 when l_quantity > 40 then null else cast(l_partkey % 3 as int) end as presence
from lineitem join (select * from (values {_CASES}) as t(r, gene, ecs, xrefs)) k on r = l_orderkey % 13"""

_PICKED = f"""c as (select *, lower(gene) lg, upper(xref) ux, coalesce(presence, 0) p from ({dialect.duck_text(CANDIDATES)}) z),
s as (select * from c qualify specific = max(specific) over (partition by gene, paper)),
s1 as (select *, count(*) over w n1, max(case when presence is null or presence <> 0 then 1 else 0 end) over w known from s window w as (partition by gene, paper)),
hot as (select * from s1 where specific > 0 and (known = 0 or presence is null or presence <> 0) qualify p = max(p) over (partition by gene, paper)),
hot1 as (select *, count(*) over (partition by gene, paper) n2 from hot),
hot2 as (select * from hot1 qualify matches = max(matches) over (partition by gene, paper)),
cold as (select * from s1 where specific = 0 qualify matches = max(matches) over (partition by gene, paper)),
cold1 as (select *, count(*) over (partition by gene, paper) n2 from cold),
cold2 as (select * from cold1 qualify p = max(p) over (partition by gene, paper)),
normal as (select *, count(*) over (partition by gene, paper) n3 from (select * from hot2 union all select * from cold2)),
labelled as (select *, case when n1 = 1 then 'SINGLE_AFTER_SPECIFIC_SCORE' when specific > 0 and n2 = 1 then 'CASE_A: PREFER_TOP_MODEL (max_score>0)'
  when specific > 0 and n3 = 1 then 'CASE_B: SINGLE_BY_MATCHCOUNT' when specific > 0 then 'CASE_C: TIED_BY_MATCHCOUNT_KEEP_MODEL'
  when n2 = 1 then 'CASE_D: ZERO_SCORE_SINGLE_BY_MATCHCOUNT' when n3 > 1 then 'CASE_E: ZERO_SCORE_TIED_KEEP_MODEL' else 'CASE_F: ZERO_SCORE_FINAL_TIE_BREAK' end as label from normal)"""


@query("WIN2", f"with {_PICKED} select gene, paper, min(label) as stage, count(*) as n from labelled group by gene, paper")
def win2(spark, sf_dir):
    """The stage that tells each group, and how many candidates it leaves."""
    c = dialect.run_sql(spark, sf_dir, CANDIDATES)
    best = reactions.staged_pick(c).withColumnsRenamed({"gene": "g", "paper": "p"})
    key = reactions.staged_key(F.col("specific"), F.col("matches"), F.col("presence"))
    left = c.join(best, (F.col("gene") == F.col("g")) & (F.col("paper") == F.col("p"))).where(key == F.col("top"))
    return left.groupBy("gene", "paper").agg(F.min("case").alias("stage"), F.count("*").alias("n"))


_CHOSEN = f"""with {_PICKED},
g as (select gene, paper, any_value(lg) lg, list(distinct ux) xs, list_sort(list_distinct(flatten(list(ecs)))) es from c group by gene, paper),
e as (select gene, paper, case when list_has_all(xs, ['GLYCLTDX', 'G3PD2']) and lg in ('gpd1', 'gpd2') and es = ['1.1.1.8'] then ['G3PD2']
   when list_has_all(xs, ['GLYCLTDX', 'G3PD2']) and lg in ('gpd1', 'gpd2', 'tdh1', 'tdh2', 'gpd3', 'tdh3') and es = ['1.1.1.8', '1.2.1.12'] then ['G3PD2', 'GAPD']
   when list_has_all(xs, ['ATPM', 'HEX4']) and es = ['2.7.1.1'] then ['HEX7', 'HEX4', 'HEX1']
   when list_has_all(xs, ['ATPM', 'HEX1']) and es = ['2.7.1.2'] then ['HEX1', 'HEX4'] end as takes,
   case when list_has_all(xs, ['GLYCLTDX', 'G3PD2']) then 'SPECIAL_G3P_RULE' when es = ['2.7.1.1'] then 'SPECIAL_ATPM_HEX2_RULE' else 'SPECIAL_ATPM_HEX_RULE' end as early from g),
after as (select l.gene, l.paper, l.ord, l.reaction, l.xref, l.ux, l.ecs, l.specific, l.matches, l.presence, l.lg, l.label from labelled l join e using (gene, paper) where takes is null
  union all select c.gene, c.paper, c.ord, c.reaction, c.xref, c.ux, c.ecs, c.specific, c.matches, c.presence, c.lg, early from c join e using (gene, paper) where takes is not null and list_contains(takes, c.ux)),
h as (select gene, paper, any_value(lg) lg, list(distinct ux) xs, list_sort(list_distinct(flatten(list(ecs)))) es from after group by gene, paper),
f as (select gene, paper, case when list_has_all(xs, ['LDH_D', 'MDH']) and es in (['1.1.1.27'], ['1.1.1.27', '1.4.1.9']) and (lg like 'ldh%' or lg in ('cg3219', 'lcte')) then struct_pack(x := 'LDH_D', label := 'SPECIAL_LDH_vs_MDH_RULE')
   when list_has_all(xs, ['ACACT1R', 'ACACT2R']) and es in (['2.3.1.9'], ['2.3.1.16', '2.3.1.9']) then struct_pack(x := 'ACACT1R', label := 'SPECIAL_ACACT1r_RULE')
   when list_has_all(xs, ['ACACT1R', 'ACACT2R', '3OXCOAT']) and es = ['2.3.1.16'] then struct_pack(x := '3OXCOAT', label := 'SPECIAL_3OXCOAT_RULE')
   when list_has_all(xs, ['FACOAE80', 'FACOAE60', 'FACOAE181']) and list_has_all(es, ['3.1.2.20', '2.3.1.84']) and lg like 'atf1%' then struct_pack(x := 'FACOAE80', label := 'SPECIAL_FACOAE80_RULE_WITH_OHACT1')
   when list_has_all(xs, ['PYK', 'PPS']) and es = ['2.7.1.40'] then struct_pack(x := 'PYK', label := 'SPECIAL_PYK_RULE')
   when list_has_all(xs, ['GLNTRS', 'TREPTSPP']) and es = ['2.7.1.69', '6.1.1.18'] and lg = 'ptsg' then struct_pack(x := 'TREPTSPP', label := 'SPECIAL_G3P_RULE') end as late from h),
last as (select a.*, coalesce(late.label, label) as final from after a join f using (gene, paper) where late is null or late.x = a.ux),
kept as (select gene, paper, ord, reaction, xref, specific, matches, presence, final, 0 as copy from last
  union all select gene, paper, ord, reaction, 'OHACT1', specific, matches, presence, final, 1 from last where final = 'SPECIAL_FACOAE80_RULE_WITH_OHACT1'),
o as (select gene, paper, arg_min(final, (copy, ord)) as final, arg_min(specific, ord) filter (where specific is not null) as specific, arg_min(matches, ord) filter (where matches is not null) as matches, arg_min(presence, ord) filter (where presence is not null) as presence from kept group by gene, paper),
x as (select gene, paper, xref, min((copy, ord)) as k from kept group by gene, paper, xref),
xl as (select gene, paper, list(xref order by k) as xrefs from x group by gene, paper),
r as (select gene, paper, reaction, min((copy, ord)) as k from kept group by gene, paper, reaction),
rl as (select gene, paper, list(reaction order by k) as reactions from r group by gene, paper),
ax as (select gene, paper, xref, min(ord) as k from c anti join x using (gene, paper, xref) group by gene, paper, xref),
al as (select gene, paper, list(xref order by k) as alternatives from ax group by gene, paper),
el as (select gene, paper, list(xref || '=' || es order by xref) as ecs from (select x.gene, x.paper, x.xref, coalesce(string_agg(distinct e, ';' order by e), '') as es
  from x left join (select gene, paper, xref as cx, unnest(ecs) as e from c) c on c.gene = x.gene and c.paper = x.paper and contains(c.cx, x.xref) group by 1, 2, 3) group by 1, 2)
select o.gene, o.paper, reactions, xrefs, coalesce(alternatives, list_value()) as alternatives, o.specific, o.matches, o.presence, o.final as stage, el.ecs as chosen_ecs
from o join xl using (gene, paper) join rl using (gene, paper) left join al using (gene, paper) join el using (gene, paper)"""


@query("Q7", _CHOSEN)
def q7(spark, sf_dir):
    out = reactions.choose(dialect.run_sql(spark, sf_dir, CANDIDATES))
    ecs = F.array_sort(F.transform(F.map_entries("chosen_ecs"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";"))))
    return out.withColumn("chosen_ecs", ecs).withColumnRenamed("case", "stage")


# ---- lineage ----------------------------------------------------------------------------------------------

_LINKS = "select o_orderkey as id, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent, concat('o', textof(o_orderkey)) as name, substr(o_orderpriority, 1, 1) as rank from orders"
_RANKS = ("1", "2", "3", "4", "5")


@query(
    "SRC17",
    f"""with recursive links as ({dialect.duck_text(_LINKS)}),
    up(id, anc, depth) as (select id, id, 0 from links union all select up.id, links.parent, depth + 1 from up join links on links.id = up.anc where links.parent is not null)
    select up.id, any_value(own.name) as name, any_value(own.rank) as rank, {', '.join(f"arg_min(a.name, depth) filter (where a.rank = '{r}') as rank_{r}" for r in _RANKS)},
    string_agg(a.name, '; ' order by depth desc) as path from up join links own on own.id = up.id join links a on a.id = up.anc group by up.id""",
)
def src17(spark, sf_dir):
    """An order's parent is the customer's order before it; its rank is the priority."""
    found = lineage.lineage(dialect.run_sql(spark, sf_dir, _LINKS), _RANKS)
    return found.withColumnsRenamed({r: f"rank_{r}" for r in _RANKS})


# ---- organisms: an order is an article, its lines say what it is about --------------------------------------

_GENUS = "concat(upper(substr(p_name, 1, 1)), substr(p_name, 2, ordinal(p_name, ' ') - 2))"
_SPECIES = "substr(p_name, ordinal(p_name, ' ') + 1)"
_PHRASE = f"""case when l_tax < 0.02 then concat('grown in ', {_GENUS}, ' ', {_SPECIES}, ' cells')
when l_tax < 0.03 then concat(substr({_GENUS}, 1, 1), ' ', {_SPECIES}, ' strain') when l_tax < 0.04 then concat('some ', {_GENUS}, ' sp PCC ', textof(l_partkey), ' was')
when l_tax < 0.05 then concat({_GENUS}, ' spp ', l_returnflag, 'b ', {_GENUS}, ' pcc ', l_linestatus) when l_tax < 0.06 then concat('the ', substr({_GENUS}, 1, 1), ' sp ', {_SPECIES}, ' Yeast')
when l_tax < 0.07 then 'yeast extract' else concat('9 sp ', upper(p_name), ' A 1 ', {_GENUS}) end"""
_PLACE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
ARTICLES = f"""select l_orderkey as article, ajoin(alistby(case when place % 4 = 1 then phrase end, place), ' ') as title, ajoin(alistby(case when place % 4 = 2 then phrase end, place), ' ') as abstract,
ajoin(alistby(case when place % 4 not in (1, 2) then phrase end, place), ' ') as body, ajoin(alistby(phrase, place), ' ') as whole
from (select l_orderkey, row_number() over (partition by l_orderkey order by {_PLACE}) as place, {_PHRASE} as phrase from lineitem join part on p_partkey = l_partkey) x group by l_orderkey"""
#: Names of more than eight letters are known; genera are theirs.
TAXONOMY = f"select distinct {_GENUS} as genus, concat({_GENUS}, ' ', {_SPECIES}, ' ', lower(p_type)) as full_name from part where codepoints(p_name) > 8"


def _detected_sql(source: str) -> str:
    """(article, organisms) of the texts of a column of the view articles, by windows over single tokens."""
    return f"""(with t as (select article, unnest(string_split({source}, ' ')) w, generate_subscripts(string_split({source}, ' '), 1) pos from articles),
    n as (select article, pos, w a, lead(w) over o b, lead(w, 2) over o c, lead(w, 3) over o d from t window o as (partition by article order by pos)),
    tax as ({dialect.duck_text(TAXONOMY)}),
    full_pair as (select distinct lower(split_part(full_name, ' ', 1) || ' ' || split_part(full_name, ' ', 2)) k from tax),
    initial_pair as (select distinct left(k, 1) || ' ' || split_part(k, ' ', 2) k from full_pair),
    code as (select distinct lower(split_part(full_name, ' ', 2)) k from tax union select distinct lower(split_part(full_name, ' ', 3)) from tax),
    g as (select *, upper(left(a, 1)) || lower(substr(a, 2)) cap, upper(left(a, 1)) || lower(substr(a, 2)) in (select genus from tax) is_genus from n where a <> '' and b <> ''),
    h as (select *, bool_or(is_genus) over (partition by article) any_full from g),
    k as (select *, lower(b) in ('sp', 'spp', 'pcc') as general, lower(a || ' ' || b) as pair from h
      where (is_genus or (not any_full and cap in (select left(genus, 1) from tax))) and not regexp_matches(a, '^[0-9]') and not (length(a) = 1 and length(b) = 1)),
    m as (select *, pair in (select k from full_pair) as in_full, pair in (select k from initial_pair) as in_initial,
      general and c <> '' and (regexp_full_match(c, '[A-Z0-9]+') or lower(c) in (select k from code) or lower(c) in ('pcc', 'atcc')) as third,
      lower(c) in ('pcc', 'atcc') and d <> '' and (regexp_full_match(d, '[A-Z0-9]+') or lower(d) in (select k from code)) as fourth from k),
    s as (select article, pos, in_full or general as sure, a || ' ' || b || case when third then ' ' || c else '' end || case when third and fourth then ' ' || d else '' end as name
      from (select * replace (coalesce(third, false) as third, coalesce(fourth, false) as fourth) from m) where in_full or general or in_initial),
    f as (select article, sure, name, min(pos) pos from s where sure or article not in (select article from s where sure) group by article, sure, name),
    o as (select article, list(name order by pos) as organisms from f group by article)
    select a.article, coalesce(o.organisms, case when list_contains(list_transform(string_split({source}, ' '), lambda x: lower(x)), 'yeast') then ['yeast'] end) as organisms from articles a left join o using (article))"""


def _articles(spark, sf_dir):
    a = dialect.run_sql(spark, sf_dir, ARTICLES)
    return a.select("article", *[F.split(c, " ").alias(c) for c in ("title", "abstract", "body", "whole")])


@query("NLP7", f"with articles as ({dialect.duck_text(ARTICLES)}) select article, organisms from {_detected_sql('whole')} x")
def nlp7(spark, sf_dir):
    names = organisms.dictionary(dialect.run_sql(spark, sf_dir, TAXONOMY))
    return organisms.detect(_articles(spark, sf_dir), names, "whole").select("article", "organisms")


_YEAST_OUT = "case when organisms = ['yeast'] then null else organisms end"


@query(
    "Q2",
    f"""with articles as ({dialect.duck_text(ARTICLES)}) select t.article, coalesce(t.o, a.o, b.o) as organisms,
    case when t.o is not null then 'title' when a.o is not null then 'abstract' when b.o is not null then 'body' else 'not_found' end as organisms_source
    from (select article, {_YEAST_OUT} as o from {_detected_sql('title')} x) t join (select article, {_YEAST_OUT} as o from {_detected_sql('abstract')} x) a using (article)
    join (select article, {_YEAST_OUT} as o from {_detected_sql('body')} x) b using (article)""",
)
def q2(spark, sf_dir):
    """Title, then abstract, then the rest; `yeast` alone is no answer, and the next source is asked."""
    names = organisms.dictionary(dialect.run_sql(spark, sf_dir, TAXONOMY))
    ask = lambda df, source: organisms.detect(df, names, source)
    return organisms.cascade(_articles(spark, sf_dir), ["title", "abstract", "body"], ask, "organisms", ignore=F.array(F.lit("yeast"))).select("article", "organisms", "organisms_source")


# ---- sentences: an order's lines are the sentences of its text -----------------------------------------------

_SENTENCE = """case when l_discount < 0.02 then concat('Improved production of ', p_name, ' by a new strain.') when l_discount < 0.03 then concat('Converting ', p_name, ' into ', lower(p_type), ' was robust.')
when l_discount < 0.04 then concat('A novel ', p_name, ' is efficiently produced in vats, which the team saw.') when l_discount < 0.06 then concat('Deletion of gen', textof(l_suppkey), ' increased titer, and gen', textof(l_suppkey % 7), ' was overexpressed which helped.')
when l_discount < 0.08 then concat('Biosynthesis and production of ', p_name, ' via gen', textof(l_suppkey % 7), ' overexpression (i.e., gen', textof(l_suppkey), ' was deleted) is robust.') else concat('The ', p_name, ' was stored; nothing else.') end"""
TEXTS = f"""select l_orderkey as article, ajoin(alistby(sentence, place), ' ') as text, min(case when place = 1 then sentence end) as title, ajoin(alistby(case when place > 1 then sentence end, place), ' ') as abstract,
ordered(aset(alist(concat('gen', textof(l_suppkey))))) as own, ordered(aset(alist(concat('gen', textof(l_suppkey % 7))))) as others
from (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by {_PLACE}) as place, {_SENTENCE} as sentence from lineitem join part on p_partkey = l_partkey) x group by l_orderkey"""
STOPS = "a an the in is was were which by via into this that with for from new it".split()


def _texts(spark, sf_dir):
    return dialect.run_sql(spark, sf_dir, TEXTS).withColumn("genes", F.array_union("own", "others"))


@query("RST19")
def rst19(spark, sf_dir):
    """The relations of each clause that names a gene, from an extractor that sees each distinct clause once."""
    found = sentences.extract_once(sentences.clauses(_texts(spark, sf_dir), STOPS), relations.actions_near)
    return found.select("article", "place", "clause", "relations")


@query("NLP11")
def nlp11(spark, sf_dir):
    """Relations by document and source: title, abstract, the whole text, and title with abstract."""
    both = F.concat_ws("\n", "title", "abstract")
    sources = {"Title": F.col("title"), "Abstract": F.col("abstract"), "Text": F.col("text"), "Title_Abstract": both}
    return sentences.document_relations(_texts(spark, sf_dir), sources, relations.actions_near, STOPS)


_ROOTS = ("effic", "improv", "robust", "novel")


@query("TOP9")
def top9(spark, sf_dir):
    return sentences.with_first_product(_texts(spark, sf_dir), "text", STOPS, roots=_ROOTS).select("article", "product", "n_parts")


def _prose(spark, sf_dir):
    """Every text of the corpus, and those of orders, for Python workers: what one is sent at once is bounded by bytes."""
    if spark.conf.get(BATCH_BYTES, None) in (None, "67108864", "64MB", "64m", "-1"):
        spark.conf.set(BATCH_BYTES, "8m")
    texts = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return texts.unionByName(_texts(spark, sf_dir).select(F.lit("order").alias("kind"), F.col("article").alias("id"), "text"))


@query("STR26")
def str26(spark, sf_dir):
    """Every text of the corpus, and those of orders, which hold the phrases."""
    return _prose(spark, sf_dir).select("kind", "id", phrases.production_phrases("text", _ROOTS).alias("plain"))


@query("STR28")
def str28(spark, sf_dir):
    """Words of the given roots near `production` out, sentence by sentence."""
    out = phrases.by_sentence(phrases.without_adjectives(_ROOTS))
    return _prose(spark, sf_dir).select("kind", "id", out(F.col("text")).alias("plain"))


# ---- learners: which documents are toxic, by their words -------------------------------------------------


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("label"))
    fold = F.when(learners.held_out(F.col("doc_id")), F.lit(learners.UNSEEN)).otherwise(learners.folds_of(F.col("doc_id")))
    return d.withColumn("fold", fold)


_NB = {"multinomial": {"alpha": (0.1, 1.0, 21.0), "prior": ("data", "even", "0.3,0.7", "0.2,0.8", "0.5,0.5")}, "bernoulli": {"alpha": (0.1, 1.0, 10.0), "binarize": (0.0, 0.5, 1.0), "prior": ("data", "even", "0.3,0.7", "0.2,0.8", "0.5,0.5")}}
_NB_SQL = r"""with d as (select doc_id, text, toxic as label, doc_id % 5 as fold from documents join labels using (doc_id) where (doc_id // 5) % 5 <> 0),
w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\w\w+')) as term from d), t as (select doc_id, term, count(*) x from w group by doc_id, term),
v as (select term from t group by term having count(*) <= 0.85 * (select count(*) from d)),
k as (select t.doc_id, d.fold, d.label, t.term, t.x from t join v using (term) join d using (doc_id)),
f as (select distinct fold as f from d), n as (select f, count(*) filter (where label = 0) n0, count(*) filter (where label = 1) n1 from d join f on fold <> f group by f),
a as (select 'multinomial' as learner, alpha, null::double as b from (values (0.1), (1.0), (21.0)) q(alpha) union all select 'bernoulli', alpha, b from (values (0.1), (1.0), (10.0)) q(alpha), (values (0.0), (0.5), (1.0)) r(b)),
mass as (select f, b, term, sum(case when label = 0 then y else 0 end) m0, sum(case when label = 1 then y else 0 end) m1 from (
  select f, k.term, k.label, u.b, case when k.fold = f then 0 when u.b is null then x when x > u.b then 1 else 0 end as y from k, f, (select distinct b from a) u) group by f, b, term),
tot as (select f, b, sum(m0) all0, sum(m1) all1, count(*) as nv from mass group by f, b),
wt as (select m.f, m.term, a.learner, a.alpha::double alpha, a.b, case when a.b is null then ln((m1 + a.alpha) / (all1 + a.alpha * nv)) - ln((m0 + a.alpha) / (all0 + a.alpha * nv)) else
  ln((m1 + a.alpha) / (n1 + 2 * a.alpha)) - ln(1 - (m1 + a.alpha) / (n1 + 2 * a.alpha)) - ln((m0 + a.alpha) / (n0 + 2 * a.alpha)) + ln(1 - (m0 + a.alpha) / (n0 + 2 * a.alpha)) end as w,
  case when a.b is not null then ln(1 - (m1 + a.alpha) / (n1 + 2 * a.alpha)) - ln(1 - (m0 + a.alpha) / (n0 + 2 * a.alpha)) else 0 end as c
  from mass m join tot on tot.f = m.f and tot.b is not distinct from m.b join n on n.f = m.f join a on a.b is not distinct from m.b),
c as (select f, learner, alpha, b, sum(c) c from wt group by all),
s as (select k.doc_id, wt.learner, wt.alpha, wt.b, sum(case when wt.b is null then x when x > wt.b then 1 else 0 end * w) s from k join wt on wt.term = k.term and wt.f = k.fold group by all),
m as (select d.doc_id, d.fold, d.label, c.learner, c.alpha, c.b, coalesce(s.s, 0) + c.c as margin from d join c on c.f = d.fold left join s on s.doc_id = d.doc_id and s.learner = c.learner and s.alpha = c.alpha and s.b is not distinct from c.b),
p as (select m.*, q.prior, margin + case q.prior when 'data' then ln(n1 / n0) when '0.3,0.7' then ln(0.7 / 0.3) when '0.2,0.8' then ln(0.8 / 0.2) else 0 end > 0 as told
  from m join n on n.f = m.fold, (values ('data'), ('even'), ('0.3,0.7'), ('0.2,0.8'), ('0.5,0.5')) q(prior)),
g as (select learner, alpha, b, prior, fold, avg(case when told = (label = 1) then 1.0 else 0.0 end) acc from p group by all)
select learner, 'alpha=' || regexp_replace(alpha::varchar, '\.0$', '') || ',prior=' || prior || case when b is not null then ',binarize=' || regexp_replace(b::double::varchar, '\.0$', '') else '' end as params, round(avg(acc), 9) as accuracy from g group by learner, alpha, b, prior"""


@query("ML3B", _NB_SQL)
def ml3b(spark, sf_dir):
    """The whole grid of both kinds of naive Bayes, on the four fifths that are learnt from."""
    return learners.bayes_search(_labelled(spark, sf_dir).where(F.col("fold") != learners.UNSEEN), "text")


@query("ML3")
def ml3(spark, sf_dir):
    """The grids of naive Bayes, of the kernel machine and of the forest, in five folds of four fifths of the rows; the best of each against the last."""
    d = _labelled(spark, sf_dir)
    out = learners.bayes_chosen(d, "text")
    for kind in ("svc", "forest"):
        out = out.unionByName(learners.margin_search(d, "text", kind))
    return out


@query("ML2")
def ml2(spark, sf_dir):
    """Each learner at each point of its grid, and a logistic one, fitted on four fifths of the rows and held against the last."""
    d = _labelled(spark, sf_dir)
    out = learners.bayes_held_out(d, "text")
    x, width = learners.weighted(d, "text")
    for kind in ("svc", "forest"):
        told, points = learners.grid_margins(x, width, kind, [learners.UNSEEN])
        names = spark.createDataFrame([(i, kind, learners.said(p)) for i, p in enumerate(points)], "point int, learner string, params string")
        told = told.select("point", "label", (F.col("margin") > 0).cast("int").alias("predicted"))
        out = out.unionByName(names.join(learners.evaluate(told, "point"), "point").drop("point"))
    v = scratch.written(learners.as_vectors(x, max(1, width)))
    told = learners.Margin("logistic").told(v.where(F.col("fold") != learners.UNSEEN), v.where(F.col("fold") == learners.UNSEEN), "x", "m")
    logistic = learners.evaluate(told.select("label", (F.col("m") > 0).cast("int").alias("predicted")))
    return out.unionByName(logistic.withColumns({"learner": F.lit("logistic"), "params": F.lit("")}))


@query("ML6")
def ml6(spark, sf_dir):
    """Two kinds of naive Bayes and a linear margin learner on title, body and both, stacked out of fold."""
    parts = F.split("text", "\n", 2)
    sources = {"title": F.get(parts, F.lit(0)), "body": F.get(parts, F.lit(1)), "both": F.col("text")}
    bayes = [learners.Bayes("multinomial", 1.0), learners.Bayes("bernoulli", 1.0)]
    return learners.stack(_labelled(spark, sf_dir), sources, bayes, [learners.Margin("svc", {"max_iter": 10})])


# ---- publishing and exploring -----------------------------------------------------------------------------

_WAY = "case doc_id % 3 when 0 then 'Positive' when 1 then 'Negative' else 'Odd' end"
_SOURCE = f"""select textof(doc_id) as pmid, case when ordinal(text, chr(10)) > 0 then substr(text, 1, ordinal(text, chr(10)) - 1) else text end as title, 1990 + n_chars % 30 as year,
concat(coalesce(lang, ''), ', ', coalesce(source, ''), ',', upper(coalesce(lang, ''))) as organism, case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then coalesce(source, '') else concat(coalesce(source, ''), ', x') end as product,
concat('{{', chr(34), 'g', textof(doc_id % 7), chr(34), ': ', chr(34), {_WAY}, ',Negative', chr(34), ', ', chr(34), 'h', chr(34), ': [', chr(34), 'Other', chr(34), ']}}') as genes from documents"""


def _published(spark, sf_dir):
    folder = scratch.folder(spark)
    rows = dialect.run_sql(spark, sf_dir, _SOURCE)
    names = dict(zip(rows.columns, publish.REQUIRED, strict=True))
    rows.select(*[F.col(a).cast("string").alias(b) for a, b in names.items()]).write.option("header", True).option("sep", ";").option("escape", '"').csv(f"{folder}/published.csv")
    publish.publish(spark, f"{folder}/published.csv", f"{folder}/out")
    record = "pmid string, title string, year int, organism string, organisms array<string>, product string, products array<string>, genes array<struct<name: string, directions: array<string>>>"
    meta = "recordCount long, organismCount long, productCount long, geneCount long, minYear int, maxYear int, organismSuggestions array<string>, productSuggestions array<string>, geneSuggestions array<string>"
    return publish.current(spark, f"{folder}/out", "records", record), publish.current(spark, f"{folder}/out", "meta", meta)


_RECORDS = f"""(select pmid, trim(coalesce(title, '')) as title, year, trim(organism) as organism, list_filter([trim(x) for x in string_split(organism, ',')], lambda x: x <> '') as o0, trim(product) as product,
[struct_pack(name := 'g' || (pmid::bigint % 7), directions := case pmid::bigint % 3 when 0 then ['Positive', 'Negative'] when 1 then ['Negative'] else ['Other', 'Negative'] end), struct_pack(name := 'h', directions := ['Other'])] as genes
from ({dialect.duck_text(_SOURCE)}) s)"""
_RECORDS = f"(select *, list_filter(o0, lambda x, i: list_position([lower(y) for y in o0], lower(x)) = i) as organisms, case when product = '' then []::varchar[] when contains(product, ',') then list_distinct([product] || list_filter([trim(x) for x in string_split(product, ',')], lambda x: x <> '')) else [product] end as products from {_RECORDS} r)"


@query("Q9B", f"select pmid, title, year, organism, case when len(organisms) = 0 then [organism] else organisms end as organisms, product, list_sort(products) as products, [g.name || '=' || array_to_string(g.directions, '+') for g in genes] as genes from {_RECORDS} x")
def q9b(spark, sf_dir):
    """The records as published and read back."""
    found, _ = _published(spark, sf_dir)
    genes = F.transform("genes", lambda g: F.concat(g["name"], F.lit("="), F.array_join(g["directions"], "+")))
    return found.select("pmid", "title", "year", "organism", "organisms", "product", F.array_sort("products").alias("products"), genes.alias("genes"))


_TOP = "(select list(k order by n desc, lower(k), k) from (select k, count(*) n from (select unnest({0}) as k from {1} x) group by k order by n desc, lower(k), k limit 300))"


@query(
    "Q9C",
    f"""with r as {_RECORDS} select count(*) as recordCount, min(year) as minYear, max(year) as maxYear, (select count(distinct o) from (select unnest(organisms) o from r)) as organismCount,
    count(distinct product) filter (where product <> '') as productCount, (select count(distinct g) from (select unnest([x.name for x in genes]) g from r)) as geneCount,
    {_TOP.format('organisms', 'r')} as organismSuggestions, {_TOP.format("case when product <> '' then [product] else [] end", 'r')} as productSuggestions, {_TOP.format('[y.name for y in genes]', 'r')} as geneSuggestions from r""",
)
def q9c(spark, sf_dir):
    """The meta document that is published with the records."""
    return _published(spark, sf_dir)[1]


_ASKED = explorer.Request(query="a", first=2015, last=1995)
_EXPLORED = "select doc_id as pmid, string_split(text, chr(10))[1] as title, 1990 + n_chars % 30 as year, list_filter([lang, source], lambda x: x is not null) as organisms, list_filter([source], lambda x: x is not null) as products, 'g' || (doc_id % 7) as gene, case doc_id % 3 when 0 then 'Positive' when 1 then 'Negative' else 'Other' end as way from documents"
_PANEL = "select '{0}' as panel, row_number() over (order by n desc, k) as place, k as label, n from (select lower(trim(v)) k, count(distinct pmid) n from (select pmid, unnest({0}s) as v from f) group by lower(trim(v))) qualify place <= 5"


@query(
    "Q10B",
    f"""with f as (select * from ({_EXPLORED}) r where contains(lower(concat_ws(' ', pmid::varchar, title, array_to_string(organisms, ' '), array_to_string(products, ' '), gene)), 'a') and year between 1995 and 2015)
    select 'count' as panel, 0 as place, null as label, count(*) as n from f union all select 'direction', 0, w, count(way) from (values ('Positive'), ('Negative'), ('Other')) q(w) left join f on way = w group by w
    union all {_PANEL.format('organism')} union all {_PANEL.format('product')}
    union all select 'page', row_number() over (order by year desc, lower(title), pmid) as place, pmid::varchar, year from f qualify place <= 20""",
)
def q10b(spark, sf_dir):
    """Every panel of a request: count, page (with years), directions and top labels, from one reading of the documents."""
    d = table(spark, sf_dir, "documents")
    way = F.when(F.col("doc_id") % 3 == 0, "Positive").when(F.col("doc_id") % 3 == 1, "Negative").otherwise("Other")
    r = d.select(
        F.col("doc_id").alias("pmid"), F.split("text", "\n")[0].alias("title"), (1990 + F.col("n_chars") % 30).alias("year"), F.array_compact(F.array("lang", "source")).alias("organisms"),
        F.array_compact(F.array("source")).alias("products"), F.array(F.struct(F.concat(F.lit("g"), (F.col("doc_id") % 7).cast("string")).alias("name"), F.array(way).alias("directions"))).alias("genes"),
    )
    told = explorer.insights(explorer.search_view(r), _ASKED)
    rows = [("count", 0, None, told.count), *[("direction", 0, k, n) for k, n in told.directions.items()]]
    out = spark.createDataFrame(rows, "panel string, place int, label string, n long")
    place = lambda *by: F.row_number().over(W.orderBy(*by)).alias("place")  # noqa: E731  of a page or five labels
    for panel, top in (("organism", told.organisms), ("product", told.products)):
        out = out.unionByName(top.select(F.lit(panel).alias("panel"), place(F.desc("n"), "key"), F.col("key").alias("label"), "n"))
    return out.unionByName(told.page.select(F.lit("page").alias("panel"), place(*explorer.order(_ASKED)), F.col("pmid").cast("string").alias("label"), F.col("year").cast("long").alias("n")))


# ---- product lists: what the lines of an order name -------------------------------------------------------

_COLOUR, _THING = "substr(p_name, 1, ordinal(p_name, ' ') - 1)", "substr(p_name, ordinal(p_name, ' ') + 1)"
_ACID = f"""case when l_discount < 0.02 then concat({_COLOUR}, 'ic acid butyl ', {_THING}, 'ic acid') when l_discount < 0.03 then concat({_COLOUR}, ' acid ', {_THING}, 'ine') when l_discount < 0.04 then concat({_COLOUR}, ' acid (', {_THING}, ') ', {_COLOUR}, '-one')
when l_discount < 0.05 then concat('fatty acid ', {_THING}, 'yl ', {_COLOUR}) when l_discount < 0.06 then concat({_COLOUR}, ' acid ', {_THING}) when l_discount < 0.07 then concat({_COLOUR}, 'ate ', {_THING}, 'ase ', {_THING}, 'ate') when l_discount < 0.08 then concat({_COLOUR}, 'ate ', {_THING}, ' phosphate') else p_name end"""
_ANTIBIOTIC = f"""case when l_discount < 0.02 then concat('polyketide antibiotic ', {_COLOUR}, 'in') when l_discount < 0.04 then concat({_THING}, ' antibiotics (', {_COLOUR}, ') ', {_THING}, 'in and anti-parasitic ', {_COLOUR}, 'in dose')
when l_discount < 0.05 then 'antibiotic resistance' when l_discount < 0.06 then 'Macrolide antibiotics' when l_discount < 0.07 then concat({_COLOUR}, ' antibiotic') else p_name end"""


def _lists(spark, sf_dir, element):
    return dialect.run_sql(spark, sf_dir, f"select l_orderkey as article, alistby({element}, l_linenumber) as names from lineitem join part on p_partkey = l_partkey group by l_orderkey")


@query("ARR7")
def arr7(spark, sf_dir):
    return _lists(spark, sf_dir, _ACID).select("article", F.array_sort(splitters.split_acids(F.col("names"))).alias("names"))


@query("ARR8")
def arr8(spark, sf_dir):
    return _lists(spark, sf_dir, _ANTIBIOTIC).select("article", F.array_sort(splitters.split_antibiotics(F.col("names"))).alias("names"))


# ---- phrases about genes ----------------------------------------------------------------------------------

_GENE_PHRASE = f"""case when l_tax < 0.02 then concat('the very new ', {_THING}, 'ase gene (', {_COLOUR}, 'A) and ', {_COLOUR}, 'ase gene (', {_THING}, 'B) grew') when l_tax < 0.03 then concat('genes of ', p_name, ' (', {_COLOUR}, 'A) and its ', {_THING}, ' (', {_THING}, 'B)')
when l_tax < 0.04 then concat('gene of ', p_name, ' (', {_COLOUR}, 'A)') when l_tax < 0.05 then concat('the ', p_name, 'ase (', {_COLOUR}, 'C) gene') when l_tax < 0.06 then concat('the ', {_THING}, 'ase genes') else p_name end"""
_GENE_TEXTS = f"select l_orderkey, l_linenumber, l_partkey, {_GENE_PHRASE} as phrase from lineitem join part on p_partkey = l_partkey"


@query(
    "RST20",
    f"""select l_orderkey, l_linenumber, l_partkey, case when l_tax < 0.02 then 'the ' || c || 'A gene and ' || t || 'B gene grew' when l_tax < 0.03 then 'genes of ' || c || 'A and ' || t || 'B' when l_tax < 0.04 then 'genes of ' || c || 'A'
    when l_tax < 0.05 then 'the ' || c || 'C gene' when l_tax < 0.06 then 'the genes' else c || ' ' || t end as phrase
    from (select *, split_part(p_name, ' ', 1) c, split_part(p_name, ' ', 2) t from lineitem join part on p_partkey = l_partkey) x""",
)
def rst20(spark, sf_dir):
    return dialect.run_sql(spark, sf_dir, _GENE_TEXTS).withColumn("phrase", phrases.gene_phrases(F.col("phrase")))
