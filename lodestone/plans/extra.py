"""Queries whose operator is a function of the library rather than one SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, cleaning, text
from ..functions.rules import without_words
from ..operators import classify, explorer, genes, products, relations, scratch, similar, together
from ..sources import readers, writers

QUERIES, ORACLE = {}, {}
RECORD_SQL = "select doc_id as pmid, string_split(text, chr(10))[1] as title, 1990 + n_chars % 30 as year, list_value(lang) as organisms, list_value(source) as products, list_value(struct_pack(name := concat('g', cast(doc_id % 7 as varchar)), directions := list_value(case doc_id % 3 when 0 then 'Positive' when 1 then 'Negative' else 'Other' end))) as genes from documents"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    return scratch.folder(spark)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    way = F.when(F.col("doc_id") % 3 == 0, "Positive").when(F.col("doc_id") % 3 == 1, "Negative").otherwise("Other")
    return d.select(
        F.col("doc_id").alias("pmid"),
        F.split("text", "\n")[0].alias("title"),
        (1990 + F.col("n_chars") % 30).alias("year"),
        F.array("lang").alias("organisms"),
        F.array("source").alias("products"),
        F.array(F.struct(F.concat(F.lit("g"), (F.col("doc_id") % 7).cast("string")).alias("name"), F.array(way).alias("directions"))).alias("genes"),
    )


REQUEST = explorer.Request(query="the", organism="en", direction="Negative", first=2015, last=1995)
_FOUND = f"select * from ({RECORD_SQL}) r where contains(lower(concat_ws(' ', cast(pmid as varchar), title, organisms[1], products[1], genes[1].name)), 'the') and list_contains(organisms, 'en') and list_contains(genes[1].directions, 'Negative') and year between 1995 and 2015"
_SCORE = "(case when lower(title) = 'the' then 20 when starts_with(lower(title), 'the') then 10 when contains(lower(title), 'the') then 6 else 0 end)"


@query("FIL12", f"select pmid, year from ({_FOUND}) x")
def fil12(spark, sf_dir):
    return explorer.matches(explorer.search_view(records(spark, sf_dir)), REQUEST).select("pmid", "year")


@query("FIL13", f"select pmid from ({RECORD_SQL}) x")
def fil13(spark, sf_dir):
    return explorer.matches(explorer.search_view(records(spark, sf_dir)), explorer.Request()).select("pmid")


@query("TOP6", f"select pmid, {_SCORE} as score from ({_FOUND}) x")
def top6(spark, sf_dir):
    return explorer.matches(explorer.search_view(records(spark, sf_dir)), REQUEST).select("pmid", "score")


@query("Q10", f"select pmid, title, year, score from (select *, {_SCORE} as score from ({_FOUND}) x) y order by score desc, year desc, pmid limit 20")
def q10(spark, sf_dir):
    return explorer.page(explorer.search_view(records(spark, sf_dir)), REQUEST).select("pmid", "title", "year", "score")


@query("Q9", f"select count(*) as records, count(distinct organisms[1]) as organisms, count(distinct products[1]) as products, count(distinct genes[1].name) as genes, min(year) as first, max(year) as last from ({RECORD_SQL}) x")
def q9(spark, sf_dir):
    r = records(spark, sf_dir)
    labels = r.select("pmid", "year", F.col("organisms")[0].alias("o"), F.col("products")[0].alias("p"), F.col("genes")[0]["name"].alias("g"))
    return labels.agg(F.count("*").alias("records"), F.countDistinct("o").alias("organisms"), F.countDistinct("p").alias("products"), F.countDistinct("g").alias("genes"), F.min("year").alias("first"), F.max("year").alias("last"))


# ---- sources and sinks: written, read again, and held against the table -----------------------------

_NATION = "select n_nationkey, n_name, n_regionkey from nation"
_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"


def _nation(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("SRC1", _NATION)
def src1(spark, sf_dir):
    return readers.csv(spark, writers.save(_nation(spark, sf_dir), folder(spark) + ".csv"), _SCHEMA)


@query("SRC2", _NATION)
def src2(spark, sf_dir):
    return readers.csv(spark, writers.save(_nation(spark, sf_dir), folder(spark) + ".tsv"), _SCHEMA, sep="\t")


@query("SRC3", "select cast(n_nationkey as varchar) as id, n_name as name, 1990 + n_regionkey as year from nation")
def src3(spark, sf_dir):
    out = folder(spark)
    _nation(spark, sf_dir).selectExpr("n_nationkey as id", "n_name as name", "1990 + n_regionkey as Year").write.option("header", True).option("sep", ";").csv(out)
    return readers.published(spark, out, ["id", "name", "Year"]).withColumnRenamed("Year", "year")


@query("SRC4", "select cast(n_nationkey as varchar) as key, n_name as name, n_regionkey as region from nation")
def src4(spark, sf_dir):
    out = folder(spark)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))))
    _nation(spark, sf_dir).agg(F.to_json(pairs).alias("value")).write.option("compression", "gzip").text(out)
    return readers.json_index(spark, out, "name: string, region: bigint")


@query("SRC5", "select s_suppkey, s_name from supplier")
def src5(spark, sf_dir):
    out, s = folder(spark), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    for i in range(3):
        s.where(F.col("s_suppkey") % 3 == i).write.parquet(f"{out}/part={i}")
    return readers.by_name([spark.read.parquet(f"{out}/part={i}") for i in range(3)])


@query("SRC6", "select cast(n_nationkey as varchar) as key, n_name as text from nation")
def src6(spark, sf_dir):
    out = folder(spark)
    one = F.to_json(F.create_map(F.col("n_nationkey").cast("string"), F.col("n_name")))
    _nation(spark, sf_dir).repartition(1).select(one.alias("value")).repartition(5).write.option("maxRecordsPerFile", 1).text(out)
    return readers.json_maps(spark, out)


@query("SRC7", "select n_nationkey as id, n_regionkey = 1 as flagged from nation")
def src7(spark, sf_dir):
    out = folder(spark)
    block = F.concat(F.lit("Name: "), "n_name", F.when(F.col("n_regionkey") == 1, "\nTopic: biology").otherwise(""), F.lit("\nId: "), F.col("n_nationkey").cast("string"))
    _nation(spark, sf_dir).select(block.alias("value")).write.option("lineSep", "\n----\n").text(out)
    b = readers.blocks(spark, out, "\n----\n")
    return b.select(F.regexp_extract("block", r"Id: (\d+)", 1).cast("long").alias("id"), F.contains("block", F.lit("biology")).alias("flagged"))


@query("SRC8", "select cast(n_nationkey as varchar) as value, 2 as depth from nation")
def src8(spark, sf_dir):
    out = folder(spark)
    _nation(spark, sf_dir).select(F.concat(F.lit("nation.key = "), F.col("n_nationkey").cast("string")).alias("value")).write.text(out)
    return readers.records(spark, out).select("value", F.size("path").alias("depth"))


@query("SRC9", "select n_name as gene, concat('K', cast(n_nationkey as varchar)) as ko from nation")
def src9(spark, sf_dir):
    out = folder(spark)
    line = F.concat(F.lit("D      "), "n_name", F.lit("\tK"), F.col("n_nationkey").cast("string"))
    _nation(spark, sf_dir).select(F.explode(F.array(F.lit("C    head"), line)).alias("value")).write.text(out)
    return readers.htext(spark, out)


@query("SRC10", "select n_nationkey as taxon from nation where n_nationkey not in (select s_nationkey from supplier where s_suppkey % 2 = 0)")
def src10(spark, sf_dir):
    out = folder(spark)
    table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").withColumn("taxon", F.col("s_nationkey")).write.partitionBy("taxon").parquet(out)
    return _nation(spark, sf_dir).select(F.col("n_nationkey").alias("taxon")).join(spark.read.parquet(out).select("taxon").distinct(), "taxon", "left_anti")


@query("SRC11")
def src11(spark, sf_dir):
    return spark.createDataFrame([(q,) for q in readers.search_request(["yeast", "coli"], "TIAB", (2000, 2002))], "request string")


@query("SRC12", "select n_name as title, n_nationkey as id from nation")
def src12(spark, sf_dir):
    out = folder(spark)
    one = F.concat(F.lit("<article><id>"), F.col("n_nationkey").cast("string"), F.lit("</id><title>"), "n_name", F.lit("</title></article>"))
    whole = F.concat(F.lit("<set>"), F.array_join(F.collect_list(one), ""), F.lit("</set>"))
    _nation(spark, sf_dir).agg(whole.alias("value")).write.text(out)
    return readers.xml_sections(spark, out, "article", "id long, title string")


@query("SRC13", "select page_id, concat(regexp_replace(url, '[?].*$', ''), '.full') as link from pages")
def src13(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?].*$", ""), F.lit(".full")).alias("link"))


@query("SRC14", "select page_id, case when contains(url, '.com') then 'html' when contains(url, '.org') then 'xml' else 'pdf' end as way from pages")
def src14(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.route(F.col("url"), [(".com", "html"), (".org", "xml")]).alias("way"))


@query("SRC18", _NATION)
def src18(spark, sf_dir):
    out = folder(spark)
    line = F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    _nation(spark, sf_dir).select(F.explode(F.array(F.lit("# comment"), line)).alias("value")).write.text(out)
    return readers.commented_tsv(spark, out, _SCHEMA)


@query("SRC19", "select concat('m', cast(n_regionkey as varchar)) as model, n_name as reaction_id from nation")
def src19(spark, sf_dir):
    out = folder(spark)
    n = _nation(spark, sf_dir).groupBy(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("id")).agg(F.collect_list(F.struct(F.col("n_name").alias("id"))).alias("reactions"))
    n.write.json(out)
    return readers.model_reactions(spark, out)


@query("SRC20", "select distinct unnest(regexp_extract_all(html, 'href=\"(/[A-Za-z]+)\"', 1)) as link from pages")
def src20(spark, sf_dir):
    return readers.links(table(spark, sf_dir, "pages"), "html", 'href="(/[A-Za-z]+)"')


@query("SNK1", "select 1 as first, 1 as second, count(*) as n from nation")
def snk1(spark, sf_dir):
    base = folder(spark) + ".parquet"
    a, b = (writers.save(_nation(spark, sf_dir), base) for _ in range(2))
    return spark.read.parquet(b).agg(F.lit(int(a == base)).alias("first"), F.lit(int(b.endswith("_new_v1.parquet"))).alias("second"), F.count("*").alias("n"))


@query("SNK3", "select n_name from nation union all select n_name from nation")
def snk3(spark, sf_dir):
    out = folder(spark)
    for _ in range(2):
        writers.append_tsv(_nation(spark, sf_dir).select("n_name", F.lit("a\tb")), out)
    return spark.read.option("sep", "\t").schema("n_name string, x string").csv(out).select("n_name")


@query("SNK4", "select n_name, n_regionkey as year from nation")
def snk4(spark, sf_dir):
    out = folder(spark)
    writers.by_year(_nation(spark, sf_dir).select("n_name", F.col("n_regionkey").alias("year")), out)
    return spark.read.option("header", True).csv(out).select("n_name", F.col("year").cast("long").alias("year"))


@query("SNK5", "select n_nationkey, n_name from nation")
def snk5(spark, sf_dir):
    out, n = folder(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writers.document(n, n.agg(F.count("*").alias("recordCount")), out)
    return spark.read.schema("n_nationkey int, n_name string").json(f"{out}/records")


@query("SNK6", "select concat('\"', cast(n_nationkey as varchar), '\",\"', case when n_nationkey % 3 = 0 then concat('''=', n_name) else concat(n_name, '\"\"x') end, '\"') as value from nation")
def snk6(spark, sf_dir):
    n = _nation(spark, sf_dir)
    return writers.export_lines(n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("="), "n_name")).otherwise(F.concat("n_name", F.lit('"x'))).alias("cell")))


# ---- text and lists -----------------------------------------------------------------------------------


@query("STR6")
def str6(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.stem_words("text").alias("stems"))


@query("STR9")
def str9(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fold_accents("text").alias("folded"))


@query("STR46")
def str46(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", relations.without_repeated_name(F.concat("p_type", F.lit(" -> "), "p_type", F.lit(" deletion"))).alias("relation"))


@query("ARR3")
def arr3(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_genes(F.concat(F.lit("{'"), "p_type", F.lit("': ['up', 'down']}"))).alias("genes"))


@query("ARR5", "select p_partkey, list_value(string_split(p_name, ' ')[1], 'acid b', 'c') as names from part")
def arr5(spark, sf_dir):
    tokens = F.array(F.split("p_name", " ")[0], F.lit(","), F.lit("acid"), F.lit("b"), F.lit(","), F.lit("and"), F.lit("c"))
    return table(spark, sf_dir, "part").select("p_partkey", arrays.split_products(tokens).alias("names"))


@query("SET6", "select p_partkey, list_value(p_type, 'x') as v from part where upper(p_type) <> 'X'")
def set6(spark, sf_dir):
    v = arrays.distinct_ignoring_case(F.array("p_type", F.lit("x"), F.lower("p_type"), F.lit("X")))
    return table(spark, sf_dir, "part").where("upper(p_type) <> 'X'").select("p_partkey", v.alias("v"))


@query("ARR9")
def arr9(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    top = p.groupBy("w").count().orderBy(F.desc("count"), "w").limit(150)
    return p.join(F.broadcast(top), "w").groupBy("p_partkey").agg(F.array_sort(F.collect_set("w")).alias("terms"))


@query("ARR6B", "select p_partkey, case when p_brand = 'Brand#1' then 'fake' end as reason from part")
def arr6(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", products.cleaned(F.array("p_brand"), ["brand#1"])[0]["reason"].alias("reason"))


@query("RST34")
def rst34(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([a-z]{3}[A-Z])\b"), 1)).alias("genes"))


@query("STR40B")
def str40(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", without_words(F.col("text"), ["the", "strain", "study"], "esding").alias("plain"))


# ---- an order's lines as lists: the order of the SQL ties where part keys lie a million apart ------------


def _parts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return together.in_file_order(lines, "l_orderkey", F.col("l_partkey"), F.col("l_linenumber") * 1000000 + F.col("l_partkey"))


@query("AGG2")
def agg2(spark, sf_dir):
    return _parts(spark, sf_dir).select("l_orderkey", F.col("values").alias("parts"))


@query("AGG5")
def agg5(spark, sf_dir):
    return _parts(spark, sf_dir).select("l_orderkey", F.array_join(F.col("values").cast("array<string>"), "").alias("joined"))


@query("ARR10")
def arr10(spark, sf_dir):
    return _parts(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.filter("values", lambda e: ~(e % 14).isin(1, 2, 3, 5, 8, 13)).alias("kept"))


@query("ARR18")
def arr18(spark, sf_dir):
    return _parts(spark, sf_dir).select(F.col("l_orderkey").alias("k"), F.filter("values", lambda e: e != F.get("values", F.lit(0))).alias("others"))


# ---- joins, dictionaries, extraction ------------------------------------------------------------------


@query("JN5")
def jn5(spark, sf_dir):
    n = together.counted(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_partkey")
    return n.select(F.col("left").alias("gene"), F.col("right").alias("reaction"), "n")


@query("JN14")
def jn14(spark, sf_dir):
    """Nations whose names stand in the text of a part: pieces are cut once a distinct text, and parts meet what these hold."""
    texts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("NATION_"), F.col("p_size").cast("string")).alias("s"))
    pieces = F.expr("flatten(transform(sequence(1, length(s)), i -> transform(sequence(i, length(s)), j -> substr(s, i, j - i + 1))))")
    once = texts.select("s").distinct().select("s", F.explode(pieces).alias("n_name"))
    found = once.join(_nation(spark, sf_dir).select("n_name").distinct(), "n_name").distinct()
    return texts.join(found, "s").select("p_partkey", "n_name").distinct()


@query("JN18")
def jn18(spark, sf_dir):
    return similar.close_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


def _words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("article"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("tokens"))


@query("NLP8", "select t.article, list_sort(list(distinct t.token)) as genes, min(0) as step from (select conv_id * 1000 + turn as article, unnest(regexp_split_to_array(text, '\\s+')) as token from conversations) t where t.token in (select n_name from nation union all select 'the' union all select 'und') group by t.article")
def nlp8(spark, sf_dir):
    names = _nation(spark, sf_dir).select(F.col("n_name").alias("gene")).union(spark.range(1).select(F.explode(F.array(F.lit("the"), F.lit("und"))).alias("gene")))
    tokens = _words(spark, sf_dir).select("article", F.posexplode("tokens").alias("pos", "token"))
    return genes.find(tokens, names)


@query("AGG16")
def agg16_reach(spark, sf_dir):
    return together.reach(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey").withColumnRenamed("left", "k")


@query("AGG16B")
def agg16(spark, sf_dir):
    return genes.two_hop_dictionary(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("entry")))


@query("NLP9")
def nlp9(spark, sf_dir):
    s = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("deletion of "), "n_name", F.lit(" and x was overexpressed")).alias("s"), F.array("n_name", F.lit("x")).alias("g"))
    return s.select("n_nationkey", relations.actions_near("s", "g").alias("actions"))


_PHRASES = ["was overexpressed", "deletion", "introduction", "increasing the expression", "not expressed", "removal of the gene", "was disrupted", "blocks", "regulating expression", "not deleted", "mutation", "downregulated", "no induction", "lacks expression", "engineered", "attenuated", "inhibiting expression", "12", ""]


def _phrase(key: str, n: int = 0):
    return F.get(F.array(*[F.lit(x) for x in _PHRASES]), ((F.col(key) + n) % len(_PHRASES)).cast("int"))


def _duck_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _duck_phrase(key: str, n: int = 0) -> str:
    return f"{_duck_list(_PHRASES)}[(({key} + {n}) % {len(_PHRASES)}) + 1]"


def _duck_stem(x: str) -> str:
    cut = "regexp_extract(w, '^(.*?)[io]?[aeiou][^aeiou]*$', 1)"
    bare = f"regexp_replace(lower({x}), '\\b({'|'.join(text.FILLERS)})\\b', '', 'g')"
    words = f"string_split(trim(regexp_replace(regexp_replace(regexp_replace({bare}, '\\s+', ' ', 'g'), '[^a-z -]+', '', 'g'), ' +', ' ', 'g')), ' ')"
    whole = _duck_list([*text.WHOLE, *(v + "s" for v in text.WHOLE)])
    return f"array_to_string(list_transform({words}, lambda w: case when list_contains({whole}, w) or not regexp_matches(w, '[aeiou]') then w when {cut} = '' then substr(w, 1, 1) else {cut} end), ' ')"


def _duck_direction(x: str) -> str:
    up, down = ("|".join(v) for v in (relations.UP, relations.DOWN))
    turned = " ".join(f"when contains({x}, '{n}') and regexp_matches(replace({x}, '{n}', ''), '{up}') then 'Negative' when contains({x}, '{n}') and regexp_matches(replace({x}, '{n}', ''), '{down}') then 'Positive'" for n in relations.NEGATORS)
    return f"case {turned} when list_contains({_duck_list(relations.UNCLEAR)}, string_split({x}, ' ')[1]) or contains({x}, 'not ') then 'Other' when regexp_matches({x}, '{down}') then 'Negative' when regexp_matches({x}, '{up}') then 'Positive' else 'Other' end"


@query("STR43", f"select p_partkey, {_duck_stem(_duck_phrase('p_partkey'))} as stem, {_duck_stem('p_name')} as name_stem from part")
def str43(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.modification_stem(_phrase("p_partkey")).alias("stem"), text.modification_stem(F.col("p_name")).alias("name_stem"))


@query("MTH5", f"select p_partkey, stem, {_duck_direction('stem')} as direction from (select p_partkey, {_duck_stem(_duck_phrase('p_partkey'))} as stem from part) x")
def mth5(spark, sf_dir):
    stems = table(spark, sf_dir, "part").select("p_partkey", text.modification_stem(_phrase("p_partkey")).alias("stem"))
    return stems.withColumn("direction", relations.direction(F.col("stem")))


@query("RST28", f"select l_orderkey, l_linenumber, case when list_contains({_duck_list(relations.CURATED)}, stem) then {_duck_direction('stem')} else 'Other' end as class from (select l_orderkey, l_linenumber, {_duck_stem(_duck_phrase('l_partkey'))} as stem from lineitem) x")
def rst28(spark, sf_dir):
    stems = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.modification_stem(_phrase("l_partkey")).alias("stem"))
    return stems.select("l_orderkey", "l_linenumber", F.when(F.col("stem").isin(*relations.CURATED), relations.direction(F.col("stem"))).otherwise("Other").alias("class"))


_EC = "concat('1.', cast({k} % 3 as {t}), '.', cast({k} % 4 as {t}), case when {k} % 5 = 0 then '.-' when {k} % 7 = 0 then '' else '.2' end)"


@query(
    "Q6",
    f"""select paper, gene, ecs, mods, list_transform(mods, lambda m: {_duck_direction('m')}) as classes from (
    select l_orderkey as paper, l_linenumber as gene, list_filter([{_EC.format(k='l_partkey', t='varchar')}, {_EC.format(k='l_suppkey', t='varchar')}], lambda e: regexp_matches(e, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')) as ecs,
    list_filter([{_duck_stem(_duck_phrase('l_partkey'))}, {_duck_stem(_duck_phrase('l_partkey', 5))}], lambda m: list_contains({_duck_list(relations.CURATED)}, m)) as mods from lineitem) x where len(ecs) > 0 and len(mods) > 0""",
)
def q6(spark, sf_dir):
    ec = lambda k: F.expr(_EC.format(k=k, t="string"))
    genes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("gene"), F.array(ec("l_partkey"), ec("l_suppkey")).alias("ecs"), F.array(_phrase("l_partkey"), _phrase("l_partkey", 5)).alias("actions")
    )
    return relations.relevant(genes).select("paper", "gene", "ecs", F.col("mods.mod").alias("mods"), F.col("mods.class").alias("classes"))


@query("Q4")
def q4(spark, sf_dir):
    syn = table(spark, sf_dir, "part").select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("synonym"), F.col("p_brand").alias("canonical"), F.col("p_partkey").alias("ord"))
    return products.resolve(table(spark, sf_dir, "part").select("p_partkey", cleaning.family_name(cleaning.greek_names(cleaning.canonical_name(cleaning.canonical_name(F.concat("p_name", F.lit("s")))))).alias("name")), syn)


# ---- models --------------------------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").cast("double").alias("label"))


@query("ML8")
def ml8(spark, sf_dir):
    from pyspark.ml import Pipeline

    d = classify.dealt(_labelled(spark, sf_dir), "doc_id")
    fitted = Pipeline(stages=[*classify.features("text", "text"), classify.logistic("text_x")]).fit(d)
    weights = sorted(zip(fitted.stages[1].vocabulary, fitted.stages[-1].coefficients.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([*weights[:20], *weights[-20:]], "word string, weight double")


@query("NLP1", "select query_id, vec_id, place from (select q.vec_id as query_id, v.vec_id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 9) desc, v.vec_id) as place from embeddings v join embeddings q on v.vec_id <> q.vec_id where q.vec_id % 50 = 0) x where place <= 5")
def nlp1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return classify.nearest(e, e.where("vec_id % 50 = 0")).select("query_id", "vec_id", "place")
