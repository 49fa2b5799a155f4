"""Organism names: the species table, name words of texts, synonyms, full names for abbreviated ones, and enzymes by organism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word families that never name an organism, names that stay abbreviated, and words most papers hold.
FAMILIES = [
    r"([Bb]io)?[Ee]ngineer\w*", r"[Oo]verexpress\w*", r"[Ee]nhanc\w*", r"[Uu]tiliz\w*", r"[Mm]etabol\w*", r"[Ee]ffect\w*",
    r"[Ii]ncreas\w*", r"[Ii]mprov\w*", r"([Bb]io)?[Ss]ynth\w*", r"([Bb]io)?[Pp]roduc\w*", r"[Ss]train\w*", r"[Pp]athway\w*",
    "NADH", "NAD", "[Ee]xpression", "[Aa]nalysis", "[Cc]ell", "[Gg]enome", "[Gg]ene", "[Vv]ia", "[Uu]sing",
]
STAY_SHORT = ["C roseus", "M separata", "O furnacalis", "P sibirica", "E superba"]
COMMON_TITLE = "production engineered engineering pathway gene expression using produced biosynthesis cell yield synthesis strains carbon produce fermentation via product".split()
COMMON_ABSTRACT = "growth strain increase study enzyme activity titer protein system result ethanol strategy compared pathways showed could flux improve analysis metabolism however here synthase conversion acid".split()
COMMON_TEXT = "glucose figure table containing plasmid concentration performed rate culture dna level shown promoter control reaction pcr condition obtain may substrate data respectively sequence metabolic xylose use dehydrogenase biomass including encoding approach".split()
POPULAR = [
    "Escherichia coli", "Saccharomyces cerevisiae", "Corynebacterium glutamicum", "Bacillus subtilis", "Yarrowia lipolytica",
    "Pseudomonas putida", "Komagataella pastoris", "Cupriavidus necator", "Synechococcus elongatus", "Lactococcus lactis",
]
YEAST, YEAST_NAME = "yeast", "Saccharomyces cerevisiae"


def _stripped(text: Column, marks: str) -> Column:
    """text without the marks, one after the other, at both ends."""
    for m in marks:
        text = F.regexp_replace(text, rf"^\{m}+|\{m}+$", "")
    return text


def species_table(names: DataFrame) -> DataFrame:
    """(tax_id, full_name, genus, species) of (tax_id, species), one row a name, the one of the smallest id.

    Mixed cultures, names whose genus is in lower case and null names go; what stands before the last `Candidatus ` is
    cut off. species is the genus' initial and the rest of the name; null where there is no rest.
    """
    kept = names.where("not contains(lower(species), 'mixed culture')").select("tax_id", F.element_at(F.split("species", "Candidatus "), -1).alias("name"))
    genus = _stripped(F.get(F.split("name", " "), F.lit(0)), "'[]")
    kept = kept.withColumn("genus", genus).where("not (lower(genus) = genus and upper(genus) <> genus) and not (genus = 'Candidatus' and contains(name, ' of '))")
    rest = F.when(F.contains("name", F.lit(" ")), F.expr("substr(name, instr(name, ' ') + 1)"))
    one = kept.groupBy("name").agg(F.min("tax_id").alias("tax_id"), F.first("genus").alias("genus"))
    return one.select("tax_id", _stripped(F.col("name"), "'()[]").alias("full_name"), "genus", F.concat(F.left("genus", F.lit(1)), F.lit(". "), rest).alias("species"))


def name_words(texts: DataFrame, genera: DataFrame, text: str = "text", key: str = "article") -> DataFrame:
    """(key, words) of the words of a text that may name an organism, in order.

    Markup, special characters and the word families go. A word of three characters or more counts where it stands first;
    numbers, initials of genera, `sp` and genera count each time; other short words don't. genera has a column genus;
    it is met by an equi-join. Rows with null texts or without words have an empty array; key tells rows apart.
    """
    plain = F.regexp_replace(F.col(text), "<.*?>", "")
    plain = F.replace(F.regexp_replace(plain, "[^a-zA-Z0-9 ]+", " "), F.lit("sp strain "), F.lit("sp strain"))
    for family in FAMILIES:
        plain = F.regexp_replace(plain, rf"\b{family}\b", "")
    rows = texts.select(F.col(key).alias("__key"), F.posexplode(F.filter(F.split(plain, r"\s+"), lambda w: w != "")).alias("pos", "word"))
    known = genera.where("genus <> ''").select(F.col("genus").alias("word"), F.lit(True).alias("known"))
    known = known.unionByName(genera.where("genus <> ''").select(F.left("genus", F.lit(1)).alias("word"), F.lit(True).alias("known"))).distinct()
    # places of a word in a text are gathered first, so that a word is met once a text
    places = rows.groupBy("__key", "word").agg(F.collect_list("pos").alias("at")).join(known, "word", "left")
    always = F.col("known") | F.col("word").rlike("^[0-9]{1,2}$") | (F.col("word") == "sp")
    at = F.when(always, F.col("at")).when(F.length("word") > 2, F.array(F.array_min("at")))
    found = places.select("__key", F.explode(at).alias("pos"), "word").groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    words = F.coalesce(F.transform("w", lambda s: s["word"]), F.expr("cast(array() as array<string>)"))
    return texts.select(key).join(found, F.col(key) == F.col("__key"), "left").select(key, words.alias("words"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W+"), 0)


def replace_names(texts: DataFrame, synonyms: DataFrame, text: str = "text", key: str = "article") -> DataFrame:
    """texts with each name of synonyms (old, new) written as its new one, whatever the case; the longest of those at a place counts.

    Names stand at word ends and don't overlap, from left to right. They are met by an equi-join on their first one or two
    words, so the table may be large; of names that differ in case alone the smallest new one counts. Names that are null
    or don't begin and end with a word character match nothing. key tells rows apart and isn't null; null texts stay null.
    """
    head = lambda t, i: F.array(F.get(t, i), F.concat(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))
    names = synonyms.where(r"old rlike '(?U)^\\w' and old rlike '(?U)\\w$' and new is not null").select(F.lower("old").alias("old"), "new").groupBy("old").agg(F.min("new").alias("new"))
    names = names.withColumn("t", _tokens(F.col("old"))).withColumn("n", F.size("t"))
    names = names.select("old", "new", "n", F.when(F.col("n") == 1, F.get("t", F.lit(0))).otherwise(F.concat(F.get("t", F.lit(0)), F.get("t", F.lit(1)), F.get("t", F.lit(2)))).alias("head"))
    heads = lambda t: F.filter(F.transform(t, lambda w, i: F.struct(i.alias("pos"), w.rlike(r"(?U)^\w").alias("word"), head(t, i).alias("heads"))), lambda s: s["word"])
    # an array of one element binds the tokens, which would be made again for each of them otherwise
    starts = texts.select(F.col(key).alias("__key"), F.explode(F.get(F.transform(F.array(_tokens(F.lower(text))), heads), F.lit(0))).alias("s"))
    starts = starts.select("__key", F.col("s.pos").alias("pos"), F.explode("s.heads").alias("head"))
    hits = starts.join(names, "head").groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("pos", (-F.col("n")).alias("less"), "n", "old", "new"))).alias("__hits"))
    end = lambda h: h["pos"] + h["n"]
    part = lambda t, a, b: F.array_join(F.slice(t, a + 1, F.greatest(b - a, F.lit(0))), "")

    def written(t: Column) -> Column:
        true = F.filter("__hits", lambda h: F.lower(part(t, h["pos"], end(h))) == h["old"])
        step = lambda kept, h: F.when((F.size(kept) == 0) | (h["pos"] >= end(F.element_at(kept, -1))), F.array_append(kept, h)).otherwise(kept)
        chosen = F.aggregate(true, F.expr("cast(array() as array<struct<pos: int, less: int, n: int, old: string, new: string>>)"), step)
        before = lambda all_, i: F.when(i == 0, F.lit(0)).otherwise(end(F.get(all_, i - 1)))
        pieces = lambda all_: F.concat(F.array_join(F.transform(all_, lambda h, i: F.concat(part(t, before(all_, i), h["pos"]), h["new"])), ""), part(t, before(all_, F.size(all_)), F.size(t)))
        return F.get(F.transform(F.array(chosen), pieces), F.lit(0))

    new = F.get(F.transform(F.array(_tokens(F.col(text))), written), F.lit(0))
    out = texts.join(hits, F.col(key) == F.col("__key"), "left")
    return out.withColumn(text, F.when(F.col("__hits").isNull(), F.col(text)).otherwise(new)).drop("__key", "__hits")


def full_names(lists: DataFrame, known: DataFrame, names: str = "organisms", key: str = "article") -> DataFrame:
    """lists with each abbreviated name written in full, as known (name) has it; null where no name is left.

    Of several full names of one abbreviation the last in order counts. Abbreviations that aren't known go, but for
    STAY_SHORT. Known names of one word or with a genus of one letter tell nothing. key tells rows apart.
    """
    w = F.split("name", " ")
    genus, species = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    table = known.select("name").where((F.size(w) > 1) & (F.length(genus) > 1)).select(F.concat_ws(" ", F.left(genus, F.lit(1)), species).alias("name"), F.concat_ws(" ", genus, species).alias("full"))
    table = table.groupBy("name").agg(F.max("full").alias("full"))
    rows = lists.select(F.col(key).alias("__key"), F.posexplode(names).alias("pos", "name")).join(table, "name", "left")
    short = (F.length(F.substring_index("name", " ", 1)) == 1) & ~F.col("name").isin(STAY_SHORT)
    rows = rows.withColumn("name", F.when(short, F.col("full")).otherwise(F.col("name"))).where("name is not null")
    found = rows.groupBy("__key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("__names"))
    return lists.join(found, F.col(key) == F.col("__key"), "left").withColumn(names, F.col("__names")).drop("__key", "__names")


def with_default_yeast(organisms: Column, full: Column) -> Column:
    """Full names, or the default one for rows that have an organism and no full name."""
    return F.when(full.isNull() & organisms.isNotNull(), F.array(F.lit(YEAST_NAME))).otherwise(full)


def enzymes(wanted: DataFrame, known: DataFrame, popular: DataFrame, ranks: list[str], across: bool = True) -> DataFrame:
    """(organism, gene, ecs, step) for each distinct pair of wanted (organism, gene).

    known (organism, gene, ec) is asked first; a pair that stands there is answered, be it by no enzyme. Else, for an
    organism of ranks, the tables of popular (organism, gene, ec) in the order of ranks, of which the first with an enzyme
    answers for all; then, with across, all of ranks in known together. Null, empty and `0` are no enzymes. Each pair is
    asked once, however often it is wanted; a null organism or gene has no answer.
    """
    void = F.trim("ec").isin("", "0")
    ecs = F.array_sort(F.collect_set(F.when(~void, F.trim("ec"))))
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("organism"))
    own = known.groupBy("organism", "gene").agg(ecs.alias("own"))
    listed = popular.where(F.col("organism").isin(ranks) & ~void).groupBy("gene", "organism").agg(ecs.alias("e")).groupBy("gene").agg(F.min_by("e", rank).alias("listed"))
    shared = known.where(F.col("organism").isin(ranks) & ~void).groupBy("gene").agg(ecs.alias("shared"))
    out = wanted.select("organism", "gene").distinct().join(own, ["organism", "gene"], "left").join(listed, "gene", "left").join(shared, "gene", "left")
    by_list = F.col("organism").isin(ranks) & F.col("listed").isNotNull()
    step = F.when(F.col("own").isNotNull(), "exact").when(by_list, "popular").when(F.col("shared").isNotNull() & F.lit(across), "across").otherwise("none")
    answer = F.when(step == "exact", F.col("own")).when(step == "popular", F.col("listed")).when(step == "across", F.col("shared"))
    return out.select("organism", "gene", F.coalesce(answer, F.expr("cast(array() as array<string>)")).alias("ecs"), step.alias("step"))
