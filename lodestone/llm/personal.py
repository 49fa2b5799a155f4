"""Personal data and what discloses it, in DataFrame operations alone.

Spans of four kinds (e-mail and internet addresses, card and telephone numbers) are found by patterns. Their values are
the protected entities. Information-theoretic sanitisation then asks the corpus which other terms reveal them: over all
documents, a term t that stands near an entity c discloses it by the pointwise mutual information

    PMI(c; t) = log2(N * n(c, t) / (n(c) * n(t)))

as a share of the entity's information log2(N / n(c)). Terms whose share is the threshold or more say as much as the
entity itself; they are generalised to the class of their shape, or removed where they have none, in the documents in
which they stand near that entity. Counts are of documents, over the whole corpus and by grouped sums with a map-side
part, so that an entity or a term of every document is no task's burden.

Positions come from the lengths of matches and of what lies between them, as Spark has no function that gives the
places of all matches. The patterns hold no choice that could be taken back, and start only where a run of their
characters starts or the last match ended, which finds the same matches as the plain patterns in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": "[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TERM, _BETWEEN = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.transform(F.split(value, r"\."), part), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = F.translate(value, " -", "")
        each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d > "4", 9).otherwise(0)))
        luhn = F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0
        return F.when(F.length(digits).between(14, 19), luhn).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _name(kind: str, value: Column) -> Column:
    """What tells an entity from others: addresses in lower case, numbers by their digits."""
    if kind in ("card", "phone"):
        return F.regexp_replace(value, "[^0-9]", "")
    return F.lower(value)


_PLACE = "struct<start:int,kind:int,end:int>"


def _places(kind: str, found: Column, pieces: Column) -> Column:
    """Array of (start, kind, end, value, before, behind) of matches, given also the pieces of text between them."""
    none = "array<struct<start:int,kind:int,end:int,value:string,before:string,behind:string>>"
    both = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda v, gap: F.struct(v.alias("v"), gap.alias("gap")))
    # what stands behind a match is the next piece
    both = F.zip_with(both, F.slice(pieces, F.lit(2), F.size(found)), lambda x, after: F.struct(x["v"].alias("v"), x["gap"].alias("gap"), after.alias("after")))

    def step(s, x):
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["v"].alias("value"), x["gap"].alias("before"), x["after"].alias("behind")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(none).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(both, start, step, lambda s: s["out"])).otherwise(F.array().cast(none))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: F.length(w) > 1)


def _context(before: Column, behind: Column, reach: int) -> Column:
    """The terms within reach characters of a match, those cut by that bound left out."""
    edge = lambda piece, cut, pattern: F.when(F.length(piece) > reach, F.regexp_replace(cut, pattern, "")).otherwise(piece)
    return F.array_distinct(F.concat(_words(edge(before, F.right(before, F.lit(reach)), f"^{_TERM}+")), _words(edge(behind, F.left(behind, F.lit(reach)), f"{_TERM}+$"))))


def _base(docs: DataFrame, reach: int, with_text: bool) -> DataFrame:
    """A table of (rid, doc_id, base, hits, text): a row for each of docs.

    hits has (c, terms) of each match; text is there for rows with matches, or for all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("text").isNull().alias("missing"))
    found = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in PATTERNS.items()])
    # each pattern is run a second time on texts with a match alone
    cut = found.select("doc_id", "text", "missing", *[f"m_{k}" for k in PATTERNS], *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"p_{k}") for k, p in PATTERNS.items()])
    keep = lambda k: lambda x: _valid(k, x["value"])
    placed = cut.select("doc_id", "text", "missing", *[F.filter(_places(k, F.col(f"m_{k}"), F.col(f"p_{k}")), keep(k)).alias(k) for k in PATTERNS])
    spans = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))) for k in PATTERNS]
    hit = lambda k: lambda x: F.struct(F.xxhash64(F.lit(k), _name(k, x["value"])).alias("c"), _context(x["before"], x["behind"], reach).alias("terms"))
    hits = [F.transform(k, hit(k)) for k in PATTERNS]
    some = F.greatest(*[F.size(k) for k in PATTERNS]) > 0
    text = F.when(~F.col("missing"), F.col("text")) if with_text else F.when(some, F.col("text"))
    return C.materialise(placed.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sort_array(F.concat(*spans)).alias("base"), F.concat(*hits).alias("hits"), text.alias("text")), "personal")


def disclosing_terms(docs: DataFrame, base: DataFrame, threshold: float, support: int) -> tuple[DataFrame, DataFrame]:
    """(c, t, share) of the terms that disclose an entity, and (rid, c, t) of the documents in which they stand near it.

    Both entity and term must stand together in support documents or more.
    """
    n = base.count()
    near = C.materialise(base.select("rid", F.explode("hits").alias("h")).select("rid", "h.c", F.explode("h.terms").alias("t")).distinct(), "near")
    entities = base.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["c"]))).alias("c")).groupBy("c").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support)
    # terms count in all documents, by a hash of fixed width
    term = lambda w: F.xxhash64(w)
    every = docs.select(F.explode(F.array_distinct(F.transform(_words(F.coalesce(F.col("text").cast("string"), F.lit(""))), term))).alias("th")).groupBy("th").agg(F.count("*").alias("n_t"))
    joint = near.groupBy("c", "t").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= support).join(entities, "c").withColumn("th", term(F.col("t"))).join(every, "th")
    # a term cut by a match at its side may count less in whole texts than beside the entity
    pmi = F.log2(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.greatest("n_t", "n_ct")))
    told = F.log2(F.lit(float(n)) / F.col("n_c"))
    risky = joint.where(told > 0).select("c", "t", (pmi / told).alias("share")).where(F.col("share") >= threshold)
    return risky, near


def personal_spans(docs: DataFrame, threshold: float = 0.9, support: int = 3, reach: int = 100, with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, base and spans (arrays of start, kind, end in code points, end exclusive, by start and kind), text.

    Kinds are numbers of KINDS. spans holds all of base, and the terms that disclose an entity of the document, wherever
    in the document they stand outside of base. text is null where there are no spans, unless with_text is set. A null
    text is empty. Rows without an id and rows that repeat one are documents of their own. Other columns play no part.
    An empty table gives an empty result. A corpus in which an entity stands in every document tells nothing of it.
    """
    base = _base(docs, reach, with_text)
    risky, near = disclosing_terms(docs, base, threshold, support)
    own = near.join(risky, ["c", "t"]).groupBy("rid").agg(F.sort_array(F.collect_set("t")).alias("terms"))
    pattern = F.concat(F.lit(f"(?iu)(?<!{_TERM})(?:"), F.array_join("terms", "|"), F.lit(f")(?!{_TERM})"))
    held = base.where(F.size("base") > 0).select("rid", "base", "text").join(own, "rid").withColumn("p", pattern)
    found = held.select("rid", "base", F.regexp_extract_all("text", F.col("p"), F.lit(0)).alias("m"), F.split("text", F.col("p"), -1).alias("pieces"))
    terms = found.select("rid", F.explode(_places("term", F.col("m"), F.col("pieces"))).alias("x"), "base")
    apart = F.forall("base", lambda b: (b["end"] <= F.col("x.start")) | (b["start"] >= F.col("x.end")))
    terms = terms.where(apart).groupBy(F.col("rid").alias("r")).agg(F.collect_list(F.struct("x.start", "x.kind", "x.end")).alias("more"))
    joined = base.join(terms, base["rid"] == terms["r"], "left")
    return joined.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(f"array<{_PLACE}>")))).alias("spans"), "text")


def _said(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def personal_report(docs: DataFrame, **kw) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans ("kind:start:end", comma-joined)."""
    out = personal_spans(docs, **kw)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return out.select("doc_id", *[count(i) for i in range(len(KINDS))], F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"))


def sanitise(docs: DataFrame, **kw) -> DataFrame:
    """doc_id and text without personal data: spans give way to their kind in brackets.

    A disclosing term becomes the class of its shape ([NUMBER], or [NAME] with a capital in front); any other is
    removed. Of spans that overlap, the first takes up the others. A null text stays null.
    """
    out = personal_spans(docs, with_text=True, **kw)
    # substring() counts from 1; a span within the one before adds nothing
    piece = lambda s, x: F.substring("text", s["at"] + 1, x["start"] - s["at"])
    value = lambda x: F.substring("text", x["start"] + 1, x["end"] - x["start"])
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:-1]])

    def mark(x):
        shape = F.when(value(x).rlike(r"^\p{N}"), "[NUMBER]").when(value(x).rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        return F.when(x["kind"] == len(KINDS) - 1, shape).otherwise(F.get(name, x["kind"]))

    def step(s, x):
        fresh = F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(piece(s, x), mark(x))).alias("out"))
        within = F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))
        return F.when(x["start"] >= s["at"], fresh).otherwise(within)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring("text", s["at"] + 1, F.length("text"))))
    return out.select("doc_id", F.when(F.col("text").isNotNull(), clean).alias("text"))
