"""The explorer: a search view, a request that becomes predicates, ranking, pages, insights."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

PAGE = 20


@dataclass
class Request:
    """Empty values mean no filter; reversed years are swapped; aliases expand in query and organism."""

    query: str = ""
    organism: str = ""
    product: str = ""
    gene: str = ""
    direction: str = ""
    first: int | None = None
    last: int | None = None
    sort: str = "relevance"
    page: int = 1
    aliases: list[tuple[str, str]] = field(default_factory=list)

    def terms(self) -> list[str]:
        return self._wide(self.query).split()

    def _wide(self, text: str) -> str:
        return reduce(lambda t, a: t.replace(a[0], a[1]), self.aliases, (text or "").strip().lower())


def search_view(records: DataFrame) -> DataFrame:
    """records (pmid, title, year, organisms, products, genes<name, directions>) with what searching looks at."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    names = F.transform("genes", lambda g: g["name"])
    return records.select(
        "*",
        F.lower("title").alias("_title"),
        low(F.col("organisms")).alias("_organisms"),
        low(F.col("products")).alias("_products"),
        F.transform("genes", lambda g: F.struct(F.lower(g["name"]).alias("name"), g["directions"].alias("directions"))).alias("_genes"),
        F.lower(F.concat_ws(" ", F.col("pmid").cast("string"), "title", F.array_join("organisms", " "), F.array_join("products", " "), F.array_join(names, " "))).alias("_search"),
    )


def predicate(request: Request) -> Column:
    """Every term in the search text; organism and product equal to an element; gene and direction on one element."""
    tests = [F.contains("_search", F.lit(t)) for t in request.terms()]
    if organism := request._wide(request.organism):
        tests.append(F.array_contains("_organisms", organism))
    if product := (request.product or "").strip().lower():
        tests.append(F.array_contains("_products", product))
    gene = (request.gene or "").strip().lower()
    if gene or request.direction:
        hit = lambda g: (g["name"] == gene if gene else F.lit(True)) & (F.array_contains(g["directions"], request.direction) if request.direction else F.lit(True))
        tests.append(F.exists("_genes", hit))
    years = [y for y in (request.first, request.last) if y]
    if request.first and request.last:
        tests.append(F.col("year").between(min(years), max(years)))
    elif request.first:
        tests.append(F.col("year") >= request.first)
    elif request.last:
        tests.append(F.col("year") <= request.last)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def relevance(request: Request) -> Column:
    """Per term: title equal 20, prefix 10, inside 6; product 14 or 5; organism 5; gene 16 or 7."""
    total = F.lit(0)
    for t in request.terms():
        if len(t) < 2:
            continue
        term = F.lit(t)
        total = (
            total
            + F.when(F.col("_title") == term, 20).when(F.startswith("_title", term), 10).when(F.contains("_title", term), 6).otherwise(0)
            + F.when(F.array_contains("_products", term), 14).when(F.exists("_products", lambda p: F.contains(p, term)), 5).otherwise(0)  # noqa: B023
            + F.when(F.exists("_organisms", lambda o: F.contains(o, term)), 5).otherwise(0)  # noqa: B023
            + F.when(F.exists("_genes", lambda g: g["name"] == term), 16).when(F.exists("_genes", lambda g: F.contains(g["name"], term)), 7).otherwise(0)  # noqa: B023
        )
    return total


def order(request: Request) -> list[Column]:
    title, new = F.col("_title").asc(), F.col("year").desc()
    by = {"year-desc": [new, title], "year-asc": [F.col("year").asc(), title], "title": [title]}
    if request.sort == "relevance" and any(len(t) > 1 for t in request.terms()):
        return [F.col("score").desc(), new, F.col("pmid").asc()]
    return [*by.get(request.sort, by["year-desc"]), F.col("pmid").asc()]


def matches(view: DataFrame, request: Request) -> DataFrame:
    return view.where(predicate(request)).withColumn("score", relevance(request))


def page(view: DataFrame, request: Request) -> DataFrame:
    """The page asked for, or the last there is; a top-k sort, never a sort of all."""
    found = matches(view, request)
    pages = max(1, -(-found.count() // PAGE))
    at = min(max(1, request.page), pages)
    return found.orderBy(*order(request)).limit(at * PAGE).offset((at - 1) * PAGE)


def label_counts(found: DataFrame, column: str) -> DataFrame:
    """Labels by the records that hold them, each once a record; the first spelling is shown."""
    each = found.select("pmid", F.posexplode(column).alias("pos", "label")).withColumn("key", F.lower(F.trim("label")))
    return each.groupBy("key").agg(F.countDistinct("pmid").alias("n"), F.min_by("label", F.struct("pmid", "pos")).alias("label"))


def top_labels(found: DataFrame, column: str, k: int = 5) -> DataFrame:
    top = label_counts(found, column).orderBy(F.desc("n"), "key").limit(k)
    return top.withColumn("width", F.greatest(F.lit(3.0), F.lit(100.0) * F.col("n") / F.max("n").over(W.partitionBy(F.lit(1)))))


def direction_counts(found: DataFrame, known: tuple[str, ...] = ("Positive", "Negative", "Other")) -> DataFrame:
    each = found.select(F.explode("genes").alias("g")).select(F.explode("g.directions").alias("d"))
    return each.agg(*[F.count_if(F.col("d") == d).alias(d.lower()) for d in known])


@dataclass
class Insights:
    """What is shown beside a page: all from one reading of the source."""

    count: int
    directions: dict[str, int]
    page: DataFrame
    organisms: DataFrame
    products: DataFrame


def insights(view: DataFrame, request: Request, known: tuple[str, ...] = ("Positive", "Negative", "Other")) -> Insights:
    """Count, histogram of directions, page and top labels of the records that match.

    The source is read once, when the matches are written to the shared folder: count and histogram are observed as
    they pass, and page and labels then read the matches alone, without the texts that searching looks at.
    """
    found = matches(view, request)
    seen = Observation()
    way = lambda d: F.sum(F.aggregate("genes", F.lit(0).cast("long"), lambda s, g: s + F.size(F.filter(g["directions"], lambda x: x == d)))).alias(d)
    watched = found.observe(seen, F.count(F.lit(1)).alias("n"), *[way(d) for d in known])
    own = scratch.written(watched.select(*[c for c in watched.columns if not c.startswith("_") or c == "_title"]))
    told = seen.get
    at = min(max(1, request.page), max(1, -(-told["n"] // PAGE)))
    page_ = own.orderBy(*order(request)).limit(at * PAGE).offset((at - 1) * PAGE)
    return Insights(told["n"], {d: told[d] or 0 for d in known}, page_, top_labels(own, "organisms"), top_labels(own, "products"))
