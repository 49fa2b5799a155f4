import pytest
from pyspark.sql import functions as F

from lodestone.operators import explorer, publish

HEAD = "PMID;Title;Year;Organism;Product;Genes_and_modifications"
GOOD = ["1;A \"\"title;2001;E. coli, e. COLI ,Yeast;A, b;\"{'x': 'Positive,Odd', '': 'Negative'}\"", '2;"two\nlines; here";1999;,;x;"{""y"": [""Negative""]}"', "3;;2010;;;"]


def write(tmp_path, lines, bom=True):
    path = tmp_path / "in.csv"
    path.write_bytes(("﻿" * bom + "\r\n".join(lines) + "\r\n").encode())
    return f"file://{path}"


@pytest.mark.parametrize(
    "lines,what",
    [
        ([HEAD.replace(";Year", ""), "1;t;o;p;"], "missing required columns: Year"),
        ([HEAD], "no data records"),
        ([HEAD, *GOOD, "4;t;abc;;;", "5;t;abd;;;"], "Invalid year at CSV row 5"),
        ([HEAD, "1;t;2000;;;[1]"], "must be a dictionary at CSV row 2"),
        ([HEAD, GOOD[0], "1;t;2000;;;\"{'a'\""], "Invalid Genes_and_modifications at CSV row 3"),
    ],
)
def test_faults_name_their_row(spark, tmp_path, lines, what):
    out = f"file://{tmp_path}/out"
    with pytest.raises(ValueError, match=what):
        publish.publish(spark, write(tmp_path, lines), out)
    assert publish.versions(spark, out) == []


RECORD = "pmid string, title string, year int, organism string, organisms array<string>, product string, products array<string>, genes array<struct<name: string, directions: array<string>>>"


def test_published_and_read_back(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    with pytest.raises(ValueError, match="nothing is published"):
        publish.current(spark, out, "records", RECORD)
    assert publish.publish(spark, write(tmp_path, [HEAD, *GOOD]), out) == 1
    got = {r.pmid: r for r in publish.current(spark, out, "records", RECORD).collect()}
    assert got["1"].organisms == ["E. coli", "Yeast"] and got["1"].products == ["A, b", "A", "b"] and [(g.name, g.directions) for g in got["1"].genes] == [("x", ["Positive", "Other"])]
    assert got["2"].organisms == [","] and got["2"].products == ["x"] and got["2"].title == "two\nlines; here" and got["2"].year == 1999
    assert (got["3"].organisms, got["3"].products, got["3"].genes) == ([], [], [])
    meta = publish.current(spark, out, "meta", "recordCount long, organismCount long, productCount long, geneCount long, minYear int, maxYear int, organismSuggestions array<string>, sourceFile string").first()
    assert tuple(meta) == (3, 3, 2, 2, 1999, 2010, [",", "E. coli", "Yeast"], "in.csv")


def test_a_failed_task_leaves_what_is_published(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    fine = spark.range(3).select(F.col("id").alias("a"))
    assert publish.commit_together(spark, out, {"x": (fine, "json"), "y": (fine, "json")}) == 1
    late = fine.select(F.when(F.col("a") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("a")).alias("a"))
    with pytest.raises(Exception, match="lost"):
        publish.commit_together(spark, out, {"x": (fine.union(fine), "json"), "y": (late, "json")})
    assert publish.versions(spark, out) == [1]
    assert publish.current(spark, out, "x", "a long").count() == 3
    assert publish.commit_together(spark, out, {"x": (fine.union(fine), "json"), "y": (fine, "json")}) == 3
    assert publish.current(spark, out, "x", "a long").count() == 6


def test_insights_read_the_source_once(spark, tmp_path):
    rows = [(i, f"wax {i % 3}", 2000 + i % 5, ["Yeast" if i % 2 else "yeast ", "E. coli"][: 1 + i % 2], ["wax"], [(f"g{i % 4}", ["Positive", "Negative"][: 1 + i % 2])]) for i in range(50)]
    df = spark.createDataFrame(rows, "pmid long, title string, year int, organisms array<string>, products array<string>, genes array<struct<name:string,directions:array<string>>>")
    df.write.parquet(f"file://{tmp_path}/records")
    read, seen = spark.sparkContext.accumulator(0), []

    @F.udf("long")
    def counted(x):
        read.add(1)
        return x

    source = spark.read.parquet(f"file://{tmp_path}/records").withColumn("pmid", counted.asNondeterministic()("pmid"))
    told = explorer.insights(explorer.search_view(source), explorer.Request(query="wax", page=9))
    pages, top, products = told.page.collect(), told.organisms.collect(), told.products.collect()
    assert read.value == 50  # every row once, whatever was shown
    assert told.count == 50 and told.directions == {"Positive": 50, "Negative": 25, "Other": 0}
    assert len(pages) == 10 and [(r.key, r.n) for r in top] == [("yeast", 50), ("e. coli", 25)] and [(r.label, r.n, r.width) for r in products] == [("wax", 50, 100.0)]
    none = explorer.insights(explorer.search_view(source), explorer.Request(query="zzz"))
    assert (none.count, none.page.count(), none.organisms.count(), none.directions["Positive"]) == (0, 0, 0, 0)
