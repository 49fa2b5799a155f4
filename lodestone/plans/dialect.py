"""Queries written once in the subset that Spark SQL and DuckDB share, with both spellings of the rest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_SPARK = {"rx": "regexp_replace", "has": "regexp_like", "ssplit": "split", "tr": "transform", "fl": "filter", "ajoin": "array_join", "asize": "size", "acontains": "array_contains", "unnest": "explode", "ordered": "array_sort", "alist": "collect_list", "at": "try_element_at", "half_even": "bround", "aconcat": "concat", "argmin": "min_by", "argmax": "max_by", "aslice": "slice", "aset": "array_distinct", "aminus": "array_except", "aand": "array_intersect", "aor": "array_union", "rextract": "regexp_extract", "seq": "sequence", "flat": "flatten", "ahas": "exists", "ordinal": "instr", "codepoints": "char_length"}
_DUCK = {"has": "regexp_matches", "ssplit": "string_split", "tr": "list_transform", "fl": "list_filter", "ajoin": "array_to_string", "asize": "len", "acontains": "list_contains", "ordered": "list_sort", "alist": "list", "at": "list_extract", "half_even": "round_even", "aconcat": "list_concat", "argmin": "arg_min", "argmax": "arg_max", "aset": "list_distinct", "aand": "list_intersect", "rextract": "regexp_extract", "seq": "generate_series", "flat": "flatten", "ordinal": "instr", "codepoints": "length"}


def _calls(sql: str, name: str, build) -> str:
    """Rewrite name(args...) by build(list of args), innermost last."""
    at = 0
    while m := re.compile(rf"\b{name}\(").search(sql, at):
        depth, i, args, start, quoted = 1, m.end(), [], m.end(), False
        while depth:
            c = sql[i]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c in "([") - (c in ")]")
                if c == "," and depth == 1:
                    args.append(sql[start:i].strip())
                    start = i + 1
            i += 1
        args.append(sql[start : i - 1].strip())
        new = build(args)
        sql = sql[: m.start()] + new + sql[i:]
        at = m.start() + 1
    return sql


def spark_text(sql: str) -> str:
    sql = _calls(sql, "idiv", lambda a: f"({a[0]} div {a[1]})")
    sql = _calls(sql, "alistby", lambda a: f"transform(sort_array(collect_list(struct({a[1]} as k, {a[0]} as v))), e -> e.v)")
    sql = _calls(sql, "textof", lambda a: f"cast({a[0]} as string)")
    sql = re.sub(r"%IDX(\d)", r"\1", sql)
    for k, v in _SPARK.items():
        sql = re.sub(rf"\b{k}\(", f"{v}(", sql)
    return re.sub(r"'((?:[^']|'')*)'", lambda m: "'" + m[1].replace("\\", "\\\\") + "'", sql)


def duck_text(sql: str) -> str:
    sql = _calls(sql, "idiv", lambda a: f"({a[0]} // {a[1]})")
    sql = _calls(sql, "alistby", lambda a: f"list({a[0]} order by {a[1]})")
    sql = _calls(sql, "textof", lambda a: f"cast({a[0]} as varchar)")
    sql = _calls(sql, "rx", lambda a: f"regexp_replace({', '.join(a)}, 'g')")
    sql = _calls(sql, "aslice", lambda a: f"list_slice({a[0]}, {a[1]}, {a[1]} + {a[2]} - 1)")
    sql = _calls(sql, "aminus", lambda a: f"list_distinct(list_filter({a[0]}, lambda q: not list_contains({a[1]}, q)))")
    sql = _calls(sql, "aor", lambda a: f"list_distinct(list_concat({a[0]}, {a[1]}))")
    sql = _calls(sql, "ahas", lambda a: f"(len(list_filter({a[0]}, {a[1]})) > 0)")
    sql = re.sub(r"%IDX(\d)", lambda m: str(int(m[1]) + 1), sql)
    for k, v in _DUCK.items():
        sql = re.sub(rf"\b{k}\(", f"{v}(", sql)
    sql = re.sub(r"(\w+) -> ", r"lambda \1: ", sql)
    sql = re.sub(r"\(([a-z]), ([a-z])\) -> ", r"lambda \1, \2: ", sql)
    return re.sub(r"\barray\(", "list_value(", sql)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(spark_text(sql))
