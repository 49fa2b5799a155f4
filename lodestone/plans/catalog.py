"""All queries of the library by the id of their operator, and DuckDB's SQL for those that SQL can say."""

from __future__ import annotations

from functools import partial

from . import cleaning, dialect, extra, fulltext, inventory, mechanisms


def _sql(spark, sf_dir, sql):
    return dialect.run_sql(spark, sf_dir, sql)


QUERIES = {k: partial(_sql, sql=v) for k, v in inventory.SQL.items()} | extra.QUERIES | mechanisms.QUERIES | fulltext.QUERIES
ORACLE = {k: dialect.duck_text(v) for k, v in inventory.SQL.items()} | extra.ORACLE | mechanisms.ORACLE | fulltext.ORACLE
