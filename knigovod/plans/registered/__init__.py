"""Registered queries: name -> (query, checking SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns in types that every engine compares alike: decimals as doubles, integers as
    bigint."""
    chosen = df.select(*columns) if columns else df
    casts = {}
    for field in chosen.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            casts[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            casts[field.name] = F.col(field.name).cast("bigint")
    return chosen.withColumns(casts) if casts else chosen


def with_sql(*parts: str) -> str:
    """Common table expressions followed by the query."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def money_text(c: str) -> str:
    """Cents as two-decimal text."""
    return f"CAST(CAST(({c}) / 100.0 AS DECIMAL(18,2)) AS VARCHAR)"


def all_queries() -> dict:
    from knigovod.plans.registered import accounts, checks, documents, exports, journals, registry, reports, scalars, tables, templates, workflow

    merged = {}
    for module in (checks, journals, exports, reports, scalars, registry, accounts, documents, templates, workflow, tables):
        merged.update(module.QUERIES)
    return merged
