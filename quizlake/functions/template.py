"""Fill a ``str.format``-style template with columns, as one ``concat``."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pieces(template: str):
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        yield literal, field


def fill(template: str, **cols: Column) -> Column:
    parts = []
    for literal, field in _pieces(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(cols[field].cast("string"))
    return F.concat(*parts)


def fill_sql(template: str, **exprs: str) -> str:
    """The same concatenation as DuckDB SQL (literals quoted, fields as given)."""
    parts = []
    for literal, field in _pieces(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if field is not None:
            parts.append(f"CAST({exprs[field]} AS VARCHAR)")
    return "(" + " || ".join(parts) + ")"
