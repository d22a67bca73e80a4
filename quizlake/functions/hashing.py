"""Seeded, repeatable randomness (H6): md5 of a '|'-joined key.

md5 hex agrees byte for byte between Spark and DuckDB, so draws and
shuffles built on it can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def seeded_key(seed: str, *cols) -> Column:
    """Hex md5 of ``seed|c1|c2|...`` — a sort key for seeded shuffles."""
    parts = [F.lit(seed)] + [col_(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def seeded_int(seed: str, *cols) -> Column:
    """A non-negative 60-bit integer from the first 15 hex digits of ``seeded_key``."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 15), 16, 10).cast("bigint")


def seeded_int_sql(seed: str, *cols: str) -> str:
    """The same integer in DuckDB SQL."""
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST(('0x' || substr(md5({parts}), 1, 15)) AS BIGINT)"


def seeded_key_sql(seed: str, *cols: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5({parts})"


def question_key(topic, question) -> Column:
    """H8 — a stable key for a question stored only as text:
    sha2(topic <US> question, 256), so equal texts in different topics differ."""
    return F.sha2(F.concat_ws(chr(31), col_(topic), col_(question)), 256)
