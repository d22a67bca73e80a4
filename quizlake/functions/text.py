"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# FIXED VALUES: the characters Python's str.strip() removes by default
# (str.isspace): ASCII tab, newline, vertical tab, form feed, carriage return,
# the four ASCII separators, space, NEL, no-break space, and the Unicode
# space separators and line/paragraph separators.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """N1 — ``str.strip()``: remove leading and trailing whitespace. Spark's
    ``trim`` alone strips spaces only; ``btrim`` with the full set is exact
    and needs no regular expression."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def non_blank(c) -> Column:
    """``text and text.strip()`` as a predicate (NULL counts as blank)."""
    c = col_(c)
    return c.isNotNull() & (py_strip(c) != F.lit(""))


def pad_right(c, width: int) -> Column:
    """N7 — ``f"{x:15s}"``: pad to width, never cut (rpad would cut)."""
    return F.format_string(f"%-{width}s", col_(c))


def preview(c, n: int = C.PREVIEW_CHARS) -> Column:
    """N8 — ``text[:60] + '...'`` (the dots are always added)."""
    return F.concat(F.substring(col_(c), 1, n), F.lit("..."))


def text_bar(pct) -> Column:
    """N9 — ten-cell bar: full cells for each whole 10 %, empty for the rest."""
    full = F.floor(col_(pct) / F.lit(10.0)).cast("int")
    return F.concat(F.repeat(F.lit(C.BAR_FULL), full), F.repeat(F.lit(C.BAR_EMPTY), F.lit(10) - full))


def safe_name(c) -> Column:
    """N13 — spaces to underscores for file names."""
    return F.replace(col_(c), F.lit(" "), F.lit("_"))


def first_letter(c) -> Column:
    """N15 — the letter of a choice such as ``'B. text'``."""
    return F.substring(col_(c), 1, 1)


def option_lines(options) -> Column:
    """N16 — ``[f"{k}. {v}" for k, v in options.items()]`` as an array."""
    return F.transform(F.map_entries(col_(options)),
                       lambda e: F.concat(e["key"], F.lit(". "), e["value"]))


def selected_symbol(selected) -> Column:
    """N18 — the chosen letter, or the clock symbol when time ran out."""
    s = col_(selected)
    return F.when(s.isNull() | (s == ""), F.lit(C.TIMEOUT_SYMBOL)).otherwise(s)


def correct_icon(is_correct) -> Column:
    return F.when(col_(is_correct).cast("boolean"), F.lit(C.ICON_CORRECT)).otherwise(F.lit(C.ICON_WRONG))


def normalise_letter(c) -> Column:
    """N1 + N2 — ``input().strip().upper()``."""
    return F.upper(py_strip(c))


def levels_array() -> Column:
    return F.array(*[F.lit(x) for x in C.DIFFICULTY_LEVELS])


def iso_timestamp(ts) -> Column:
    """N14 — ``datetime.isoformat()``: 'T' separator, microseconds only when non-zero."""
    t = col_(ts)
    frac = F.date_format(t, "SSSSSS")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
