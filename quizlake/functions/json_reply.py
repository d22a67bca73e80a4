"""Reply-body columns (D3-D5): extract the text block, remove a code fence,
parse strictly to a question struct. All built-in expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import REPLY_QUESTION_SCHEMA
from .text import col_, non_blank, py_strip

QUESTION_FIELDS = REPLY_QUESTION_SCHEMA
# blocks as maps, so a block without a "text" key can be told from one whose
# text is null (the first raises in the original, the second is skipped)
BLOCKS_SCHEMA = T.StructType([T.StructField("content", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])

FENCE = "```"


def _reply_parts(raw_body):
    content = F.from_json(col_(raw_body), BLOCKS_SCHEMA)["content"]
    # the first text block that either returns (non-blank text) or raises (no text key)
    hit = F.get(F.filter(content, lambda b: (b["type"] == "text")
                         & (~F.map_contains_key(b, "text") | non_blank(b["text"]))), 0)
    first_any = F.get(content, 0)["text"]
    return content, hit, first_any


def reply_text(raw_body) -> Column:
    """D3 — first ``type='text'`` block with a non-blank text, else the first
    block's text when non-blank, else NULL (the caller retries)."""
    content, hit, first_any = _reply_parts(raw_body)
    return F.when(hit.isNotNull(), F.when(F.map_contains_key(hit, "text"), hit["text"])).otherwise(
        F.when(non_blank(first_any), first_any))


def reply_raises(raw_body) -> Column:
    """True when reading the body raises in the original (not a JSON object,
    no ``content``, a text block without ``text`` before any usable one, or an
    empty ``content`` with no text to fall back on): a retried attempt."""
    content, hit, _ = _reply_parts(raw_body)
    return F.coalesce(
        content.isNull()
        | (hit.isNotNull() & ~F.map_contains_key(hit, "text"))
        | (hit.isNull() & (F.size(content) == 0)),
        F.lit(True))


def unfence(text) -> Column:
    """D4 — strip; when it starts with a fence drop through the first newline,
    then a trailing fence, and strip again. Without an opening fence the text
    is only stripped (a lone closing fence is kept)."""
    s = py_strip(text)
    dropped = F.regexp_replace(s, "^```[^\\n]*\\n", "")
    cut = F.when(F.endswith(dropped, F.lit(FENCE)),
                 F.substring(dropped, F.lit(1), F.length(dropped) - F.lit(3))).otherwise(dropped)
    return F.when(F.startswith(s, F.lit(FENCE)), py_strip(cut)).otherwise(s)


def _wrapped(text) -> Column:
    # from_json on the bare text would read the first value and ignore the
    # rest; inside an array a second value or trailing junk becomes visible
    return F.concat(F.lit("["), col_(text), F.lit("]"))


# strict reader options, matching what json.loads accepts
_STRICT = {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false",
           "allowUnquotedFieldNames": "false", "allowComments": "false",
           "allowUnquotedControlChars": "false", "allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}
_END = "#end-of-reply#"


def is_single_json_value(text) -> Column:
    """``json.loads(text)`` succeeds (strict, whole string).

    Elements are read as raw text, so any value type is accepted; like Python,
    NaN/Infinity and duplicate keys are allowed, single quotes, comments,
    leading zeros and raw control characters are not. The JSON reader stops
    after the first complete root value, so one wrapping is not enough: a text
    ``V]junk`` would close ``[V]junk]`` early. ``[t]`` must hold exactly one
    value AND ``[t,"<end>"]`` exactly that value followed by the end marker;
    both hold only when nothing follows the value inside the text.
    """
    arr = T.ArrayType(T.StringType())
    one = F.from_json(_wrapped(text), arr, _STRICT)
    two = F.from_json(F.concat(F.lit("["), col_(text), F.lit(f',"{_END}"]')), arr, _STRICT)
    return F.coalesce((F.size(one) == 1) & (F.size(two) == 2) & (F.get(two, 1) == F.lit(_END)), F.lit(False))


def parse_question(text) -> Column:
    """D5 — the reply's fields (``question, options, answer, explanation``)."""
    arr = F.from_json(_wrapped(text), T.ArrayType(QUESTION_FIELDS), _STRICT)
    return F.get(arr, 0)


def parsed_ok(text, parsed=None) -> Column:
    """Strict parse to a JSON object (a valid value that starts with '{')."""
    return is_single_json_value(text) & F.startswith(col_(text), F.lit("{"))


def non_object_json(text) -> Column:
    """Valid JSON that is not an object (array, scalar, null): the original
    fails on tagging with a TypeError, which is not retried."""
    return is_single_json_value(text) & ~F.startswith(col_(text), F.lit("{"))
