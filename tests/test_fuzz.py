"""Randomised agreement with Python on text handling (hypothesis, batched:
one Spark job per generated batch of strings)."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quizlake.functions import json_reply as J
from quizlake.functions import text as X

WS = [" ", "\t", "\n", "\r", "\x0b", "\x0c", " ", " ", "　", "\x1c", "\x85"]
PIECES = WS + ["`", "```", "```json", "{", "}", "[", "]", '"', ":", ",", "a", "é", "1", "null", "NaN",
               '{"q": 1}', '"x"', "'", "\\", "\\n"]

texts = st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=20, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _loads_ok(t):
    try:
        json.loads(t)
        return True
    except (ValueError, RecursionError):
        return False


@SETTINGS
@given(batch=texts)
def test_strip_and_unfence_properties(spark, batch):
    """Stripping is Python's; a text without a leading fence is only stripped; a
    fenced text gives its stripped content; nothing is ever added."""
    df = spark.createDataFrame([(t, "```json\n" + t.replace("`", "") + "\n```") for t in batch], "t string, f string")
    got = df.select("t", "f", X.py_strip("t").alias("s"), J.unfence("t").alias("u"), J.unfence("f").alias("uf")).collect()
    for r in got:
        assert r.s == r.t.strip(), repr(r.t)
        if not r.s.startswith("```"):
            assert r.u == r.s, repr(r.t)
        assert r.u in r.t and r.u == r.u.strip(), repr(r.t)
        assert r.uf == r.f[len("```json\n"):-len("\n```")].strip(), repr(r.f)


@SETTINGS
@given(batch=texts)
def test_json_validity_agrees_with_json_loads(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    for r in df.select("t", J.is_single_json_value("t").alias("ok")).collect():
        assert r.ok == _loads_ok(r.t), repr(r.t)
