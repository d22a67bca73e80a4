"""URL filters by a sort-merge range join (operator 7).

A host becomes the key of its labels in reverse, each ended by a dot, so that a
rule's host and all its subdomains share a prefix of keys. A page stands once for
each prefix of its key that some rule names; there, with the page's path appended, a
rule is an interval of (key, path), and intervals nest. Rules and pages are
range-sorted together; one sweep over each range partition keeps a stack of the rules
that are open at the current place, whose top is the longest path that fits. Of a
page's places the one with the longest key decides.

The rules that are open at the start of a partition are found by an equi-join of the
path prefixes of its first row (only of lengths that the key's rules have) and travel
as rows of that partition. A host with a third of all pages is spread over many
partitions, as the sort goes on by path and row. Nothing is broadcast by force.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits no rule; pages that no rule fits get the default verdict; equal rules
with different verdicts block; the same page listed twice is judged twice; other
columns are ignored; empty tables of pages or rules are fine.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import map_arrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("rule", T.StringType()),
                      T.StructField("verdict", T.StringType())])


def _sweep(batches):
    """The open rule of each page row, by partition of the range sort."""
    place, opened = None, []  # opened: (path, rule, verdict), each path a prefix of the next
    for b in batches:
        out = {n: [] for n in FOUND.names}
        for part, key, path, row, depth, rule, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (part, key) != place:
                place, opened = (part, key), []
            while opened and not path.startswith(opened[-1][0]):
                opened.pop()
            if row is None:
                opened.append((path, rule, verdict))
            elif opened:
                for n, v in zip(FOUND.names, (row, depth, *opened[-1][1:]), strict=True):
                    out[n].append(v)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_pydict({n: pa.array(out[n], k) for n, k in zip(FOUND.names, kinds, strict=True)})


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict per page; rules (host, path, verdict)."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_host(F.col(f"`{url_col}`")), url_path(F.col(f"`{url_col}`"))
    some = (rules.where("host is not null and host <> ''")
            .select(host_key(F.lower("host")).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit("block")).alias("verdict"),
                    F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"))
            .groupBy("key", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict", "rule")).alias("r"))
            .select("key", "path", "r.rule", "r.verdict"))
    some = stage(some, "url-rules")
    keys = stage(some.select("key").distinct(), "url-rule-keys")
    rows = stage(pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                              F.monotonically_increasing_id().alias("row")), "url-pages")
    labels = F.split(host_key(F.col("host")), "\\.")  # the last one is empty
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
                           lambda k: F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))
    places = (rows.where("host <> ''").select("row", "path", F.posexplode(prefixes).alias("depth", "key")).join(keys, "key", "left_semi")
              .select("key", "path", F.lit(1).alias("kind"), "row", "depth", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))
    opening = some.select("key", "path", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("depth"), "rule", "verdict")
    order = ["key", "path", "kind", "row"]
    dealt = places.unionByName(opening).repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumn("at", F.monotonically_increasing_id()), "url-places")
    dealt = dealt.withColumn("part", F.shiftright("at", 33).cast("int"))
    first = dealt.where(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) == 0).select("part", "key", "path")  # a row a partition
    lengths = some.select("key", F.length("path").alias("n")).distinct()
    above = first.join(lengths, "key").where(F.col("n") <= F.length("path")).select("part", "key", F.substring("path", F.lit(1), F.col("n")).alias("path"))
    carried = above.join(opening, ["key", "path"])
    columns = ["part", "key", "path", "row", "depth", "rule", "verdict"]
    both = (dealt.select(*columns, "kind").unionByName(carried.select(*columns, "kind")).repartition(n, "part")
            .sortWithinPartitions("part", *order))
    best = (map_arrow(both.select(*columns), _sweep, FOUND).groupBy("row")
            .agg(F.max(F.struct("depth", "rule", "verdict")).alias("hit")))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                                                 F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
