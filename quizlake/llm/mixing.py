"""Mixing sources to target weights (operator 2).

Every document gets a hash-random key; rows are range-sorted by source and key,
running word counts come from per-partition totals, and each source is cut at
its exact budget: whole epochs first, then the first documents of one more pass,
the last of them in part. A source of any size is spread over many range
partitions; only one row a source is aggregated per source.

Defined cases: null and empty texts have size 0 and take 0 words; a null source
is a source of its own, ranked last; sources without words get target 0;
repeated rows are rows like any other; other columns are ignored; an empty table
gives an empty table. Keys depend on the id, the size and the seed alone, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import fresh, prefix_sums

WORD_GAP = "[ \\t\\n\\x0B\\f\\r]+"  # white space between words
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, WORD_GAP))).cast("long")


def random_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, name: str) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Weights repeat
    over the sources in code point order, null last. Targets share ``share`` of
    all words by weight; those above ``most`` times their source stop there and
    the rest is shared again until none is above."""
    ranked = prefix_sums(sizes.select("source", "source_size", F.col("source").isNull().alias("no_source"),
                                      F.lit(1).cast("long").alias("one")),
                         ["no_source", "source"], ["one"], name)
    weight = F.array(*(F.lit(float(w)) for w in weights))[(F.col("one_before") % len(weights)).cast("int")]
    s = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"))
    total, level, full = None, 0.0, -1
    while True:  # every turn but the last caps one more source at least; one row comes back
        above = F.col("cap") <= F.col("weight") * F.lit(level)
        got = s.agg(F.sum("source_size").alias("size"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("capped"),
                    F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"),
                    F.sum(above.cast("int")).alias("full")).first()
        if got["size"] is None or got["full"] == full or not got["weight"]:
            break
        total = got["size"] * share if total is None else total
        level, full = max(0.0, (total - got["capped"]) / got["weight"]), got["full"]
    if got["size"] is not None and not got["weight"]:
        level = float("inf")
    by_weight = F.col("weight") * F.lit(level)
    return s.select("source", "source_size", F.least(F.col("cap"), by_weight).alias("target"))


def _ordered(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, name: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                       word_count(F.col(f"`{text_col}`")).alias("size"))
    rows = rows.withColumn("mix_key", random_key(F.col("doc_id"), seed))
    return prefix_sums(rows, ["source", "mix_key", "doc_id", "size"], ["size"], name)


def _with_budget(docs, id_col, text_col, source_col, weights, share, most, seed):
    rows = _ordered(docs, id_col, text_col, source_col, seed, "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("size_before").alias("source_start"))
    sizes = stage(sizes, "mix-sources")
    t = source_targets(sizes, weights, share, most, "mix-rank")
    budget = F.floor(F.col("target")).cast("long")
    t = (t.join(sizes.select("source", "source_start"), t["source"].eqNullSafe(sizes["source"])).drop(sizes["source"])
         .withColumn("budget", budget)
         .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0))
         .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")))
    t = stage(t, "mix-targets")
    joined = rows.join(t.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined, t


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken per document: ``taken`` words of
    it go into the mix, repeats counted."""
    joined, _ = _with_budget(docs, id_col, text_col, source_col, weights, share, most, seed)
    before = F.col("size_before") - F.col("source_start")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return joined.select("doc_id", "size", "source_size", "target",
                         (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                    seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, whole and unchanged, each as often as the mix takes
    it: the cut is moved to the nearest document border. The documents are only
    joined to one row a source, which holds the key of the last document of the
    unfinished epoch."""
    joined, targets = _with_budget(docs, id_col, text_col, source_col, weights, share, most, seed)
    cut, copy = fresh(docs, "__cut"), fresh(docs, "__copy")
    place = F.struct("mix_key", "doc_id", "size")
    inside = (F.col("size_before") - F.col("source_start") + F.col("size") / 2) <= F.col("rest")
    last = joined.where(inside & (F.col("rest") > 0)).groupBy("source").agg(F.max(place).alias("mix_last"))
    cuts = (targets.select(F.col("source").alias("mix_source"), F.col("epochs").alias("mix_epochs"))
            .join(last, F.col("mix_source").eqNullSafe(F.col("source")), "left").select("mix_source", "mix_epochs", "mix_last"))
    cuts = stage(cuts.select(F.struct("mix_source", "mix_epochs", "mix_last").alias(cut)), "mix-cuts")
    own = F.struct(random_key(F.col(f"`{id_col}`"), seed).alias("mix_key"), F.col(f"`{id_col}`").alias("doc_id"),
                   word_count(F.col(f"`{text_col}`")).alias("size"))
    copies = F.col(f"{cut}.mix_epochs") + F.when(own <= F.col(f"{cut}.mix_last"), 1).otherwise(0)
    return (docs.join(cuts, F.col(f"`{source_col}`").eqNullSafe(F.col(f"{cut}.mix_source")))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).drop(copy, cut))
