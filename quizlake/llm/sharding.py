"""Balanced contiguous shards (operator 10).

Documents are range-sorted by a hash of their text, so that equal texts lie side
by side; byte totals of the range partitions give every row its global byte
position, and the byte line is cut at equal targets. A cut that would part a
group of equal texts moves to the nearer end of the group if that end is within
``slack`` of a shard; a larger group is parted, so a group holding a third of
all rows still gives near equal shards.

Defined cases: a null text has no bytes, hence size 1 and crc 0, and counts as
the empty text; repeated rows get slots of their own; with fewer documents than
shards some shards are empty; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums


def shard_documents(docs: DataFrame, shards: int = 8, slack: float = 0.01, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, shard, slot (from 0, without
    gaps, in global order) per document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_key"),
                       F.lit(1).cast("long").alias("one"))
    group = ["text_key", "text_crc32", "size"]
    placed = prefix_sums(rows, [*group, "doc_id"], ["size", "one"], "shards")
    total = placed.agg(F.sum("size")).first()[0] or 0
    targets = [total * k / shards for k in range(1, shards)]
    end = F.col("size_before") + F.col("size")
    # the rows on both sides of a cut that falls between two rows
    touched = [F.when((F.col("size_before") <= F.lit(t)) & (end >= F.lit(t)), F.lit(k)) for k, t in enumerate(targets)]
    cut_rows = placed.where(F.coalesce(*touched, F.lit(None).cast("int")).isNotNull()).select(*group).distinct()  # two rows a cut at most
    edges = (placed.join(F.broadcast(cut_rows), group, "left_semi").groupBy(*group)
             .agg(F.min("size_before").alias("first"), F.max(end).alias("last")).collect())  # two rows a cut at most
    cuts = []
    for t in targets:
        near = min((e for g in edges if g["first"] < t < g["last"] for e in (g["first"], g["last"])),
                   key=lambda e: abs(e - t), default=t)
        cuts.append(near if abs(near - t) <= slack * total / shards else t)
    middle = F.col("size_before") + F.col("size") / 2
    shard = sum(((middle >= F.lit(float(c))).cast("int") for c in cuts), F.lit(0))
    dealt = placed.withColumn("shard", shard)
    first = dealt.groupBy("shard").agg(F.min("one_before").alias("first_row"))  # a row a shard
    return (dealt.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("one_before") - F.col("first_row")).alias("slot")))
