"""Row numbers and running sums within ordered groups, whatever their sizes.

A plain ``Window.partitionBy(group)`` puts a whole group in one task. That is right for
groups of up to ``WHOLE_ROWS`` rows. The rows of a larger group get blocks of their
order key on several levels, from fine to coarse (``levels``: columns that never
decrease along the order, each a coarser form of the one before). Windows run per
(group, finest block); the totals of the blocks are carried forward level by level, by
windows per (group, next coarser block), and joined back by key. So no window holds
more than a small group, a block of rows or a block of totals, except the last, which
holds one row for each coarsest block of a group.

The rows move once: the window's partitioning and order serve the join with the carries
too. The list of large groups (at most rows / ``WHOLE_ROWS`` names) is staged, so that
its size is known when it is joined; without any, the plan is the plain windows alone:
one exchange and no join. Results equal the plain window exactly for any
levels and sizes (for an order key that is unique within a group). A NULL group is a
group like any other. The columns of the input are kept apart in a struct, so they may
have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

WHOLE_ROWS = 100_000


def _carry(totals: DataFrame, levels: list[str]) -> DataFrame:
    """``before_n`` and ``before_c`` of every block: rows and sum of the earlier blocks
    of its group; ``size``: rows of the group. Keys are structs, hence never NULL."""
    own, upper = levels[0], levels[1:]
    scope = ["g", *upper[:1]]
    before = Window.partitionBy(*scope).orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint").alias(f"before_{c}") for c in ("n", "c")))
    if not upper:
        return inner.withColumn("size", F.sum("n").over(Window.partitionBy("g")).cast("bigint"))
    coarse = _carry(totals.groupBy("g", *upper).agg(F.sum("n").alias("n"), F.sum("c").alias("c")), upper)
    coarse = coarse.select(*scope, F.col("before_n").alias("up_n"), F.col("before_c").alias("up_c"), "size")
    return (inner.join(coarse, scope).withColumn("before_n", F.col("before_n") + F.col("up_n"))
            .withColumn("before_c", F.col("before_c") + F.col("up_c")).drop("up_n", "up_c"))


def ordered_prefix(df: DataFrame, group: str, order: list[str], value: str, levels: list[Column], number: str = "_rn",
                   running: str = "_cum", size: str = "_size", whole_rows: int | None = None) -> DataFrame:
    """Adds ``number`` (1-based position in the group by ``order``), ``running`` (sum of
    ``value`` up to and including the row) and ``size`` (rows of the group). ``df`` is
    read twice, the first time for its group column alone."""
    whole_rows = WHOLE_ROWS if whole_rows is None else whole_rows
    g = F.struct(F.col(group).alias("k"))
    large = stage(df.select(g.alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole_rows)
                  .select("g", F.lit(True).alias("large")), "large-groups")
    split = not large.isEmpty()
    names = [f"b{k}" for k in range(len(levels))] if split else []
    keys = [f"o{k}" for k in range(len(order))]
    rows = df.select(F.struct("*").alias("row"), g.alias("g"), F.col(value).cast("bigint").alias("v"),
                     *(level.alias(n) for level, n in zip(levels, names)),
                     *(F.col(o).alias(k) for o, k in zip(order, keys, strict=True)))
    if split:
        rows = rows.join(large, "g", "left").withColumns({n: F.struct(F.when(F.col("large"), F.col(n)).alias("k")) for n in names})
    scope = ["g", *names[:1]]
    whole = Window.partitionBy(*scope)
    w = whole.orderBy(*keys)
    local = rows.select("row", *scope, F.row_number().over(w).cast("bigint").alias("ln"),
                        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lc"),
                        F.count(F.lit(1)).over(whole).alias("ls"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in (number, running, size)]
    if not split:
        return local.select(*kept, F.col("ln").alias(number), F.col("lc").alias(running), F.col("ls").alias(size))
    totals = rows.where("large").groupBy("g", *names).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("c"))
    carry = _carry(totals, names).select(*scope, "before_n", "before_c", "size")
    zero = F.lit(0).cast("bigint")
    return local.join(carry, scope, "left").select(
        *kept, (F.col("ln") + F.coalesce("before_n", zero)).alias(number),
        (F.col("lc") + F.coalesce("before_c", zero)).alias(running), F.coalesce("size", "ls").alias(size))
