"""Source divergence audit (operator 13): how far the word shares of the sources of a
language lie apart, and which terms a source uses more than its language does.

A group is a (language, source); p is a group's share of a term, smoothed and in
whole billionths: 1 + floor(10^9 (count + 5) / (N + 5 V)). With p0 the share of a
term that a group does not have, the distance of two groups is

    sum |p - q|  =  B(g, h) + B(h, g) + C(g, h) + (V - |g| - |h|) |p0 - q0|
    B(g, h)      =  sum over the terms of g of |p - q0|          (zero baselines)
    C(g, h)      =  sum over the terms of both of
                    |p - q| - |p - q0| - |p0 - q| + |p0 - q0|    (their correction)

C is a sparse product of the counts with their transpose, accumulated row by row
(Gustavson): a group scatters each of its terms through the term-major index into
a dense array with one cell for each peer, so no pair of postings is ever a row.
The index is dealt over cells (block of groups x block of terms) of bounded size; a
cell returns one array a group. All arithmetic is in whole numbers.

Defined cases: a null text, lang or source is ''; a group without kept terms has
the counts 0; a language without kept terms gives pairs of value 0 and no terms; a
lone source has no pairs; repeated rows are documents of their own; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage
from .common import fold_table, growing_tables, map_arrow, pieces

#: Letters, and every character beyond ASCII; A-Z are lower-cased.
FOLD = fold_table(lambda b: b >= 0x80 or chr(b).isalpha())
UNIT, PRIOR = 1_000_000_000, 5
HELD_TERMS = 300_000  # counted terms a task holds before it passes them on (memory bound only)
CELL_ENTRIES = 1 << 17  # postings of one cell
ROW_GROUPS = 1 << 10  # groups whose rows one cell accumulates
SCATTER = 1 << 20  # postings scattered at a time

COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()),
                       T.StructField("count", T.LongType()), T.StructField("docs", T.LongType())])
PARTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                      T.StructField("value", T.LongType())])


def _count(batches, most_terms):
    """Occurrences and documents of each term of each group, added up in the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def release():
        for (lang, source), (count, docs) in held.items():
            terms = list(count)
            for s in range(0, len(terms), 20_000):
                some = terms[s:s + 20_000]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(some), pa.string()), "source": pa.array([source] * len(some), pa.string()),
                    "term": pa.array(some, pa.binary()).cast(pa.string()), "count": pa.array([count[t] for t in some], pa.int64()),
                    "docs": pa.array([docs[t] for t in some], pa.int64())})
        held.clear()

    with growing_tables():
        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                group = held.get((lang, source))
                if group is None:
                    group = held[lang, source] = Counter(), Counter()
                seen: set[bytes] = set()
                for words in pieces(text.encode().translate(FOLD)):
                    group[0].update(words)
                    seen.update(words)
                group[1].update(seen)
            if sum(len(c) for c, _ in held.values()) >= most_terms:
                yield from release()
        yield from release()


def share(count: np.ndarray, base: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / base), by long division in steps of 1,000, so
    that nothing overflows while base < 9 * 10^15."""
    whole, rest = np.divmod(count + PRIOR, base)
    out = whole * UNIT + 1
    for place in (1_000_000, 1_000, 1):
        digit, rest = np.divmod(rest * 1000, base)
        out += digit * place
    return out


def share_sql(count: str, base: str) -> Column:
    """``share`` of two long columns."""
    first = f"({count} + {PRIOR})"
    rest, out = f"({first} % {base})", f"{first} div {base} * {UNIT} + 1"
    for place in (1_000_000, 1_000, 1):
        out += f" + ({rest} * 1000) div {base} * {place}"
        rest = f"(({rest} * 1000) % {base})"
    return F.expr(out)


def accumulate(base: np.ndarray, rows: range, term: np.ndarray, group: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(g, B(g, .), C(g, .)) for the groups g of ``rows`` that have terms in this cell.

    ``base``: N + 5 V of every group of the language; the postings are sorted by
    ``term`` (numbers from 0), so a term's postings are one slice of them."""
    p, p0 = share(count, base[group]), share(np.zeros_like(base), base)
    start = np.searchsorted(term, np.arange(term[-1] + 2))
    by_group = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[by_group], np.arange(rows.start, rows.stop + 1))
    for g, (s, e) in zip(rows, zip(ends, ends[1:], strict=False), strict=True):
        own = by_group[s:e]
        if not len(own):
            continue
        line = np.sort(p[own])
        run = np.concatenate([[0], np.cumsum(line)])
        below = np.searchsorted(line, p0)  # |p - q0| summed over the group's terms, for each peer
        zero = p0 * (2 * below - len(line)) + run[-1] - 2 * run[below]
        both = np.zeros(len(base), dtype=np.int64)
        size = start[term[own] + 1] - start[term[own]]
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + SCATTER, SCATTER), side="right")
        for x, y in zip(cuts, cuts[1:], strict=False):
            mine, n = own[x:y], size[x:y]
            if not len(mine):
                continue
            at = np.repeat(start[term[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            h, q, mine_p = group[at], p[at], np.repeat(p[mine], n)
            np.add.at(both, h, np.abs(mine_p - q) - np.abs(mine_p - p0[h]) - np.abs(p0[g] - q) + np.abs(p0[g] - p0[h]))
        yield g, zero, both


def _cells(batches, row_groups):
    """Accumulator rows of each cell of a partition sorted by cell: first the cell's
    row of peers, then its postings in term order."""
    cell, peers, parts = None, None, []

    def rows_of(lang, a, b, value):
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(value), pa.string()), "a": pa.array(a, pa.int64()),
                                           "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})

    def finish():
        lang, block, part = cell
        n, kept, v = peers
        rows, every = range(block * row_groups, min(len(n), (block + 1) * row_groups)), np.arange(len(n))
        if part == 0:  # terms that neither group has
            p0 = share(np.zeros_like(n), n + PRIOR * v) if v else np.zeros_like(n)
            for g in rows:
                yield rows_of(lang, np.full(len(n), g), every, (v - kept[g] - kept) * np.abs(p0[g] - p0))
        if parts:
            t = pa.Table.from_batches(parts)
            words = t.column("term").combine_chunks().dictionary_encode()
            code = words.indices.to_numpy().astype(np.int64)  # first seen first, hence ascending
            for g, zero, both in accumulate(n + PRIOR * v, rows, code, t.column("group").to_numpy(), t.column("count").to_numpy()):
                yield rows_of(lang, np.full(len(n), g), every, zero + both)
                yield rows_of(lang, every, np.full(len(n), g), zero)

    for b in batches:
        if not b.num_rows:
            continue
        lang, block, part = (b.column(b.schema.get_field_index(c)) for c in ("lang", "block", "part"))
        where = lang.dictionary_encode().indices.to_numpy()
        x, y = block.to_numpy(), part.to_numpy()
        edges = np.flatnonzero((np.diff(where) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            key = lang[s].as_py(), int(x[s]), int(y[s])
            if key != cell:
                if cell is not None:
                    yield from finish()
                cell, parts = key, []
                head = b.slice(s, 1).to_pylist()[0]
                peers = np.array(head["totals"], np.int64), np.array(head["kept"], np.int64), head["v"]
                s += 1
            if e > s:
                parts.append(b.slice(s, e - s).select(["term", "group", "count"]))
    if cell is not None:
        yield from finish()


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50, cell_entries: int = CELL_ENTRIES, row_groups: int = ROW_GROUPS,
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: the distance to every
    other source of the language, and the ``top_terms`` terms with the largest excess
    over the language's own share."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for n, c in (("text", text_col), ("lang", lang_col), ("source", source_col))))
    counted = map_arrow(rows, _count, COUNTS, most_terms=HELD_TERMS).repartition("lang", "term")
    whole = Window.partitionBy("lang", "term")  # a term's groups: as many rows as sources at most
    kept = (counted.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
            .select("lang", "term", "source", "count", F.sum("docs").over(whole).alias("in_docs"), F.sum("count").over(whole).alias("in_lang"))
            .where(F.col("in_docs") >= least_docs).drop("in_docs"))
    kept = stage(kept, "divergence-counts")
    of_lang = (kept.groupBy("lang", "term").agg(F.first("in_lang").alias("n")).groupBy("lang")
               .agg(F.count("*").alias("v"), F.sum("n").alias("lang_total")))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("kept"))
    zero = {"total": 0, "kept": 0, "v": 0, "lang_total": 0}
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(zero)
    numbered = Window.partitionBy("lang").orderBy("source")  # as many rows as the language has sources
    groups = stage(groups.withColumn("group", (F.row_number().over(numbered) - 1).cast("long")), "divergence-groups")
    index = kept.join(groups.select("lang", "source", "group", "total", "v", "lang_total"), ["lang", "source"])
    return _pairs(index, groups, cell_entries, row_groups).unionByName(_terms(index, top_terms))


def _pairs(index: DataFrame, groups: DataFrame, cell_entries: int, row_groups: int) -> DataFrame:
    entries = groups.agg(F.sum("kept")).first()[0] or 0
    parts = max(1, math.ceil(entries / cell_entries))
    peers = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("group", "total", "kept"))).alias("x"), F.first("v").alias("v"))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_groups") - 1) / row_groups).cast("int")))
    head = (peers.withColumn("n_groups", F.size("x")).withColumn("block", blocks)
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            .select("lang", "block", "part", F.lit(0).alias("kind"), F.lit("").alias("term"), F.lit(None).cast("long").alias("group"),
                    F.lit(None).cast("long").alias("count"), F.col("x.total").alias("totals"), F.col("x.kept").alias("kept"), "v"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
    body = (index.join(sizes, "lang").withColumn("block", blocks)
            .select("lang", "block", F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "term",
                    "group", "count", F.lit(None).cast("array<bigint>").alias("totals"), F.lit(None).cast("array<bigint>").alias("kept"),
                    F.lit(None).cast("long").alias("v")))
    cells = (head.unionByName(body).repartition("lang", "block", "part")
             .sortWithinPartitions("lang", "block", "part", "kind", "term"))
    added = map_arrow(cells, _cells, PARTS, row_groups=row_groups).where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "group", "source")
    named = (added.join(names.withColumnRenamed("group", "a"), ["lang", "a"])
             .join(names.select("lang", F.col("group").alias("b"), F.col("source").alias("item")), ["lang", "b"]))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(index: DataFrame, top_terms: int) -> DataFrame:
    wide = (index.withColumn("base", F.col("total") + PRIOR * F.col("v")).withColumn("lang_base", F.col("lang_total") + PRIOR * F.col("v"))
            .withColumn("p", share_sql("count", "base")).withColumn("q", share_sql("in_lang", "lang_base")).where("p > q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (wide.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
