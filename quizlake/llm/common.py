"""Helpers shared by the training-data operators.

``prefix_sums``  global running totals from a range sort and per-partition totals
``components``   connected components of an edge table (large-star / small-star)
``tile_links``   blocks of rows, each stored as one Arrow record batch, and the links
                 found in and between blocks whose key intervals can hold a pair
``grid_cells``   query blocks against all blocks, dealt over a grid
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import drop_stage, stage

_SHIPPED: set[str] = set()
_KEPT: dict[str, dict] = {}  # of this worker process, by the operator's module
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20  # of one Arrow batch between Spark and Python


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    tasks can import it where it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(prefix="quizlake-ship-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


@contextmanager
def growing_tables():
    """No search for reference cycles while a task fills large dictionaries of
    tuples: there are none, and each search would walk all entries."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body (or a lambda in it) refers to it."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by rows and bytes: a batch is held by the
    JVM and by Python at once, and long texts or tiles would make the default one large."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def kept_in_worker(module: str) -> dict:
    """The dictionary in which an operator's module keeps what its next task in the same
    worker process can use again."""
    return _KEPT.setdefault(module, {})


def give_back() -> None:
    """Return memory that is free in this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _task(batches, fn, params):
    """A task of ``fn``. Spark hands worker processes from stage to stage and keeps idle
    ones: what another operator kept in this one goes first, free memory goes at the end."""
    if fn.__module__ != __name__:  # the helpers here work for every operator
        for kept in (d for module, d in _KEPT.items() if module != fn.__module__):
            kept.clear()
    yield from fn(batches, **params)
    give_back()


def map_arrow(df: DataFrame, fn, schema: T.StructType, **params) -> DataFrame:
    """``mapInArrow`` with a module-level function and its parameters."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(partial(_task, fn=fn, params=params), schema)


def small_parts(batch: pa.RecordBatch, text: int, most_bytes: int = 4 << 20):
    """Slices of a batch whose texts (column number ``text``) have about
    ``most_bytes`` together; a longer text is a slice by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def fold_table(kept) -> bytes:
    """A ``bytes.translate`` table: A-Z lower-cased, bytes that ``kept`` refuses as spaces."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if kept(b) else 0x20 for b in range(256))


def pieces(folded: bytes, most_bytes: int = 1 << 20):
    """The words of a folded text, in lists cut at spaces after about ``most_bytes``:
    a very long text is never a list of all its words."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + most_bytes)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


# --- distributed prefix sums --------------------------------------------------

def _running(batches, values):
    totals = {v: 0 for v in values}
    pid = TaskContext.get().partitionId()
    for b in batches:
        cols, names = list(b.columns), list(b.schema.names)
        for v in values:
            x = b.column(names.index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(x) + totals[v]
            cols.append(pa.array(end - x, type=pa.int64()))
            if len(end):
                totals[v] = int(end[-1])
        cols.append(pa.array(np.full(b.num_rows, pid, dtype=np.int32)))
        yield pa.RecordBatch.from_arrays(cols, names=[*names, *(f"{v}_before" for v in values), "_part"])


def prefix_sums(df: DataFrame, keys: list[str], values: list[str], name: str,
                partitions: int | None = None) -> DataFrame:
    """``df`` (range-sorted by ``keys``) with ``<v>_before`` for each long column
    ``v`` of ``values``: its total over all earlier rows in key order.

    Each range partition adds up its own rows, the per-partition totals (one row
    a partition) are summed, and the carry is added back: no global window. The
    sorted rows are staged, so that both passes see one and the same order. Rows
    that are equal in ``keys`` should be equal altogether for repeatable results.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(f"`{k}`") for k in keys]
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{v}_before", T.LongType()) for v in values),
                           T.StructField("_part", T.IntegerType())])
    local = stage(map_arrow(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols), _running, schema,
                            values=values), name)
    totals = local.groupBy("_part").agg(*(F.max(F.col(f"{v}_before") + F.col(v)).alias(f"_t_{v}") for v in values))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carry = totals.select("_part", *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_c_{v}")
                                     for v in values))
    out = local.join(F.broadcast(carry), "_part")  # at most `partitions` rows
    return out.select(*df.columns, *((F.col(f"{v}_before") + F.col(f"_c_{v}")).alias(f"{v}_before")
                                     for v in values))


# --- connected components -----------------------------------------------------

def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the
    smallest node id of the component. Large-star / small-star rounds until the
    edge table no longer changes (about log n rounds); no round makes more rows than
    it has edges (twice that for the small star), and hot centres are reduced by a
    map-side minimum before their join. A round's table goes when the next is written."""
    e = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
              name)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(least, "b")
                 .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
                                           F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x"))
                 .select("x.a", "x.b").where("a <> b").distinct())
        before, e = e, stage(small, name)
        drop_stage(before)
    members = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return members.union(e.select(F.col("a"), F.col("a")).distinct())


# --- tiles ----------------------------------------------------------------------

TILE_SCHEMA = T.StructType([
    T.StructField("tile", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
    T.StructField("first_band", T.LongType()), T.StructField("last_band", T.LongType()),
    T.StructField("n_rows", T.IntegerType()), T.StructField("rows", T.BinaryType())])


def _cut(batches, split_bands, tile_rows, tile_bytes):
    """One output row per block of consecutive sorted rows; columns `band` and
    `pos` give its intervals, the other columns go into the block."""
    pid, seq, parts, count, size = TaskContext.get().partitionId(), 0, [], 0, 0

    def block():
        nonlocal seq, parts, count, size
        t = pa.Table.from_batches(parts).combine_chunks()
        band, pos = t.column("band").to_numpy(), t.column("pos").to_numpy()
        body = t.drop_columns(["band", "pos"]).to_batches(max_chunksize=max(1, t.num_rows))[0]
        out = pa.RecordBatch.from_pydict(
            {"tile": [(pid << 32) | seq], "lo": [float(pos.min())], "hi": [float(pos.max())],
             "first_band": [int(band.min())], "last_band": [int(band.max())],
             "n_rows": pa.array([t.num_rows], type=pa.int32()), "rows": pa.array([write_block(body)], type=pa.binary())})
        seq, parts, count, size = seq + 1, [], 0, 0
        return out

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        band = b.column(b.schema.get_field_index("band")).to_numpy()
        width = max(1, b.nbytes // b.num_rows)
        cuts = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), b.num_rows] if split_bands else [0, b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if split_bands and count and band[s] != last:
                yield block()
            while s < e:
                room = min(tile_rows - count, max(1, (tile_bytes - size) // width), e - s)
                parts.append(b.slice(s, room))
                count, size, s = count + room, size + room * width, s + room
                if count >= tile_rows or size >= tile_bytes:
                    yield block()
            last = band[e - 1]
    if count:
        yield block()


def cut_tiles(df: DataFrame, name: str, order: list[str], split_bands: bool = True, tile_rows: int = 4096,
              tile_bytes: int = 8 << 20, partitions: int | None = None) -> DataFrame:
    """Staged tiles of ``df`` (columns band long, pos double, then the payload),
    cut from its rows in ``order``; a band's rows may fill many tiles of at most
    ``tile_rows`` rows and about ``tile_bytes`` bytes, so a hot band is split."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stage(map_arrow(sorted_rows, _cut, TILE_SCHEMA, split_bands=split_bands, tile_rows=tile_rows,
                           tile_bytes=tile_bytes), name)


GROUP_TILES = 8  # consecutive tiles that travel together


def tile_cells(tiles: DataFrame, reach: list[int], near) -> DataFrame:
    """(left, right, kind, and a tile's columns), sorted by cell and kind: for each two
    groups of consecutive tiles that share a band (or lie ``reach`` bands apart) and for
    which ``near`` holds on their intervals, the tiles of the left group (kind 0) and of
    the right one (kind 1). A tile is sent once for each group that is near its own, not
    for each tile. The pairing is an equi-join on the band over one small row a group."""
    grouped = tiles.withColumn("group", F.shiftright("tile", GROUP_TILES.bit_length() - 1))
    meta = grouped.groupBy("group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first_band").alias("first_band"),
                                        F.max("last_band").alias("last_band"))
    ends = meta.withColumn("band", F.explode(F.array_distinct(F.array("first_band", "last_band"))))
    left = ends.select(F.col("band"), *(F.col(c).alias(f"l_{c}") for c in ("group", "lo", "hi")))
    right = (ends.withColumn("step", F.explode(F.array(*(F.lit(x) for x in reach))))
             .select((F.col("band") - F.col("step")).alias("band"), *(F.col(c).alias(f"r_{c}") for c in ("group", "lo", "hi"))))
    pairs = (left.join(right, "band").where(near(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")))
             .select(F.least("l_group", "r_group").alias("left"), F.greatest("l_group", "r_group").alias("right")).distinct())
    columns = ["tile", "lo", "hi", "first_band", "last_band", "rows"]
    body = grouped.select("group", *columns)
    sides = [pairs.join(body, F.col(side) == F.col("group")).select("left", "right", F.lit(kind).alias("kind"), *columns)
             for kind, side in enumerate(("left", "right"))]
    return (sides[0].unionByName(sides[1].where("left <> right")).repartition("left", "right")
            .sortWithinPartitions("left", "right", "kind", "tile"))


def grid_cells(queries: DataFrame, tiles: DataFrame, extra: str, same_band: bool, pack_tiles: int = 64, shard_tiles: int = 64) -> DataFrame:
    """(band, pack, shard, kind, tile, first_band, rows, extra): query blocks (kind 0)
    and tiles (kind 1) dealt to the cells of a grid, sorted by cell and kind.

    Blocks are dealt to packs and tiles to shards of about 64; a cell holds one pack
    and one shard, so a tile is sent once to each pack, not to each block. With
    ``same_band`` each band has a grid of its own (column band), as large as the band's
    own counts ask for; else there is one grid (band 0)."""
    key = F.col("first_band") if same_band else F.lit(0).cast("long")
    kind = [queries.select(key.alias("band"), "tile", "first_band", "rows", extra),
            tiles.select(key.alias("band"), "tile", "first_band", "rows")]
    count = [x.groupBy("band").agg(F.ceil(F.count("*") / n).cast("int").alias(c))
             for x, n, c in ((kind[0], pack_tiles, "packs"), (kind[1], shard_tiles, "shards"))]
    sides = []
    if same_band:
        sizes = count[0].join(count[1], "band")  # a row a band
        sides = [x.join(sizes, "band") for x in kind]
    else:
        packs, shards = ((c.first() or {c.columns[1]: 1})[c.columns[1]] for c in count)
        sides = [x.withColumn("packs", F.lit(packs)).withColumn("shards", F.lit(shards)) for x in kind]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("tile"), F.col(n)).cast("int")
    left = sides[0].withColumn("pack", dealt("packs")).withColumn("shard", spread("shards")).withColumn("kind", F.lit(0))
    right = (sides[1].withColumn("shard", dealt("shards")).withColumn("pack", spread("packs")).withColumn("kind", F.lit(1))
             .withColumn(extra, F.lit(None).cast(queries.schema[extra].dataType)))
    cells = ["band", "pack", "shard"]
    columns = [*cells, "kind", "tile", "first_band", "rows", extra]
    return (left.select(*columns).unionByName(right.select(*columns)).repartition(*cells)
            .sortWithinPartitions(*cells, "kind", "tile"))


def write_block(block: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as w:
        w.write_batch(block)
    return sink.getvalue().to_pybytes()


def read_block(rows: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(rows)))


class Forest:
    """Union-find over the rows of one tile or tile pair, fed a row with its
    partners at a time; keeps one edge for each union (a spanning forest). An
    operator may also count each row's links."""

    def __init__(self, label: np.ndarray):
        self.label, self.edges, self.links = label, [], np.zeros(len(label), dtype=np.int64)

    def unlinked(self, i: int, others: np.ndarray) -> np.ndarray:
        return others[self.label[others] != self.label[i]]

    def link(self, i: int, others: np.ndarray) -> None:
        others = self.unlinked(i, others)
        if len(others):
            roots, first = np.unique(self.label[others], return_index=True)
            self.edges += [(i, int(others[k])) for k in first]
            self.label[np.isin(self.label, np.append(roots, self.label[i]))] = self.label[i]


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])


def _column(block: pa.RecordBatch, name: str):
    return block.column(block.schema.get_field_index(name))


def _settled(batches, link):
    """Each tile with the groups among its own rows: `local`, the number of the row
    that stands for a row's group, and `links`."""
    for b in batches:
        for k in range(b.num_rows):
            block = read_block(_column(b, "rows")[k].as_py())
            forest = Forest(np.arange(block.num_rows))
            link(block, None, forest)
            block = block.append_column("local", pa.array(forest.label, pa.int64())).append_column("links", pa.array(forest.links, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [_column(b, n).slice(k, 1) if n != "rows" else pa.array([write_block(block)], pa.binary()) for n in TILE_SCHEMA.names],
                names=TILE_SCHEMA.names)


def _link_rows(fp: np.ndarray, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([fp[a], fp[some]]), pa.int64()),
                                       "b": pa.array(np.concatenate([fp[b], fp[some]]), pa.int64()),
                                       "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), links[some]]), pa.int64())})


def _within(batches):
    for b in batches:
        for rows in b.column(0):
            block = read_block(rows.as_py())
            local = _column(block, "local").to_numpy()
            i = np.flatnonzero(local != np.arange(len(local)))
            yield _link_rows(_column(block, "fp").to_numpy(), local[i], i, _column(block, "links").to_numpy())


def _across(batches, link, near, reach):
    """Links of the tile pairs of each cell; the left group's tiles are held, those of the
    right group stream by. A cell of one group with itself pairs its tiles as they come."""
    cell, held = None, []
    for b in batches:
        for k in range(b.num_rows):
            one, two, kind, _, lo, hi, first, last, rows = (c[k].as_py() for c in b.columns)
            if (one, two) != cell:
                cell, held = (one, two), []
            at, block = {"lo": lo, "hi": hi, "first": first, "last": last}, read_block(rows)
            for other, left in held if kind or one == two else ():
                if max(first, other["first"]) - min(last, other["last"]) > max(reach) or not near(other.get, at.get):
                    continue
                fp, local = (np.concatenate([_column(x, n).to_numpy() for x in (left, block)]) for n in ("fp", "local"))
                local[left.num_rows:] += left.num_rows
                forest = Forest(local)
                link(left, block, forest)
                e = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
                yield _link_rows(fp, e[:, 0], e[:, 1], forest.links)
            if not kind:
                held.append((at, block))


def anywhere(l, r):  # noqa: E741
    """A ``near`` that holds for all tiles that share a band."""
    return l("lo") == l("lo")


def tile_links(tiles: DataFrame, name: str, reach: list[int], near, link) -> DataFrame:
    """(a, b, links): edges that join the rows (column ``fp``) of each group of
    linked rows, links 0, and for rows with counted links (a = b) their number
    from one tile or tile pair.

    ``near(l, r)`` tells from the intervals, by ``l("lo")`` and so on, whether two tiles
    (or groups of tiles) can hold a linked pair; it works on columns and on numbers.
    ``link(left, right, forest)`` compares two blocks (right None: the rows of one
    block). Tiles settle their own groups first; a tile pair then returns an edge
    only where it joins two groups, so a group of g rows in t tiles makes about
    g + t * t edges, and never a row a pair.
    """
    settled = stage(map_arrow(tiles, _settled, TILE_SCHEMA, link=link), name)
    within = map_arrow(settled.select("rows"), _within, LINKS)
    return within.unionByName(map_arrow(tile_cells(settled, reach, near), _across, LINKS, link=link, near=near, reach=reach))
