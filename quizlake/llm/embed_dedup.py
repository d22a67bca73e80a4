"""Embedding near-dedup by int8 tile products (operator 3).

Vectors are compared only within a label and a length. Equal vectors form a
class; one vector a class goes on, scaled to unit length and quantised to int8
with its own step. With the exact norm e of each quantisation error,

    |u.v - s_u s_v (q_u.q_v)|  <=  (1 + e_u) e_v + e_u

so a pair whose int8 product stays below the threshold by more than that cannot
be linked. Products are taken tile by tile: first over the int8 rows of a label
(tiles whose projections on one fixed direction lie too far apart are never
paired), which gives a spanning forest of the possible pairs; then, within the
components of possible pairs, full vectors are put in tiles, and possible pairs
are recomputed in double precision. Tile pairs return one row per vector that
has links there (how many, copies counted) and edges between groups, never pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, and those with a null label link with nothing; copies of one vector
link with each other; a vector alone is its own component; a null id is
never the smallest (null if the component has no other); other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import anywhere, components, cut_tiles, map_arrow, tile_links

SLACK = 1e-9  # over the rounding of any double computation below
QUANT = T.StructType([T.StructField("band", T.LongType()), T.StructField("pos", T.DoubleType()), T.StructField("fp", T.LongType()),
                      T.StructField("q", T.BinaryType()), T.StructField("step", T.DoubleType()), T.StructField("err", T.DoubleType())])


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, step, error norm) of unit rows, the errors rounded up."""
    step = np.maximum(np.abs(v).max(axis=1), 1e-300) / 127
    q = np.clip(np.rint(v / step[:, None]), -127, 127)
    err = np.sqrt(((v - step[:, None] * q) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return q.astype(np.int8), step, err


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _direction(d: int) -> np.ndarray:
    x = np.random.default_rng(20).standard_normal(d)
    return x / np.linalg.norm(x)


def _vectors(column) -> list[np.ndarray]:
    return [np.asarray(x, dtype=np.float64) for x in column.to_pylist()]


def _quantise(batches):
    for b in batches:
        if not b.num_rows:
            continue
        band, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        vectors = _vectors(b.column(2))
        out = {k: [] for k in ("band", "pos", "fp", "q", "step", "err")}
        lengths = np.array([len(x) for x in vectors])
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            u = _unit(np.stack([vectors[r] for r in rows]))
            q, step, err = quantise(u)
            out["band"] += band[rows].tolist()
            out["pos"] += (u @ _direction(int(d))).tolist()
            out["fp"] += fp[rows].tolist()
            out["q"] += [x.tobytes() for x in q]
            out["step"] += step.tolist()
            out["err"] += err.tolist()
        yield pa.RecordBatch.from_pydict({"band": pa.array(out["band"], pa.int64()), "pos": out["pos"], "fp": pa.array(out["fp"], pa.int64()),
                                          "q": pa.array(out["q"], pa.binary()), "step": out["step"], "err": out["err"]})


def possible(lq, ls, le, rq, rs, re, threshold: float) -> np.ndarray:
    """Which pairs of two quantised blocks may reach the threshold. Products of
    int8 rows are exact integers in float32 up to 1,040 components, else in
    float64."""
    kind = np.float32 if lq.shape[1] <= 1040 else np.float64
    dot = lq.astype(kind) @ rq.astype(kind).T
    near = dot.astype(np.float64) * ls[:, None] * rs[None, :]
    near += (1 + le)[:, None] * re[None, :] + le[:, None]
    return near >= threshold - SLACK


def _columns(block: pa.RecordBatch) -> dict:
    return {n: block.column(k) for k, n in enumerate(block.schema.names)}


def _int8_block(block: pa.RecordBatch):
    col = _columns(block)
    q = np.frombuffer(b"".join(col["q"].to_pylist()), dtype=np.int8).reshape(block.num_rows, -1)
    return q, col["step"].to_numpy(), col["err"].to_numpy()


def _candidates(left, right, forest, threshold):
    """Links vectors whose int8 product leaves the threshold possible."""
    lq, ls, le = _int8_block(left)
    rq, rs, re = (lq, ls, le) if right is None else _int8_block(right)
    base = 0 if right is None else len(lq)
    for at in range(0, len(lq), 256):
        ok = possible(lq[at:at + 256], ls[at:at + 256], le[at:at + 256], rq, rs, re, threshold)
        for i in np.flatnonzero(ok.any(axis=1)):
            forest.link(at + i, base + np.flatnonzero(ok[i]))


def _exact(left, right, forest, threshold):
    """Links vectors of one candidate component by their cosine, and counts links."""
    blocks = [_columns(x) for x in ((left,) if right is None else (left, right))]
    root, copies = (np.concatenate([x[n].to_numpy() for x in blocks]) for n in ("root", "copies"))
    vectors = [v for x in blocks for v in _vectors(x["vector"])]
    base, n_left = 0 if right is None else left.num_rows, left.num_rows
    lengths = np.array([len(v) for v in vectors])
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        v = np.stack([vectors[r] for r in rows])
        norm = np.sqrt((v * v).sum(axis=1))
        q, step, err = quantise(_unit(v))
        one, two = np.flatnonzero(rows < n_left), np.flatnonzero(rows >= base)
        for at in range(0, len(one), 256):
            i = one[at:at + 256]
            ok = possible(q[i], step[i], err[i], q[two], step[two], err[two], threshold)
            ok &= root[rows[i]][:, None] == root[rows[two]][None, :]
            x, y = np.nonzero(ok)
            hit = np.zeros(len(x), dtype=bool)
            for s in range(0, len(x), 1 << 16):  # full precision, possible pairs only
                a, c = i[x[s:s + 65536]], two[y[s:s + 65536]]
                hit[s:s + 65536] = (v[a] * v[c]).sum(axis=1) / (norm[a] * norm[c]) >= threshold
            hit &= i[x] != two[y]
            x, y = x[hit], y[hit]
            np.add.at(forest.links, rows[i[x]], copies[rows[two[y]]])
            if right is not None:
                np.add.at(forest.links, rows[two[y]], copies[rows[i[x]]])
            for r in np.unique(x):
                forest.link(int(rows[i[r]]), rows[two[y[x == r]]])


def _close(l, r, apart: float):
    return (r("lo") - l("hi") <= apart) & (l("lo") - r("hi") <= apart)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile_rows: int = 2048, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable by links) and kept (it is that vector) per vector."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"),
                          F.col(f"`{label_col}`").alias("label"))
    wide = F.transform("vector", lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fine = (F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True))
            & F.exists(wide, lambda x: x != 0.0))
    # 128 bits tell vectors apart; a class then gets a number of its own
    rows = rows.select("vec_id", "label", "vector", F.when(fine, F.xxhash64(F.lit(1), "label", "vector")).alias("k1"),
                       F.when(fine, F.xxhash64("vector", "label", F.lit(2))).alias("k2"))
    keyed = stage(rows.select("vec_id", "k1", "k2"), "embed-rows")
    group = F.xxhash64(F.col("label"), F.size("vector"))
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first(group).alias("band"), F.first("vector").alias("vector"))
    classes = stage(classes.withColumn("fp", F.monotonically_increasing_id()), "embed-classes")
    small = map_arrow(classes.select("band", "fp", "vector"), _quantise, QUANT)
    tiles = cut_tiles(small, "embed-tiles", ["band", "pos", "fp"], tile_rows=tile_rows)
    apart = float(np.sqrt(2 - 2 * threshold)) + 1e-6  # unit vectors of a linked pair are no farther apart
    near = tile_links(tiles, "embed-settled", [0], partial(_close, apart=apart),
                      partial(_candidates, threshold=threshold))
    maybe = components(near, "embed-candidates")
    full = classes.join(maybe, F.col("fp") == F.col("node")).select(
        F.col("root").alias("band"), F.lit(0.0).alias("pos"), "fp", "root", "copies", "vector")
    exact = cut_tiles(full, "embed-exact", ["band", "fp"], split_bands=False, tile_rows=tile_rows // 2)
    found = stage(tile_links(exact, "embed-verified", [0], anywhere, partial(_exact, threshold=threshold)), "embed-links")
    roots = components(found.select("a", "b"), "embed-components")
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    per_class = (classes.select("k1", "k2", "fp", "copies", "first_id").join(roots, F.col("fp") == F.col("node"), "left")
                 .join(links, F.col("fp") == F.col("a"), "left")
                 .select("k1", "k2", F.coalesce("root", "fp").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                         "first_id"))
    per_class = stage(per_class, "embed-per-class")
    lowest = per_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # staged, so that a class with very many copies is a skewed join that can be split
    by_class = stage(per_class.join(lowest, "root").select("k1", "k2", "links", "component_id"), "embed-by-class")
    out = keyed.join(by_class, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
