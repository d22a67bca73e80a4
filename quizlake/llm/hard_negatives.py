"""Hard negatives by shared lists of anchor clusters (operator 11).

Anchors are put into clusters: blocks of anchors of one label that lie close
together. For a cluster with unit centre c and largest angle b between c and a
member, every candidate i has one upper bound for all members,

    u.i  <=  |u| * |i| cos(max(0, angle(c, i) - b)),

so the candidates are sorted by |i| cos(...) once a cluster, and every member walks
that one list until the bound at its place, times its own norm, is below what it
still needs: from there on nothing can enter its result (certified termination).

A list is cut over the candidate tiles: cells (pack of clusters x shard of tiles)
hold the clusters and stream the tiles, so that a tile goes once to each pack, no
task holds a whole list, and each cell's few best rows are merged afterwards.
Two passes: the best rows of the anchor's own label (positives), then, for each
positive, the best rows of other labels in its window of scores.

Defined cases: rows with a null id, label or vector, or with null or non-finite
components, take no part; rows with the anchor's id are the anchor itself; equal
repeated anchors are one anchor, other repeated rows count each; vectors of unlike
length are no candidates of each other; scaled components are held within +-2^26,
so that scores of up to 2,048 components are exact whole numbers; other columns
are ignored; an empty table, or one without anchors, gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage
from .common import cut_tiles, grid_cells, map_arrow, read_block

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
MOST = 1 << 26
SAMPLE_ROWS, CENTRES = 4096, 64  # anchors the cluster centres are fitted on (they only order the rows), and how many centres
CLUSTER_ROWS, TILE_ROWS, STEP = 256, 2048, 512

ROWS = T.StructType([T.StructField("band", T.LongType()), T.StructField("pos", T.DoubleType()), T.StructField("vec_id", T.LongType()),
                     T.StructField("q", T.BinaryType())])
FOUND = T.StructType([T.StructField("tile", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("window", T.IntegerType()),
                      T.StructField("anchor_id", T.LongType()), T.StructField("found_id", T.LongType()), T.StructField("score", T.LongType())])


def scaled(x, scale: float) -> np.ndarray:
    """Whole components of a vector of doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * np.asarray(x, dtype=np.float64)), -MOST, MOST).astype(np.int32)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-300)


def centres(vectors: list[np.ndarray], k: int = CENTRES, rounds: int = 8) -> dict[int, np.ndarray]:
    """Unit centres for each vector length, by a few rounds of spherical k-means."""
    out = {}
    for d in sorted({len(v) for v in vectors}):
        u = _unit(np.stack([v for v in vectors if len(v) == d]))
        c = u[np.linspace(0, len(u) - 1, min(k, len(u))).astype(int)]
        for _ in range(rounds):
            near = (u @ c.T).argmax(axis=1) if d else np.zeros(len(u), int)
            c = np.stack([_unit(u[near == j].sum(axis=0)) if (near == j).any() else c[j] for j in range(len(c))])
        out[d] = c
    return out


def _scaled_rows(batches, scale, means):
    """Rows with whole components; `pos` orders them by length, centre and angle."""
    for b in batches:
        q = [scaled(x, scale) for x in b.column(2).to_pylist()]
        pos = np.zeros(b.num_rows)
        lengths = np.array([len(x) for x in q], dtype=np.int64)
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            pos[rows] = 1000 * d
            if d in means:
                cos = _unit(np.stack([q[r] for r in rows])) @ means[d].T
                near = cos.argmax(axis=1)
                pos[rows] += near + np.arccos(np.clip(cos[np.arange(len(rows)), near], -1, 1)) / 4
        yield pa.RecordBatch.from_pydict({"band": b.column(0).cast(pa.int64()), "pos": pos, "vec_id": b.column(1).cast(pa.int64()),
                                          "q": pa.array([x.tobytes() for x in q], pa.binary())})


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole products of the rows of two int32 blocks: by doubles where every
    sum stays below 2^53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Cluster:
    """Anchors of one block and length, their windows (scores from ``low`` to ``high``)
    and the best rows found so far in each."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int):
        self.row, self.ids, self.q, self.low, self.high = row, ids, q, low, high
        v = q.astype(np.float64)
        self.norm = np.sqrt((v * v).sum(axis=1))
        unit = _unit(v)
        self.centre = _unit(unit.sum(axis=0))
        self.reach = float(np.arccos(np.clip(unit @ self.centre, -1, 1)).max(initial=0.0)) + 1e-7
        self.best = np.full((len(ids), low.shape[1], keep), LOWEST)
        self.found = np.full(self.best.shape, HIGHEST)

    def need(self) -> np.ndarray:
        """The least score that could still change some window of each member."""
        open_low = np.where(self.low <= self.high, np.maximum(self.low, self.best[:, :, -1]), HIGHEST)
        return open_low.min(axis=1)

    def walk(self, ids: np.ndarray, q: np.ndarray) -> int:
        """All members walk the list of these rows; how many rows were walked."""
        v = q.astype(np.float64)
        norm = np.sqrt((v * v).sum(axis=1))
        angle = np.arccos(np.clip(v @ self.centre / np.maximum(norm, 1e-300), -1, 1))
        bound = norm * np.cos(np.maximum(0, angle - self.reach))
        order = np.argsort(-bound, kind="stable")
        top = self.high.max(axis=1)
        for s in range(0, len(order), STEP):
            head, need = bound[order[s]], self.need()
            limit = self.norm * head
            on = np.flatnonzero(limit + 1e-6 * np.abs(limit) + 1e-3 >= need.astype(np.float64))
            if not len(on):
                return s
            some = order[s:s + STEP]
            score = products(self.q[on], q[some])
            m, c = np.nonzero((score >= need[on][:, None]) & (score <= top[on][:, None]) & (ids[some][None, :] != self.ids[on][:, None]))
            if len(m):
                self._take(on[m], score[m, c], ids[some][c])
        return len(order)

    def _take(self, member: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = self.best.shape[2]
        for w in range(self.low.shape[1]):
            fits = (score >= np.maximum(self.low[member, w], self.best[member, w, -1])) & (score <= self.high[member, w])
            if not fits.any():
                continue
            who = np.unique(member[fits])
            m = np.concatenate([np.repeat(who, keep), member[fits]])
            x = np.concatenate([self.best[who, w].ravel(), score[fits]])
            i = np.concatenate([self.found[who, w].ravel(), ids[fits]])
            order = np.lexsort((i, ~x, m))  # ~x: descending without overflow
            m, x, i = m[order], x[order], i[order]
            rank = np.arange(len(m)) - np.searchsorted(m, m)
            first = rank < keep
            self.best[m[first], w, rank[first]] = x[first]
            self.found[m[first], w, rank[first]] = i[first]

    def results(self, tile: int):
        m, w, k = np.nonzero(self.best > LOWEST)
        return pa.RecordBatch.from_pydict({
            "tile": pa.array(np.full(len(m), tile), pa.int64()), "row": pa.array(self.row[m], pa.int32()), "window": pa.array(w + 1, pa.int32()),
            "anchor_id": pa.array(self.ids[m], pa.int64()), "found_id": pa.array(self.found[m, w, k], pa.int64()),
            "score": pa.array(self.best[m, w, k], pa.int64())})


def _by_length(block: pa.RecordBatch):
    """(row numbers, ids, whole components) for each vector length of a block."""
    ids, q = block.column(block.schema.get_field_index("vec_id")).to_numpy(), block.column(block.schema.get_field_index("q")).to_pylist()
    lengths = np.array([len(x) // 4 for x in q], dtype=np.int64)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, ids[rows], np.frombuffer(b"".join([q[r] for r in rows]), dtype=np.int32).reshape(len(rows), d)


def _walk_cells(batches, keep, windows, share):
    """Each cell's clusters (kind 0, they come first) walk its tiles (kind 1)."""
    cell, pack = None, []

    def finish():
        for _, tile, cluster in pack:
            out = cluster.results(tile)
            if out.num_rows:
                yield out

    for b in batches:
        for r in range(b.num_rows):
            key, pack_no, shard, kind, tile, band, rows, scores = (c[r].as_py() for c in b.columns)
            if (key, pack_no, shard) != cell:
                yield from finish()
                cell, pack = (key, pack_no, shard), []
            block = read_block(rows)
            for d, at, ids, q in _by_length(block):
                if kind == 0:
                    low, high = np.full((len(at), windows), LOWEST + 1), np.full((len(at), windows), HIGHEST)
                    if share is not None:
                        low, high = _windows(at, block.num_rows, scores, windows, share)
                    pack.append((band, tile, Cluster(at, ids, q, low, high, keep)))
                else:
                    for label, _, cluster in pack:
                        if (label == band) == (share is None) and cluster.q.shape[1] == d:
                            cluster.walk(ids, q)
    yield from finish()


def _windows(at, n_rows, scores, windows, share):
    """Lowest and highest score of the window of each positive of the rows ``at``;
    an empty window (low above high) where there is none."""
    low, high = np.zeros((n_rows, windows), np.int64), np.full((n_rows, windows), -1, np.int64)
    for s in scores or []:
        p = s["score"]
        low[s["row"], s["window"] - 1], high[s["row"], s["window"] - 1] = -(-share[0] * p // share[1]), p
    return low[at], high[at]


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("tile", "row", "window").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
                   scale: float = 256.0, cluster_rows: int = CLUSTER_ROWS, tile_rows: int = TILE_ROWS, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    anchor (rows where ``is_anchor``, a condition on vec_id and label, holds) and each
    of its ``positives`` best rows of the same label, the ``negatives`` best rows of
    other labels whose score is at least ``share`` of the positive's and not above it.
    Scores are products of the vectors in whole ``1/scale`` steps."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                          F.col(f"`{vector_col}`").alias("vector"))
    bad = F.exists(F.transform("vector", lambda x: x.cast("double")), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    anchors = rows.where(is_anchor).dropDuplicates(["vec_id", "label", "vector"])
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("vector").collect()  # bounded
    means = centres([scaled(r.vector, scale) for r in sample])

    def tiles(df, name, size):
        wide = map_arrow(df.select("label", "vec_id", "vector"), _scaled_rows, ROWS, scale=scale, means=means)
        return cut_tiles(wide, name, ["band", "pos", "vec_id"], tile_rows=size)

    clusters, lists = tiles(anchors, "negatives-anchors", cluster_rows), tiles(rows, "negatives-lists", tile_rows)
    none = F.lit(None).cast("array<struct<row:int,window:int,score:bigint>>")
    own = grid_cells(clusters.withColumn("scores", none), lists, "scores", same_band=True)
    first = _best(map_arrow(own, _walk_cells, FOUND, keep=positives, windows=1, share=None), positives)
    first = stage(first.select("tile", "row", F.col("rank").alias("window"), "anchor_id", F.col("found_id").alias("positive_id"),
                               F.col("score").alias("positive_score")), "negatives-positives")
    scores = first.groupBy("tile").agg(F.collect_list(F.struct("row", "window", F.col("positive_score").alias("score"))).alias("scores"))
    other = grid_cells(clusters.join(scores, "tile"), lists, "scores", same_band=False)
    second = _best(map_arrow(other, _walk_cells, FOUND, keep=negatives, windows=positives, share=share), negatives)
    return (second.join(first.drop("anchor_id"), ["tile", "row", "window"])
            .select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
