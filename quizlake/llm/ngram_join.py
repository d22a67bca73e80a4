"""N-gram Jaccard join over size-banded tiles (operator 4).

1. Each text becomes its set of word n-gram hashes (64 bits). Documents with
   equal sets form a class; only one document a class goes on.
2. A class gets a bitmap: bit h mod B is the parity of its hashes that fall
   there. Bits in which two bitmaps differ need a hash that only one set holds,
   so the overlap is at most (|A| + |B| - differing bits) / 2.
3. Tiles hold the bitmaps of classes of like size. Tiles whose size intervals
   allow the threshold are paired; pairs of classes whose bound reaches it are
   candidates. Tiles and tile pairs return a spanning forest of their candidates.
4. Within the components of candidates the sorted hash arrays are intersected
   exactly, again tile by tile; classes known to be in one component are not
   compared again. The components of these links are the result.

Nothing is capped: a group of any size is cut into tiles, and what a tile pair
returns is bounded by its rows. Defined cases: null texts and texts without
words have an empty set and no link; shorter texts are one shingle; repeated rows
share a class; a null id is never the smallest of its component (null if all
are); other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import struct
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .common import anywhere, components, cut_tiles, map_arrow, small_parts, tile_links

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
MEMO_ENTRIES = 100_000  # words of one task (memory bound only)
_WORDS: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    memo = _WORDS
    new = set(words).difference(memo)
    if len(memo) + len(new) > MEMO_ENTRIES:
        memo.clear()
        new = set(words)
    for w in new:
        memo[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text; its words
    are split at ASCII white space and A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = _word_hashes(words)
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _scramble(out * MIX[2] + h[k:len(h) - width + 1 + k] + MIX[3])
    return np.unique(out)


def sketch_bits(n: int, threshold: tuple[int, int]) -> int:
    """Bitmap length for a set of n: a power of two, about five times the largest
    difference of a linked pair, so that unrelated pairs differ in far more bits."""
    p, q = threshold  # linked: q * intersection >= p * union
    most = 2 * n * (q - p) / (q + p)
    return max(256, 1 << math.ceil(math.log2(max(1.0, 4.75 * most))))


def sketch(hashes: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()),
                     T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                     T.StructField("sketch", T.BinaryType())])
SETS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("hashes", T.BinaryType())])


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others, as two numbers."""
    return struct.unpack("<qq", hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())


def _shingle(batches, n, threshold):
    _WORDS.clear()  # idle workers should not hold it
    for b in batches:
        for p in small_parts(b, 2):
            size, keys, sk = [], [], []
            for text in p.column(2).to_pylist():
                h = shingle_hashes(text, n)
                size.append(len(h))
                keys.append(_fingerprint(h) if len(h) else (None, None))
                sk.append(sketch(h, sketch_bits(len(h), threshold)) if len(h) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": p.column(0), "text_key": p.column(1), "n_shingles": pa.array(size, pa.int64()),
                                              "k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64()),
                                              "sketch": pa.array(sk, pa.binary())})
    _WORDS.clear()


def _sets(batches, n):
    for b in batches:
        for p in small_parts(b, 3):
            fp, k1, k2, texts = (c.to_pylist() for c in p.columns)
            got = [shingle_hashes(t, n) for t in texts]
            ok = [(k, h) for k, *key, h in zip(fp, k1, k2, got, strict=True) if len(h) and _fingerprint(h) == tuple(key)]
            yield pa.RecordBatch.from_pydict({"fp": pa.array([k for k, _ in ok], pa.int64()),
                                              "hashes": pa.array([h.tobytes() for _, h in ok], pa.binary())})
    _WORDS.clear()


def _bitmaps(block: pa.RecordBatch):
    """Size and bitmap of a tile's classes, smallest size first."""
    col = {n: block.column(k) for k, n in enumerate(block.schema.names)}
    return col["n_shingles"].to_numpy(), col["sketch"].to_pylist()


def _folded(raw: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of any length folded by XOR to ``words`` 64-bit words, as words x rows."""
    out = np.empty((words, len(raw)), dtype=np.uint64)
    lengths = np.array([len(x) for x in raw])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join(raw[r] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
        while x.shape[1] > words:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
        out[:, rows] = x.T
    return out


def _candidates(left, right, forest, threshold):
    """Links classes whose bitmaps leave the threshold possible."""
    p, q = threshold
    same = right is None
    ls, lraw = _bitmaps(left)
    rs, rraw = (ls, lraw) if same else _bitmaps(right)
    base = 0 if same else len(ls)
    words = min(min(map(len, lraw)), min(map(len, rraw))) // 8
    lw, rw = _folded(lraw, words), _folded(rraw, words)
    # a linked pair has q * min(size) >= p * max(size)
    begin, end = np.searchsorted(rs * q, ls * p), np.searchsorted(rs * p, ls * q, side="right")
    for i in range(len(ls)):
        s, e = (max(i + 1, begin[i]) if same else begin[i]), end[i]
        if s >= e:
            continue
        differ = np.zeros(e - s, dtype=np.uint16 if words < 1000 else np.uint32)
        for w in range(words):
            differ += np.bitwise_count(rw[w, s:e] ^ lw[w, i])
        both = rs[s:e] + ls[i]
        most = np.minimum((both - differ) >> 1, np.minimum(rs[s:e], ls[i]))
        hits = np.flatnonzero((p + q) * most >= p * both)
        if len(hits):
            forest.link(i, base + s + hits)


def _verified(left, right, forest, threshold):
    """Links classes of one candidate component whose sets reach the threshold."""
    p, q = threshold
    tiles = [left] if right is None else [left, right]
    root = np.concatenate([t.column(t.schema.get_field_index("root")).to_numpy() for t in tiles])
    sets = [np.frombuffer(x, dtype=np.uint64) for t in tiles for x in t.column(t.schema.get_field_index("hashes")).to_pylist()]
    size = np.array([len(x) for x in sets])
    for i in range(left.num_rows):
        s = i + 1 if right is None else left.num_rows
        others = s + np.flatnonzero(root[s:] == root[i])
        others = others[(q * np.minimum(size[others], size[i]) >= p * np.maximum(size[others], size[i]))]
        others = forest.unlinked(i, others)
        for part in np.array_split(others, -(-len(others) // 512)) if len(others) else ():
            part = forest.unlinked(i, part)
            if len(part):
                flat = np.concatenate([sets[j] for j in part])
                at = np.searchsorted(sets[i], flat)
                hit = sets[i][np.minimum(at, size[i] - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[part]) - size[part])
                forest.link(i, part[q * both >= p * (size[part] + size[i] - both)])


def ngram_groups(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (90, 100), tile_rows: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, root (component; null with an
    empty set) per document."""
    p, q = threshold
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    sets = stage(map_arrow(rows, _shingle, ROWS, n=n, threshold=threshold), "ngram-rows")
    classes = sets.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = stage(classes.withColumn("fp", F.monotonically_increasing_id()), "ngram-classes")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(q / p)))
    tiles = cut_tiles(classes.select(band.cast("long").alias("band"), F.col("n_shingles").cast("double").alias("pos"), "fp",
                                     "n_shingles", "sketch"), "ngram-tiles", ["n_shingles", "fp"], tile_rows=tile_rows)
    # one band is one step of the threshold; the second neighbour covers rounding
    near = tile_links(tiles, "ngram-settled", [0, 1, 2], partial(_like_size, threshold=threshold), partial(_candidates, threshold=threshold))
    maybe = components(near, "ngram-candidates")
    reps = classes.join(maybe, F.col("fp") == F.col("node")).select("of", "k1", "k2", "fp", "root")
    again = (rows.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
             .join(reps, F.col("_id").eqNullSafe(F.col("of.doc_id")) & (F.col("_key") == F.col("of.text_key")))
             .select("fp", "k1", "k2", "text"))
    hashes = map_arrow(again, _sets, SETS, n=n).dropDuplicates(["fp"])
    whole = stage(hashes.join(reps.select("fp", "root"), "fp"), "ngram-sets")
    exact = cut_tiles(whole.select(F.col("root").alias("band"), F.lit(0.0).alias("pos"), "fp", "root", "hashes"), "ngram-exact",
                      ["root", "fp"], split_bands=False, tile_rows=1024)
    links = tile_links(exact, "ngram-verified", [0], anywhere, partial(_verified, threshold=threshold))
    found = components(links, "ngram-links")
    per_class = stage(classes.select("k1", "k2", "fp").join(found, F.col("fp") == F.col("node"), "left")
                      .select("k1", "k2", F.coalesce("root", "fp").alias("root")), "ngram-by-class")
    return sets.join(per_class, ["k1", "k2"], "left").select("doc_id", "text_key", "n_shingles", "root")


def _like_size(l, r, threshold: tuple[int, int]):  # noqa: E741
    """Whether sets of the two size intervals can be linked."""
    p, q = threshold
    return (l("hi") * q >= r("lo") * p) & (r("hi") * q >= l("lo") * p)


def ngram_join(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) per document."""
    g = stage(ngram_groups(docs, n, threshold, id_col=id_col, text_col=text_col), "ngram-result")
    first = stage(g.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "ngram-first")
    return (g.join(first, "root", "left")
            .select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but one document of each component (that with
    the smallest id, then text hash; repeated rows count once). Documents with an
    empty set all stay."""
    g = stage(ngram_groups(docs, n, threshold, id_col=id_col, text_col=text_col), "ngram-result")
    grouped = g.where("root is not null")
    keep = (grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("of"))
            .select(F.coalesce("of.doc_id", F.lit(0)).alias("id"), F.col("of.none").alias("none"), F.col("of.text_key").alias("key")))
    empty = F.length(F.btrim(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) == 0
    # rows with the same id and text become the one with the smallest hash of all columns, in the tasks first, and
    # stay where the shuffle put them for the join
    every = [F.col(f"`{c}`") for c in docs.columns]
    doc_id = F.col(f"`{id_col}`").cast("long")
    once = (docs.where(~empty).groupBy(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
            .agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("row")))
    kept = once.join(keep, ["id", "none", "key"])
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)).unionByName(docs.where(empty))
