"""Token ids in patched frame-of-reference files (operator 5).

A file is a Parquet table of segments (Spark's committed writer, so a lost
executor leaves no half-written file and any store that Spark writes will do).
A segment holds whole documents in order:

    magic PFR1, ids, documents, blocks            4 bytes and three u64
    document index: id i64, null flag u8, end u64 (each as an array)
    block index: start of each block in the body  u64, one more than blocks
    body: for each block of 128 ids
        minimum u32, width u8, exceptions u8
        128 values less the minimum, their low `width` bits, 16 * width bytes
        exceptions: positions u8 each, then values less the minimum u32 each

The width is that of the block's 90th percentile; values that need more bits are
exceptions. Any block can be read by itself through the index.

Defined cases: a null or empty text has the end id alone; null ids come first;
documents with the same id are ordered by a hash of the text; other columns are
ignored; an empty table gives files without segments and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import kept_in_worker, map_arrow, small_parts

MAGIC, BLOCK, HEAD = b"PFR1", 128, struct.Struct("<4sQQQ")
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 18  # a segment ends with the document that reaches this
MEMO_ENTRIES = 600_000  # units kept per worker (memory bound only)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)  # 0 for 0


def _places(w: int):
    """(number, word of 64 bits, shift) of the values of ``w`` bits of a block."""
    return [(j, j * w // 64, j * w % 64) for j in range(BLOCK)]


def _pack_bits(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of 16 * w bytes with the low ``w`` bits of the 128 values of each row."""
    v = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << w) - 1)
    words = np.zeros((BLOCK * w // 64, v.shape[1]), dtype=np.uint64)
    for j, k, shift in _places(w):
        words[k] |= v[j] << np.uint64(shift)
        if shift + w > 64:
            words[k + 1] |= v[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def _unpack_bits(packed: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").T)
    v = np.empty((BLOCK, words.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << w) - 1)
    for j, k, shift in _places(w):
        x = words[k] >> np.uint64(shift)
        if shift + w > 64:
            x = x | words[k + 1] << np.uint64(64 - shift)
        v[j] = x & mask
    return v.T


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(block starts, body) of an array of u32."""
    blocks = -(-len(ids) // BLOCK)
    v = np.empty(blocks * BLOCK, dtype=np.uint32)
    v[: len(ids)] = ids
    v[len(ids):] = ids[-1] if len(ids) else 0
    v = v.reshape(blocks, BLOCK)
    low = v.min(axis=1, initial=2**32 - 1) if blocks else np.zeros(0, np.uint32)
    d = v - low[:, None]
    width = _bits(np.sort(d, axis=1)[:, int(PERCENTILE * (BLOCK - 1))])
    over = d > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    n_over = over.sum(axis=1)
    size = 6 + BLOCK // 8 * width.astype(np.int64) + 5 * n_over
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    body = np.zeros(int(start[-1]), dtype=np.uint8)
    at = start[:-1]
    body[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    body[at + 4], body[at + 5] = width, n_over
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for part in np.array_split(rows, -(-len(rows) // 4096)):
                packed = _pack_bits(d[part], int(w))
                body[at[part][:, None] + 6 + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(over)
    rank = np.arange(len(block)) - np.searchsorted(block, block)
    tail = at[block] + 6 + BLOCK // 8 * width[block].astype(np.int64)
    body[tail + rank] = place
    values = d[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(tail + n_over[block] + 4 * rank)[:, None] + np.arange(4)] = values
    return start, body.tobytes()


def unpack(start: np.ndarray, body, n: int) -> np.ndarray:
    """The first ``n`` ids of the blocks that begin at start[:-1]."""
    b, at = np.frombuffer(body, dtype=np.uint8), start[:-1].astype(np.int64)
    low = b[at[:, None] + np.arange(4)].copy().view("<u4").reshape(-1) if len(at) else np.zeros(0, np.uint32)
    width, n_over = b[at + 4], b[at + 5].astype(np.int64)
    d = np.zeros((len(at), BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 4096)):
            d[part] = _unpack_bits(b[at[part][:, None] + 6 + np.arange(BLOCK // 8 * int(w))], int(w))
    block = np.repeat(np.arange(len(at)), n_over)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    tail = at[block] + 6 + BLOCK // 8 * width[block].astype(np.int64)
    place = b[tail + rank]
    d[block, place] = b[(tail + n_over[block] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1) if len(block) else 0
    return (d + low[:, None]).reshape(-1)[:n]


def write_segment(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    start, body = pack(ids)
    end = np.cumsum([len(x) for x in docs]).astype("<u8")
    key = np.array([x or 0 for x in doc_ids], dtype="<i8")
    null = np.array([x is None for x in doc_ids], dtype=np.uint8)
    return b"".join([HEAD.pack(MAGIC, len(ids), len(docs), len(start) - 1), key.tobytes(), null.tobytes(), end.tobytes(),
                     start.astype("<u8").tobytes(), body])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, end of each document, all ids)."""
    magic, n, docs, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEAD.size
    key = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    end = np.frombuffer(data, "<u8", docs, at := at + docs).astype(np.int64)
    start = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs)
    ids = unpack(start, memoryview(data)[at + 8 * (blocks + 1):], n)
    return [None if z else int(k) for k, z in zip(key, null, strict=True)], end, ids


def read_ids(data: bytes, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a segment, reading only the blocks that
    hold them: their places come from the block index."""
    magic, n, docs, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    first, last = max(0, first), min(n, last)
    if first >= last:
        return np.zeros(0, np.uint32)
    at = HEAD.size + 17 * docs
    k, end = first // BLOCK, -(-last // BLOCK)
    start = np.frombuffer(data, "<u8", end - k + 1, at + 8 * k).astype(np.int64)
    body = memoryview(data)[at + 8 * (blocks + 1):][start[0]:start[-1]]
    return unpack(start - start[0], body, (end - k) * BLOCK)[first - k * BLOCK:last - k * BLOCK]


_SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SYMBOL, _WORD = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True  # not ' (contractions), nor < | > (names of special tokens)
_WORD[list(range(0x61, 0x7B)) + list(range(0x30, 0x3A))] = True


def _apart(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A folded text with a space put before the symbols that end a unit, where they
    follow an ASCII letter or digit or a Latin-1 letter (a token always ends there), and
    the places of these spaces. The text ends with a space."""
    symbol = _SYMBOL[text]
    p = np.flatnonzero(symbol[1:] & ~symbol[:-1]) + 1
    last, before = text[p - 1], text[np.maximum(p - 2, 0)]
    p = p[_WORD[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]
    other = np.flatnonzero(~symbol)  # the run of symbols ends with a space
    p = p[text[other[np.searchsorted(other, p)]] == 32]
    return np.insert(text, p, 32), p


def _encode(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class UnitEncoder:
    """Whole texts by a tokenizer that drops white space and case: no token spans a
    space or line end, so the units between them are encoded once each, A-Z
    lower-cased. A part's units are dictionary-encoded in one array; each different
    unit has its ids in one flat table, and the part's ids are gathered from there."""

    def __init__(self, tokenizer_json: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        bare = json.loads(tokenizer_json) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.bare = Tokenizer.from_str(json.dumps(bare))  # the same merges; nothing else acts on lower-case ASCII letters
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a word
        self.closing[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.units: dict[bytes, int] = {b" ": 0}  # number of each unit (with its space)
        self.table, self.start = np.zeros(0, np.uint32), np.zeros(2, np.int64)  # ids of unit k: start[k] to start[k + 1]

    def _learn(self, units: pa.Array) -> None:
        """New units get the next numbers. Those of letters alone are encoded many to a
        text and told apart by their closing tokens."""
        plain = pc.utf8_is_alpha(pc.utf8_rtrim(units, " "))
        ascii_only = pc.and_(plain, pc.string_is_ascii(units))
        other = units.filter(pc.invert(plain)).to_pylist()
        known, sizes, ids = [], [], []
        for tokenizer, chosen in ((self.bare, ascii_only), (self.tokenizer, pc.and_not(plain, ascii_only))):
            words = units.filter(chosen).to_pylist()
            groups = [words[k:k + 256] for k in range(0, len(words), 256)]
            for group, found in zip(groups, _encode(tokenizer, ["".join(g) for g in groups]), strict=True):
                ends = np.flatnonzero(self.closing[found]) + 1
                if len(ends) != len(group) or ends[-1] != len(found):
                    other += group
                    continue
                known += group
                sizes.append(np.diff(ends, prepend=0))
                ids.append(found)
        for unit, found in zip(other, _encode(self.tokenizer, other), strict=True):
            known.append(unit)
            sizes.append([len(found)])
            ids.append(found)
        at = len(self.start) - 1
        self.units.update(zip([u.encode() for u in known], range(at, at + len(known)), strict=True))
        self.table = np.concatenate([self.table, *ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate([[], *sizes]).astype(np.int64))])

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text)."""
        raw = [(t or "").encode().translate(_SPACES) + b" " for t in texts]
        text = np.frombuffer(b"".join([r if b"<|" in r else r.translate(_LOWER) for r in raw]), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        text, moved = _apart(text)
        ends += np.searchsorted(moved, ends)
        cuts = np.flatnonzero(text == 32) + 1
        offsets = np.concatenate([[0], cuts]).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        coded = units.dictionary_encode()
        values = coded.dictionary.to_pylist()
        number = [self.units.get(u, -1) for u in values]
        new = np.flatnonzero(np.array(number, dtype=np.int64) < 0)
        if len(self.units) + len(new) > MEMO_ENTRIES:
            self._forget()
            new = np.flatnonzero([u != b" " for u in values])
            number = [0] * len(values)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)).cast(pa.large_string()))
            for k in new.tolist():
                number[k] = self.units[values[k]]
        unit = np.array(number, dtype=np.int64)[coded.indices.to_numpy()]
        first, size = self.start[unit], self.start[unit + 1] - self.start[unit]
        after = np.cumsum(size)
        ids = self.table[np.repeat(first - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        return ids, after[np.searchsorted(cuts, ends)] if len(ends) else ends


_ENCODERS: dict[str, UnitEncoder] = kept_in_worker(__name__)


def _encoder(tokenizer_json: bytes) -> UnitEncoder:
    key = hashlib.sha256(tokenizer_json).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(tokenizer_json)
    return _ENCODERS[key]


SEGMENTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                         T.StructField("first_id", T.LongType()), T.StructField("n_ids", T.LongType()),
                         T.StructField("segment", T.BinaryType())])
READ = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()),
                     T.StructField("start_in_part", T.LongType()), T.StructField("n_tokens", T.LongType()),
                     T.StructField("ids_crc32", T.LongType())])


def _write(batches, tokenizer, end_id):
    enc, part = _encoder(tokenizer.value), TaskContext.get().partitionId()
    seq, first, keys, docs, held = 0, 0, [], [], 0

    def flush():
        nonlocal seq, first, keys, docs, held
        out = pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first_id": pa.array([first], pa.int64()),
            "n_ids": pa.array([held], pa.int64()), "segment": pa.array([write_segment(keys, docs)], pa.binary())})
        seq, first, keys, docs, held = seq + 1, first + held, [], [], 0
        return out

    for b in batches:
        for p in small_parts(b, 1):
            ids, ends = enc.encode_all(p.column(1).to_pylist())
            ids = np.insert(ids, ends, end_id)
            for key, x in zip(p.column(0).to_pylist(), np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1]), strict=True):
                keys.append(key)
                docs.append(x)
                held += len(x)
                if held >= SEGMENT_IDS:
                    yield flush()
    if keys:
        yield flush()


def _read(batches):
    for b in batches:
        part, first, data = (b.column(b.schema.get_field_index(c)) for c in ("part", "first_id", "segment"))
        for k in range(b.num_rows):
            keys, end, ids = read_segment(data[k].as_py())
            start = np.concatenate([[0], end[:-1]])
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part[k].as_py()] * len(keys), pa.int32()), "doc_id": pa.array(keys, pa.int64()),
                "start_in_part": pa.array(start + first[k].as_py(), pa.int64()), "n_tokens": pa.array(end - start, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[s:e]) for s, e in zip(start, end, strict=True)], pa.int64())})


def write_token_files(docs: DataFrame, path: str, tokenizer_json: bytes, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Encode whole texts and write their ids, an end id after each document, in
    ascending id order. Partition k holds the k-th range of ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)  # a vocabulary file, under 2 MB
    map_arrow(ordered, _write, SEGMENTS, tokenizer=tokenizer, end_id=end_id).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 per
    document, all read from the files."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    carry = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"))
    docs = map_arrow(files, _read, READ)
    return (docs.join(F.broadcast(carry), "part")  # at most as many rows as there were range partitions
            .select("doc_id", (F.col("carry") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"))
