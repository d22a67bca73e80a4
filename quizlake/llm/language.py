"""Language identification by prediction by partial matching (operator 9).

Training counts, for each language, the bytes that follow every context of up to
three bytes, over a bounded sample of labelled documents (``sample_rows`` a
language, drawn by a hash of the id; counted by Spark, summed by n-gram; so the
model has at most 3 x sample bytes / ``least`` contexts). The frozen model is a tree of variable-order contexts: a context stays if it was
seen ``least`` times. In a context, a language codes a byte it has seen there by
its count over (total + distinct), and escapes with distinct / (total + distinct)
to the next shorter context otherwise, among the bytes not seen in the longer
one. A text is given the language with the shortest exact code length.

Contexts are looked up in a table by the last three bytes, and code lengths in a
table by context and byte, so each task scores whole texts with array operations.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text if nothing was learned; contexts begin anew with each text; ties go
to the first language by name; rows with a null label or text are not learned
from; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, small_parts

ORDER, PAD = 3, b"\n\n\n"
SAMPLE_ROWS = 3000   # labelled rows a language, expected
LEAST = 12           # times a context was seen, in all languages; each such context is kept
GRAMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _count(batches):
    """Counts of the 4-byte strings (context and byte) of each language in a task."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for p in small_parts(b, 1, 1 << 20):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(PAD + text.encode())
            for lang, texts in by_lang.items():
                x = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
                gram = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
                ends = np.cumsum([len(t) for t in texts])
                inside = np.ones(len(gram), dtype=bool)
                for k in (1, 2, 3):  # not across two texts
                    inside[ends[:-1] - k] = False
                g, n = np.unique(gram[inside], return_counts=True)
                if lang in totals:
                    g, at = np.unique(np.concatenate([totals[lang][0], g]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([totals[lang][1], n])).astype(np.int64)
                totals[lang] = (g, n)
    for lang, (g, n) in totals.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g, pa.int64()),
                                          "n": pa.array(n, pa.int64())})


class Model:
    """Frozen code lengths (bits) by context and symbol, for every language."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], least: int = LEAST):
        self.langs = langs
        freq = np.zeros(256)
        for g, n in grams:
            freq += np.bincount(g & 255, weights=n, minlength=256)
        freq[PAD[0]] += 1
        own = np.flatnonzero(freq)  # the bytes that were seen; those never seen have equal statistics and share one symbol
        rest_bytes = 256 - len(own)
        self.size = a = len(own) + (rest_bytes > 0)
        self.symbol = np.full(256, a - 1, dtype=np.uint8)
        self.symbol[own] = np.arange(len(own), dtype=np.uint8)
        parts = []  # (context of three symbols, symbol, n) per language
        for g, n in grams:
            s = [self.symbol[(g >> k) & 255].astype(np.int64) for k in (24, 16, 8, 0)]
            parts.append(((s[0] * a + s[1]) * a + s[2], s[3], n.astype(np.float64)))
        contexts = [None]
        for k in (2, 3):
            total = np.zeros(a ** k)
            for c, _, n in parts:
                total += np.bincount(c % a ** k, weights=n, minlength=a ** k)
            contexts.append(np.flatnonzero(total >= least))
        one, two, three = np.arange(a), contexts[1], contexts[2]
        at2 = np.full(a * a, -1, dtype=np.int32)
        at2[two] = a + np.arange(len(two))
        three = three[at2[three % (a * a)] >= 0]
        base = np.where(at2 >= 0, at2, np.tile(one, a)).astype(np.int32)
        self.node = np.tile(base, a)
        self.node[three] = a + len(two) + np.arange(len(three))
        bits = []
        for c, s, n in parts:
            def counts(keys, k, c=c, s=s, n=n):
                place = np.full(a ** k, -1, dtype=np.int64)
                place[keys] = np.arange(len(keys))
                row = place[c % a ** k]
                ok = row >= 0
                return np.bincount(row[ok] * a + s[ok], weights=n[ok], minlength=len(keys) * a).reshape(len(keys), a)
            p = _escape(np.bincount(s, weights=n, minlength=a)[None, :], np.full((1, a), 1.0 / a))
            p1 = _escape(counts(one, 1), np.repeat(p, a, axis=0))
            p2 = _escape(counts(two, 2), p1[two % a]) if len(two) else np.zeros((0, a))
            p3 = _escape(counts(three, 3), p2[at2[three % (a * a)] - a]) if len(three) else np.zeros((0, a))
            lengths = -np.log2(np.concatenate([p1, p2, p3]))
            if rest_bytes:
                lengths[:, a - 1] += np.log2(rest_bytes)  # which of the rest
            bits.append(lengths.reshape(-1))
        self.bits = np.stack(bits, axis=1).astype(np.float32)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        table = self.symbol.tobytes()
        x = np.frombuffer((PAD + PAD.join(texts)).translate(table), dtype=np.uint8).astype(np.int32)
        a = self.size
        context = (x[:-3] * a + x[1:-2]) * a + x[2:-1]
        cost = self.bits[self.node[context] * a + x[3:]]
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size + ORDER) - size - ORDER
        marks = np.stack([start, start + size], axis=1).reshape(-1)
        cost = np.concatenate([cost, np.zeros((1, len(self.langs)), np.float32)])
        out = np.add.reduceat(cost, marks, axis=0, dtype=np.float64)[::2]
        out[size == 0] = 0
        return out


def _escape(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of all symbols in contexts with counts n, given those in the
    next shorter contexts."""
    total, seen = n.sum(axis=1, keepdims=True), n > 0
    distinct = seen.sum(axis=1, keepdims=True)
    unseen = np.where(seen, 0.0, shorter)
    left = unseen.sum(axis=1, keepdims=True)
    escape = np.where((left > 0) & (total > 0), distinct, 0)
    whole = np.maximum(total + escape, 1)
    p = np.where(seen, n / whole, escape / whole * unseen / np.where(left > 0, left, 1))
    return np.where(total > 0, p, shorter)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 9, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model | None:
    """A model from (id, text, language) rows; None if there are none. The driver
    receives one row a language and the n-gram counts of the bounded sample."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*(F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, sample_rows / n))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    got = map_arrow(sample, _count, GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (got.column(k).combine_chunks() for k in range(3))
    names = sorted(set(lang.to_pylist()))
    of = np.array(lang.to_pylist())
    return Model(names, [(gram.to_numpy()[of == x], n.to_numpy()[of == x]) for x in names]) if names else None


def _score(batches, model):
    m = model.value
    for b in batches:
        for p in small_parts(b, 1, 1 << 20):
            letter = p.column(2).to_numpy(zero_copy_only=False).astype(bool)
            texts = [(t or "").encode() for t in p.column(1).to_pylist()]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if m is not None and letter.any():
                bits = m.lengths(texts)
                best = bits.argmin(axis=1)
                sure = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                pred = [m.langs[k] if ok else "und" for k, ok in zip(best, letter, strict=True)]
                score = np.where(letter, sure, 0.0)
            yield pa.RecordBatch.from_pydict({"doc_id": p.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's share of probability under equal
    priors) per document; the model, of bounded size, is broadcast."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letter"))
    return map_arrow(rows, _score, SCORED, model=docs.sparkSession.sparkContext.broadcast(model))
