"""Byte-level BPE by prefix dynamic programming (operator 1).

For every prefix of a piece of text exactly one vocabulary token can end its
encoding. ``PrefixTable`` stores that token per prefix, so the encoding of a
prefix is read by walking back, bytes are appended at the cost of the new
prefixes alone, and after an edit only the prefixes behind it are recomputed.
A token may follow another when undoing their merges from the latest on never
meets a cheaper merge across the border.

Results equal a rank-merging encoder without special tokens. Defined cases:
null and empty text give no ids; a piece that is itself a vocabulary entry is
that entry; repeated rows are encoded each; columns besides the id and the text
are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import string
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import growing_tables, kept_in_worker, map_arrow, small_parts

WORD_ENTRIES, JOINED_ENTRIES = 450_000, 150_000  # matches, and units of several, kept per worker (memory bound only)
PAIR_ENTRIES = 300_000
TAIL_ENTRIES = 100_000
PART_BYTES = 4 << 20    # of text encoded at a time
MARKS = "".join(c for c in string.punctuation if c != "'")  # a run of these behind a word is one match


class Vocabulary:
    """A rank file (base64 token, rank per line) and the merge each token ends with."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in rank_file.splitlines() if x)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.sizes = {r: len(t) for t, r in self.ranks.items()}
        self._longer: dict[bytes, set[int]] = {}  # lengths of the tokens beyond four bytes by their last four
        for t in self.ranks:
            if len(t) > 4:
                self._longer.setdefault(t[-4:], set()).add(len(t))
        self.width = max(map(len, self.ranks))
        self.tails: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte,
        (-1, -1) if no sequence of merges makes it."""
        if token not in self._parts:
            word, found = self.tokens[token], None
            if len(word) > 1:
                found = (-1, -1)
                for k in range(1, len(word)):
                    a, b = self.ranks.get(word[:k], token), self.ranks.get(word[k:], token)
                    if a < token and b < token and self.reachable(a) and self.reachable(b) and self._compatible(a, b, token):
                        found = (a, b)
                        break
            self._parts[token] = found
        return self._parts[token]

    def reachable(self, token: int) -> bool:
        return self.parts(token) != (-1, -1)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < limit:
                return False
            pa_, pb = self.parts(a), self.parts(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and a > b):
                limit, a = a, pa_[1]
            else:
                limit, b = b + 1, pb[0]

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding (a = -1: may begin one)."""
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) >= PAIR_ENTRIES:
                self._fits.clear()
            got = self._fits[a, b] = self.reachable(b) and (a < 0 or self._compatible(a, b, 1 << 40))
        return got

    def ending(self, tail: bytes) -> tuple[tuple[int, int], ...]:
        """(length, token) of all that a prefix with these last four bytes (or fewer, if
        that is all of it) may end in, longest first; a token of more bytes is still to be
        looked up (-1)."""
        if len(self.tails) >= TAIL_ENTRIES:
            self.tails.clear()
        short = [(k, self.ranks[tail[-k:]]) for k in range(len(tail), 0, -1) if tail[-k:] in self.ranks]
        got = self.tails[tail] = (*((k, -1) for k in sorted(self._longer.get(tail, ()), reverse=True)), *short)
        return got


class PrefixTable:
    """The last token of every prefix of one piece; ``ids`` reads an encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        begin = len(self.data)
        self.data += more
        return self._fill(begin)

    def _fill(self, begin: int) -> PrefixTable:
        """The last tokens of the prefixes longer than ``begin``."""
        v, last, data = self.vocabulary, self.last, self.data
        ranks, tails, known, fits = v.ranks.get, v.tails.get, v._fits.get, v.fits
        for end in range(begin + 1, len(data) + 1):
            tail = data[end - 4:end] if end > 3 else data[:end]
            for length, t in tails(tail) or v.ending(tail):
                if t < 0:
                    t = ranks(data[end - length:end], -1) if length <= end else -1
                    if t < 0:
                        continue
                before = last[end - length]
                ok = known((before, t))
                if fits(before, t) if ok is None else ok:
                    last.append(t)
                    break
            else:
                raise ValueError(f"the vocabulary lacks the byte {data[end - 1]}")
        return self

    def turn_to(self, data: bytes) -> PrefixTable:
        """Make this the table of ``data``, keeping the prefixes in common."""
        old, k = self.data, 0
        for x, y in zip(old, data, strict=False):
            if x != y:
                break
            k += 1
        self.data = data
        del self.last[k + 1:]
        return self._fill(k)

    def replace(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Put ``new`` in place of data[start:end]: prefixes up to start stay,
        and so do, moved, those behind the edit once the last tokens agree with
        the old ones over a whole token length."""
        old, old_last, shift = self.data, self.last, len(new) - (end - start)
        self.data, self.last = old[:start], old_last[: start + 1]
        self.append(new)
        width = self.vocabulary.width
        same, at = 0, end
        while at < len(old):
            self.append(old[at:at + 1])
            at += 1
            same = same + 1 if self.last[-1] == old_last[at] else 0
            if same >= width and at - end >= width:
                self.data += old[at:]
                self.last += old_last[at + 1:]
                break
        assert len(self.data) == len(old) + shift
        return self

    def ids(self, end: int | None = None) -> list[int]:
        end = len(self.data) if end is None else end
        last, sizes, out = self.last, self.vocabulary.sizes, []
        while end:
            t = last[end]
            out.append(t)
            end -= sizes[t]
        return out[::-1]


class Memo:
    """Ids by string in two generations. A full one becomes the older and the
    oldest goes, less what is asked for meanwhile: frequent strings always stay."""

    def __init__(self, entries: int):
        self.entries, self.ids, self.older = entries, {}, {}

    def missing(self, wanted: set[str]) -> set[str]:
        """Those of ``wanted`` to be learned; all others are in ``ids`` now."""
        if len(self.ids) >= self.entries // 2:
            self.ids, self.older = {}, self.ids
        absent = wanted.difference(self.ids)
        known = absent.intersection(self.older)
        self.ids.update((x, self.older[x]) for x in known)
        return absent - known


class Codec:
    """Encodes whole texts (each match of the split pattern separately) and
    decodes ids.

    ``encode_all`` cuts texts at single spaces first: a space before a character
    that is no white space always starts a match of its own, so such units can be
    split and encoded once each. A unit stands for a space and itself; most are one
    match. Matches new to the worker are encoded in sorted order: neighbours share the
    table of their common prefix.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = Vocabulary(rank_file)
        self.split = regex.compile(pattern).findall
        self.odd_space = regex.compile(r" (?:\s|$)").search
        self.words, self.joined = Memo(WORD_ENTRIES), Memo(JOINED_ENTRIES)  # by ``key`` of the match; by unit

    def encode_pieces(self, pieces) -> dict[str, tuple[int, ...]]:
        """Ids by piece."""
        table, out, ranks = PrefixTable(self.vocabulary), {}, self.vocabulary.ranks
        for piece in sorted(pieces):  # by code point, which is the order of the bytes too
            raw = piece.encode()
            whole = ranks.get(raw)
            out[piece] = (whole,) if whole is not None else tuple(table.turn_to(raw).ids())
        return out

    @staticmethod
    def key(match: str) -> str:
        """A match with its leading space taken off, or put on if it has none: a unit that is
        one match is its own key, and the key of a key is the match."""
        return match[1:] if match[0] == " " else " " + match

    def cut(self, unit: str) -> list[str]:
        """The keys of the matches in a space and a unit; a word and marks need no pattern."""
        word = unit.rstrip(MARKS)
        if word.isalpha() and word != unit:
            return [word, " " + unit[len(word):]]
        return list(map(self.key, self.split(" " + unit)))

    def unit_ids(self, units: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids by unit."""
        one = {u for u in units if u.isalpha()}
        more = units - one
        cut = {u: self.cut(u) for u in self.joined.missing(more)}
        new = self.words.missing(one.union(*cut.values()))
        words, joined = self.words.ids, self.joined.ids
        words.update((self.key(p), ids) for p, ids in self.encode_pieces(map(self.key, new)).items())
        joined.update((u, tuple(chain.from_iterable([words[k] for k in keys]))) for u, keys in cut.items())
        out = {u: words[u] for u in one}
        out.update((u, joined[u]) for u in more)
        return out

    def encode(self, text: str | None) -> list[int]:
        """One text by itself."""
        found = self.split(text or "")
        ids = self.encode_pieces(set(found))
        return list(chain.from_iterable([ids[p] for p in found]))

    def encode_all(self, texts: list[str | None]):
        """The ids of each text. Texts are split once for their units and again for their
        ids, one at a time: the units of all of them are never held together, but once each."""
        odd_space = self.odd_space
        plain = [bool(t) and t[0] != " " and not odd_space(t) for t in texts]
        wanted: set[str] = set()
        for t in compress(texts, plain):
            wanted.update(t.split(" ")[1:])
        units, first = self.unit_ids(wanted), {}
        for t, by_unit in zip(texts, plain, strict=True):
            if by_unit:
                head, *rest = t.split(" ")
                if head not in first:
                    first[head] = self.encode(head)
                yield list(chain(first[head], chain.from_iterable([units[u] for u in rest])))
            else:
                yield self.encode(t)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


_CODECS: dict[str, Codec] = kept_in_worker(__name__)


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def _encode(batches, vocabulary, pattern, keep_ids):
    with growing_tables():
        yield from _encoded(batches, vocabulary, pattern, keep_ids)


def _encoded(batches, vocabulary, pattern, keep_ids):
    c = codec(vocabulary.value, pattern)
    decimal = {i: str(i) for i in c.vocabulary.tokens}.__getitem__
    for b in batches:
        for part in small_parts(b, 1, PART_BYTES):
            n, ids_sha, raw_sha, all_ids = [], [], [], []
            for ids in c.encode_all(part.column(1).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    all_ids.append(np.array(ids, dtype=np.int32))
            out = {"doc_id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()),
                   "decoded_sha256": pa.array(raw_sha, pa.string())}
            if keep_ids:
                out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


def encode_documents(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and
    decoded_sha256 (the bytes that the ids decode to) per document; with
    ``keep_ids`` the ids as well. One pass, no shuffle; the rank file, under 1 MB,
    is broadcast."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return map_arrow(rows, _encode, schema, vocabulary=docs.sparkSession.sparkContext.broadcast(rank_file), pattern=pattern,
                     keep_ids=keep_ids)
