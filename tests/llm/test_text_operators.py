"""Operators on texts against brute force: BPE, token files, quality, PII, language, pipeline."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quizlake.llm import bpe, common, language, ngram_join, pii, quality, token_files
from quizlake.llm import queries as Q

SF, WORD = "/root/testdata/sf0.001", r"[^\x20\x09-\x0D]+"
RANKS = Q.read_bytes("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(odd_docs.selectExpr("doc_id + 100000 AS doc_id", "text"))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes_to_the_text(texts):
    enc = encoding()

    def want(r):
        ids, raw = enc.encode_ordinary(r.text or ""), (r.text or "").encode()
        return r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()
    got = bpe.encode_documents(texts, RANKS, P.PATTERN)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(map(want, texts.collect()), key=str)


def test_bpe_random_spacing_marks_and_scripts():
    enc, c, rnd = encoding(), bpe.Codec(RANKS, P.PATTERN), random.Random(1)
    alphabet = [chr(x) for x in (32, 32, 32, 10, 9, 97, 98, 0x301, 0xA0, 0x3000, 39, 115, 116, 49, 46, 0xE9, 0x1F600, 0x85, 0x1C)]
    many = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    assert list(c.encode_all(many)) == [enc.encode_ordinary(t) for t in many]


def test_bpe_words_with_marks_need_no_pattern_and_are_kept_once():
    enc, c, rnd = encoding(), bpe.Codec(RANKS, P.PATTERN), random.Random(3)
    words = ["und", "Straße", "erenesnd", "THONTION", "дом", "èque", "漢字"]
    marks = ["", ".", ",&&&", "***", "!!", ".)", "###", "%$", '"', "_", "`~"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(marks) for _ in range(40)) for _ in range(50)]
    want = [enc.encode_ordinary(t) for t in texts]
    used, split = [], c.split
    c.split = lambda x: used.append(x) or split(x)
    assert list(c.encode_all(texts)) == want
    assert not [x for x in used if x[0] == " "]  # only first words, which have no space before them
    assert len(c.words.ids) == len(words) + len(marks) - 1  # each word, each run of marks


def test_bpe_small_memos_and_odd_marks(monkeypatch):
    """Memos that turn over all the time, apostrophes, digits and line breaks behind words."""
    for name in ("WORD_ENTRIES", "JOINED_ENTRIES", "PAIR_ENTRIES", "TAIL_ENTRIES"):
        monkeypatch.setattr(bpe, name, 6)
    enc, c, rnd = encoding(), bpe.Codec(RANKS, P.PATTERN), random.Random(4)
    alphabet = list("abnettion") + ["'s", "'", "'ll", ".", "!", "²", "7", "\n", "_", "€", "é", "\u0301", "ǅ", "ª"]
    many = [" ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    for k in range(0, 400, 50):
        assert list(c.encode_all(many[k:k + 50])) == [enc.encode_ordinary(t) for t in many[k:k + 50]]


def test_bpe_holds_the_words_of_one_text_at_a_time():
    c, rnd = bpe.Codec(RANKS, P.PATTERN), random.Random(5)
    words = ["".join(rnd.choice("abnettion") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rnd.choice(words) for _ in range(15_000)) for _ in range(40)]  # 4 MB
    first = next(c.encode_all(texts[:1]))
    assert c.decode(first).decode() == texts[0]
    tracemalloc.start()
    n = sum(map(len, c.encode_all(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 600_000 and peak < 8 << 20  # 38 MB with all words as strings of their own


def test_a_worker_keeps_only_what_its_operator_needs(spark):
    class Rows:
        sparkSession = spark

        @staticmethod
        def mapInArrow(fn, schema):  # noqa: N802
            return fn
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text_key": pa.array([1], pa.int64()), "text": ["of one text"]})
    encode = common.map_arrow(Rows, bpe._encode, None, vocabulary=SimpleNamespace(value=RANKS), pattern=P.PATTERN, keep_ids=False)
    shingle = common.map_arrow(Rows, ngram_join._shingle, None, n=3, threshold=(90, 100))
    texts = batch.select(["doc_id", "text"])
    before = [x.to_pylist() for x in encode(iter([texts]))]
    held = list(bpe._CODECS.values())
    assert [x.to_pylist() for x in encode(iter([texts]))] == before and list(bpe._CODECS.values()) == held != []  # from task to task
    assert [x.column(2).to_pylist() for x in shingle(iter([batch]))] == [[1]]
    assert not bpe._CODECS
    assert [x.to_pylist() for x in encode(iter([texts]))] == before


def test_prefix_table_appends_and_edits_equal_a_new_encoding():
    v, rnd = bpe.Vocabulary(RANKS), random.Random(2)
    for _ in range(150):
        a = bytes(rnd.choice(b"abtheon in") for _ in range(60))
        i = rnd.randrange(60)
        j, new = rnd.randrange(i, 60), bytes(rnd.choice(b"theing") for _ in range(rnd.randrange(5)))
        edited, fresh = bpe.PrefixTable(v, a).replace(i, j, new), bpe.PrefixTable(v, a[:i] + new + a[j:])
        assert (edited.data, edited.last) == (fresh.data, fresh.last)
        grown = bpe.PrefixTable(v, a[:i]).append(a[i:])
        assert grown.last == bpe.PrefixTable(v, a).last and grown.ids(i) == bpe.PrefixTable(v, a[:i]).ids()


def test_token_files_equal_the_library(spark, scratch, texts):
    path, t, pos, want = scratch("tokens"), Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    token_files.write_token_files(texts, path, Q.read_bytes("word_bpe_49k.json"), 1)
    got = {}
    for r in token_files.read_token_files(spark, path).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    ordered = sorted(texts.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    for r in ordered:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, pos, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        pos += len(ids)
    assert sorted(want, key=str) == sorted(((k, *x) for k, v in got.items() for x in v), key=str)


def test_blocks_round_trip():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rnd.integers(0, 900, n).astype(np.uint32)
        ids[rnd.random(n) < 0.05] = rnd.integers(0, 2**32, dtype=np.uint64)
        start, body = token_files.pack(ids)
        assert (token_files.unpack(start, body, n) == ids).all()


def test_a_segment_is_read_by_its_block_index():
    rnd = np.random.default_rng(4)
    docs = [rnd.integers(0, 2**rnd.integers(1, 32), n).astype(np.uint32) for n in (700, 0, 1, 3000, 128, 256)]
    data, ids = token_files.write_segment([5, None, 7, 8, 9, 10], docs), np.concatenate(docs)
    assert (token_files.read_segment(data)[2] == ids).all()
    for first, last in [(0, 1), (127, 129), (128, 256), (1000, 1003), (0, len(ids)), (len(ids) - 1, len(ids) + 9), (40, 40), (-3, 2)]:
        assert (token_files.read_ids(data, first, last) == ids[max(0, first):last]).all()
    head = token_files.HEAD.size + 17 * 6  # blocks that are not asked for are not looked at
    starts = np.frombuffer(data, "<u8", -(-len(ids) // 128) + 1, head)
    body = head + 8 * len(starts)
    broken = bytearray(data)
    broken[body:body + int(starts[7])] = b"\xff" * int(starts[7])
    assert (token_files.read_ids(bytes(broken), 7 * 128, 8 * 128) == ids[7 * 128:8 * 128]).all()


def test_units_with_marks_symbols_and_special_names():
    enc = token_files.UnitEncoder(Q.read_bytes("word_bpe_49k.json"))
    rnd = random.Random(11)
    parts = ["word", "Été", "don't", "i'LL", "x1y2", "...", "$$$", "%%%", "é", "×", "a×", "ÇA", "ß", "<|endoftext|>", "<|", "|>", "endoftext|>", "e\u0301",
             "日本", "ﬁ", "🎉", "ΑΣ", ".", ",", "'s", "''", "-", "--", "\t", "\u00a0", "\x85", "\u2028", "İ", "ǅ", "٣", "½", "\x00", "a.b", "U.S."]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", "", " ", "\n"]) for _ in range(rnd.randrange(12))) for _ in range(4000)] + [None, "", " "]
    ids, ends = enc.encode_all(texts)
    for t, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert got.tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def base_counts(text):
    w = re.findall(WORD, text or "")
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if often[x] > 1:
            covered |= set(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_counts_and_verdicts(spark, texts):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality.quality_report(texts)
    assert rows(got, "doc_id", *cols) == sorted(((r.doc_id, *base_counts(r.text)) for r in texts.collect()), key=str)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = got.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in seen}
    assert n.get((1, False), 0) <= 0.03 * n[1, True] and n.get((0, True), 0) <= 0.1 * n.get((0, False), 10)


def test_quality_filter_removes_failing_lines_only(spark):
    good = "A long sentence about rivers and stones that has a proper end to it."
    df = spark.createDataFrame([(1, f"Home\n{good}\nAnother one follows it.\nAll rights reserved.", 5, "x"), (2, good + " " + good, 5, "y")],
                               "doc_id long, text string, n_chars int, size string")
    out = {r.doc_id: r for r in quality.quality_filter(df).collect()}
    assert out[1].text == f"{good}\nAnother one follows it." and out[1].n_chars == len(out[1].text) and out[1].size == "x"
    assert set(out) == {1}  # document 2 repeats itself


def base_spans(x):
    def luhn(s):
        return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x)
            if all(int(k) <= 255 for k in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end(), "card")] if 14 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x)
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_pii_base_spans(spark, texts):
    rnd = random.Random(4)
    pieces = ["a@b.co", "_m", "@x.yz", ".", "..", "1.2.3.4", "256.", "999.1.1.1", "+1 (569) 555-6633", " ", "-", "4539578763621486",
              "12", "3-4 ", "é", "🎉", "+", "(", ")", "x", "@", "%", "\n", "+49 30 1234567", "0"]
    odd = spark.createDataFrame([(500000 + k, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(25)))) for k in range(1500)],
                                "doc_id long, text string")
    docs = texts.unionByName(odd)
    got = pii.find_pii(docs)
    want = []
    for r in docs.collect():
        s = base_spans(r.text or "")
        n = Counter(x.split(":")[0] for x in s)
        want.append((r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(s).encode()).hexdigest()))
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=str)
    spans = {r.doc_id: r.spans.split(",") for r in got.collect()}
    assert all(set(base_spans(r.text or "")) <= set(spans[r.doc_id]) or not base_spans(r.text or "") for r in docs.collect())


def test_reliabilities_are_recovered_from_votes():
    """Votes drawn with known reliabilities: the learned odds separate the spans."""
    rnd = random.Random(5)
    right, wrong, prior = [0.95, 0.8, 0.7, 0.9], [0.1, 0.3, 0.2, 0.4], 0.4
    drawn = Counter()
    for _ in range(20_000):
        real = rnd.random() < prior
        votes = "".join("-" if rnd.random() < 0.15 else "y" if rnd.random() < (right if real else wrong)[j] else "n" for j in range(4))
        drawn[votes, real] += 1
    counts = Counter()
    for (votes, _), n in drawn.items():
        counts[votes] += n
    odds = pii.fit([("phone", votes, "kind=phone", n) for votes, n in sorted(counts.items())])

    def score(votes):
        return odds[""] + odds["kind=phone"] + sum(odds[f"vote{j}={v}"] for j, v in enumerate(votes))
    good = sum(n for (votes, real), n in drawn.items() if (score(votes) >= 0) == real)
    best = sum(max(drawn[votes, True], drawn[votes, False]) for votes in counts)  # of any decision by the votes
    assert good >= 0.99 * best
    for j in range(4):  # a yes of a reliable labeler says more
        true = np.log(right[j] / wrong[j])
        assert abs(odds[f"vote{j}=y"] - true) < 0.35, (j, odds[f"vote{j}=y"], true)


def test_candidates_that_overlap_base_spans(spark):
    rnd = random.Random(10)
    spans = "array<struct<start:int,rank:int,end:int,kind:string,votes:string,features:string>>"

    def some(n):
        return sorted((s, 1, s + rnd.randrange(1, 9), "k", "", "") for s in (rnd.randrange(n * 6 + 1) for _ in range(n)))
    rows = [(k, some(rnd.choice([0, 1, 3, 40, 700])), some(rnd.choice([0, 1, 5, 60, 600]))) for k in range(40)]
    df = spark.createDataFrame(rows, f"k long, more {spans}, base {spans}")
    got = {r.k: [(x.start, x.end) for x in r.kept] for r in df.select("k", pii._apart_from(F.col("more"), F.col("base")).alias("kept")).collect()}
    for k, more, base in rows:
        assert got[k] == [(m[0], m[2]) for m in more if not any(b[0] < m[2] and m[0] < b[2] for b in base)]


def test_parts_of_a_long_text(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["a", "é", "🎉", "\n", "日", " "]) for _ in range(9000))
    at = [sorted(rnd.randrange(9001) for _ in range(2)) for _ in range(200)] + [[0, 0], [0, 9000], [1024, 2048], [9000, 9000]]
    df = spark.createDataFrame([(text, at)], "t string, at array<array<int>>")
    got = df.select(pii._cutter(F.col("t"), lambda piece: F.transform("at", lambda x: piece(x[0], x[1]))).alias("x")).first().x
    assert got == [text[a:b] for a, b in at]


def test_long_texts_in_every_text_operator(spark):
    """A text of 120,000 words with many spans, and the same text once more."""
    words = [f"word{k % 977}" for k in range(120_000)]
    for k in range(0, 120_000, 60):
        words[k] = f"user{k}@mail1.example.com"
    long = "\n".join(" ".join(words[k:k + 12]).capitalize() + "." for k in range(0, 120_000, 12))
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long, "en", "s", 1), (3, "short", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.n_email for r in pii.find_pii(docs).orderBy("doc_id").collect()] == [2000, 2000, 0]
    clean = pii.redact(docs).orderBy("doc_id").collect()
    assert clean[0].text.count("<EMAIL>") == 2000 and "@" not in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert [r.n_words for r in quality.quality_report(docs).orderBy("doc_id").collect()] == [120_000, 120_000, 1]
    enc = encoding()
    want = hashlib.sha256(" ".join(map(str, enc.encode_ordinary(long))).encode()).hexdigest()
    assert [r.ids_sha256 == want for r in bpe.encode_documents(docs, RANKS, P.PATTERN).orderBy("doc_id").collect()] == [True, True, False]


@pytest.mark.parametrize("bad", ["Home", "Startseite.", "Accueil", "Inicio", "All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.",
                                 "Todos los derechos reservados.", "Über uns", "À propos.", "ÜBER UNS", "Política de privacidad."])
def test_navigation_and_boilerplate_of_four_languages(spark, bad):
    good = ["The old house by the river has a garden that is full of light.", "Das alte Haus am Fluss hat einen Garten voller Licht.",
            "La vieille maison près de la rivière a un jardin plein de lumière.", "La casa vieja junto al río tiene un jardín lleno de luz."]
    df = spark.createDataFrame([(1, "\n".join([*good[:2], bad, *good[2:]]))], "doc_id long, text string")
    assert quality.quality_filter(df).first().text == "\n".join(good)


def test_pii_redaction(spark, texts):
    more = spark.createDataFrame([(900000, "Write to bob.k@mail1.example.com or +1 (569) 555-6633 4539578763621486 now.")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(texts.unionByName(more)).collect()}
    assert out[900000] == "Write to <EMAIL> or <PHONE> <CARD> now."
    assert not any(re.search(r"password=|\S@mail\d", t or "") for t in out.values())


def test_language_on_held_out_documents(spark):
    got = Q.op9_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = got.where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_code_lengths_are_those_of_a_distribution():
    g = np.array([(10 << 24) | (10 << 16) | (10 << 8) | 97, (10 << 24) | (10 << 16) | (97 << 8) | 98])
    m = language.Model(["x"], [(g, np.array([30, 20]))], least=1)
    assert np.allclose(np.exp2(-m.bits.reshape(-1, m.size)).sum(axis=1) - np.exp2(-m.bits.reshape(-1, m.size)[:, -1])
                       + np.exp2(-m.bits.reshape(-1, m.size)[:, -1]) * (256 - (m.size - 1)), 1, atol=1e-4)


def brute_bits(training, text, least):
    """PPM with escapes, straight from the definition: training and text are bytes by
    language; a context counts if all languages together saw it ``least`` times."""
    def grams(texts, k):
        return Counter((t[i - k:i], t[i:i + 1]) for t in ((b"\n\n\n" + x) for x in texts) for i in range(3, len(t)))
    counts = {lang: [grams(texts, k) for k in range(4)] for lang, texts in training.items()}
    seen = {b"\n"} | {s for c in counts.values() for _, s in c[0]}
    rest = 256 - len(seen)
    symbols = sorted(seen) + ([None] if rest else [])
    often = [Counter() for _ in range(4)]
    for c in counts.values():
        for k in range(4):
            for (context, _), n in c[k].items():
                often[k][context] += n
    tree = [{b""}, None] + [{x for x, n in often[k].items() if n >= least} for k in (2, 3)]

    def p(lang, context):
        if len(context) == 3 and (context not in tree[3] or context[1:] not in tree[2]):
            return p(lang, context[1:])
        if len(context) == 2 and context not in tree[2]:
            return p(lang, context[1:])
        shorter = p(lang, context[1:]) if context else {s: 1 / len(symbols) for s in symbols}
        own = {s: n for (x, s), n in counts[lang][len(context)].items() if x == context}
        total, left = sum(own.values()), sum(shorter[s] for s in symbols if s not in own)
        if not total:
            return shorter
        escape = len(own) if left > 0 else 0
        return {s: own[s] / (total + escape) if s in own else escape / (total + escape) * shorter[s] / left for s in symbols}
    out = {}
    for lang in training:
        t, bits = b"\n\n\n" + text, 0.0
        for i in range(3, len(t)):
            s = t[i:i + 1] if t[i:i + 1] in seen else None
            q = p(lang, t[i - 3:i] if all(t[j:j + 1] in seen for j in range(i - 3, i)) else t[i - 3:i])[s]
            bits += -np.log2(q / (rest if s is None else 1))
        out[lang] = bits
    return out


def test_language_code_lengths_against_the_definition(spark):
    rnd = random.Random(6)
    training = {"aa": [b"the river and the stone" * 3, b"in the garden"], "bb": [b"der fluss und der stein" * 3, "für".encode()], "cc": [b"la pierre et la rivi"] * 4}
    rows = [(lang, t.decode()) for lang, ts in training.items() for t in ts]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    import quizlake.llm.language as lang_module
    old, lang_module.LEAST = lang_module.LEAST, 3
    try:
        grams = language.map_arrow(df.select("lang", "text"), language._count, language.GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    finally:
        lang_module.LEAST = old
    names = sorted(training)
    m = language.Model(names, [(np.array([r.gram for r in grams if r.lang == x]), np.array([r.n for r in grams if r.lang == x])) for x in names], least=3)
    texts = ["".join(rnd.choice(["the ", "der ", "la ", "stone", "ü", "x", "é", "\n", "?", "und"]) for _ in range(rnd.randrange(12))).encode() for _ in range(40)]
    got = m.lengths(texts)
    for t, bits in zip(texts, got, strict=True):
        want = brute_bits(training, t, 3)
        assert np.allclose(bits, [want[x] for x in names], rtol=1e-4, atol=1e-3), t


def test_language_keeps_every_context_seen_often_enough():
    """No cap on contexts and no merging of bytes that were seen."""
    rnd = np.random.default_rng(7)
    x = rnd.integers(0, 256, 40_000).astype(np.int64)
    gram, n = np.unique((x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:], return_counts=True)
    m = language.Model(["x"], [(gram, n)], least=1)
    assert m.size == 256
    contexts = len(np.unique(gram >> 8)) + len(np.unique((gram >> 8) & 0xFFFF)) + 256
    assert m.bits.shape[0] == contexts * 256


def test_language_odd_rows(odd_docs):
    model = language.train(odd_docs)
    got = {r.doc_id: r.lang_pred for r in language.predict(odd_docs, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en"
    assert {r.lang_pred for r in language.predict(odd_docs, None).collect()} == {"und"}


def test_empty_tables(spark, scratch, no_docs):
    path = scratch("none")
    token_files.write_token_files(no_docs, path, Q.read_bytes("word_bpe_49k.json"), 1)
    for df in (bpe.encode_documents(no_docs, RANKS, P.PATTERN), token_files.read_token_files(spark, path), quality.quality_report(no_docs),
               quality.quality_filter(no_docs), pii.find_pii(no_docs), pii.redact(no_docs), language.predict(no_docs, language.train(no_docs))):
        assert df.count() == 0


def test_pipeline_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, SF).toArrow())
        assert docs.columns == columns, name
        if name == "n-gram Jaccard join":
            kept = docs.count()
    assert kept < before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and {"doc_id", "n_tokens", "ids"} <= set(last.columns)
    assert last.where(F.size("ids") != F.col("n_tokens")).count() == 0


def good_line(x):
    w = re.findall(WORD, x)
    symbols, shouts = len(re.findall(quality.SYMBOLS, x)), sum(bool(re.search("[!?]{2}$", v)) for v in w)
    return not w or bool(
        regex.search(quality.SENTENCE, x) and not (len(x) <= 40 and regex.search(quality.NAVIGATION, x))
        and not regex.search(quality.SEPARATORS, x) and not (len(x) <= 300 and regex.search(quality.BOILERPLATE, x.lower()))
        and 4 * symbols <= len(w) and (("!!" not in x and "??" not in x) or 10 * shouts <= 3 * len(w)))


def cleaned(docs):
    out = []
    for r in docs:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if good_line(x))
        left, whole = (sum(map(len, re.findall(WORD, t))) for t in (text, r["text"] or ""))
        if not base_counts(r["text"])[-1] and 5 * left >= 2 * whole:
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def one_of_each(docs):
    sets, first = [], []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        w = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"]))
        sets.append(({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}, r))
    label = list(range(len(sets)))
    for i, (a, _) in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j][0]) >= 80 * len(a | sets[j][0]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    for k, (_, r) in enumerate(sets):
        first += [r] if label[k] == k else []
    return first


def redacted(docs, spans):
    out = []
    for r in docs:
        text, end = "", 0
        for kind, s, e in (x.split(":") for x in spans[r["doc_id"]]):
            if int(s) >= end:
                text += r["text"][end:int(s)] + f"<{kind.upper()}>"
            end = max(end, int(e))
        text += r["text"][end:]
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def mixed(docs):
    by, out = {}, []
    for r in docs:
        by.setdefault(r["source"], []).append((hashlib.md5(f"{Q.SEED}:{r['doc_id']}".encode()).hexdigest(), len(re.findall(WORD, r["text"])), r))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, _ in by[s]) for s in names}
    weight = {s: Q.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, open_sources, left = {}, set(names), Q.SHARE * sum(size.values())
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if weight[s] * level > Q.MOST * size[s]}
        target |= {s: Q.MOST * size[s] if s in full else weight[s] * level for s in full or open_sources}
        left -= sum(target[s] for s in full)
        open_sources = open_sources - full if full else set()
    for s in names:
        epochs, rest = divmod(int(target[s]), size[s])
        before = 0
        for _, n, r in sorted(by[s], key=lambda x: x[0]):
            out += [r] * (epochs + (before + n / 2 <= rest and rest > 0))
            before += n
    return out


def test_pipeline_against_brute_force(spark, scratch):
    """Each stage on all that its predecessor kept, and run() as a whole, row for row."""
    rnd = random.Random(21)
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    columns, schema = list(docs[0]), spark.read.parquet(f"{SF}/documents.parquet").schema
    plain = [r for r in docs if r["text"] and len(r["text"]) > 1000][:12]
    for k, r in enumerate(plain):  # exact and near copies, boilerplate around a text, personal data, other sources
        w = r["text"].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        new = [r["text"], " ".join(w), f"Home\n{r['text']}\nAll rights reserved.", f"{r['text']} Mail a{k}@b.co, 10.0.0.{k}, +1 569 555 66{k:02}."]
        docs += [r | {"doc_id": 10_000 + 10 * k + i, "text": t, "source": [r["source"], None, "zz", "é"][i]} for i, t in enumerate(new)]
    folder = scratch("pipeline-docs")
    given = spark.createDataFrame([tuple(r[c] for c in columns) for r in docs], schema)
    given.write.parquet(f"{folder}/documents.parquet")

    def key(rows):
        return sorted(rows, key=repr)
    df, want, sizes = spark.read.parquet(f"{folder}/documents.parquet"), docs, [len(docs)]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        if name == "PII":
            found = {r.doc_id: r for r in pii.find_pii(df).collect()}
            spans = {i: [x for x in r.spans.split(",") if x] for i, r in found.items()}
            for r in want:
                assert set(base_spans(r["text"])) <= set(spans[r["doc_id"]])
        want = {"quality rules": cleaned, "n-gram Jaccard join": one_of_each, "PII": lambda d: redacted(d, spans), "mixing sources": mixed}[name](want)
        step(spark, df, folder).write.parquet(f"{folder}/{k}")
        df = spark.read.parquet(f"{folder}/{k}")
        assert df.columns == columns, name
        assert key(tuple(r) for r in df.collect()) == key(tuple(r[c] for c in columns) for r in want), name
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] != sizes[4]  # every decision took effect
    assert any("<EMAIL>" in r["text"] for r in want)
    enc = encoding()
    ids = [(r["doc_id"], enc.encode_ordinary(r["text"])) for r in want]
    got = corpus_pipeline.run(spark, folder)
    assert rows(got, "doc_id", "n_tokens", "ids") == sorted(((i, len(x), x) for i, x in ids), key=str)
