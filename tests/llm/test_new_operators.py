"""Hard negatives, licence scans and the divergence audit against brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quizlake.llm import divergence, hard_negatives, licenses
from quizlake.llm import queries as Q


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- hard negatives -------------------------------------------------------------

def brute_negatives(rows, is_anchor, n_pos=5, n_neg=5, scale=256):
    rows = [(i, [int(x) for x in hard_negatives.scaled(v, scale)], lab) for i, v, lab in rows
            if i is not None and v is not None and lab is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for i, v, lab in {(i, tuple(v), lab) for i, v, lab in rows if is_anchor(i)}:
        score = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, w, m in rows if j != i and len(w) == len(v)))
        for s, p, m in [x for x in score if x[2] == lab][:n_pos]:
            fits = [(-t, j) for t, j, m in score if m != lab and 80 * -s <= 100 * -t <= 100 * -s][:n_neg]
            out += [(i, p, k + 1, j, -s, t) for k, (t, j) in enumerate(fits)]
    return sorted(out)


def vectors(seed=1, n=260, d=6):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(4, d))
    rows = [(k, (centre[k % 4] * rnd.choice([0, 1]) + rnd.normal(size=d) * 0.4).astype(np.float32).tolist(), int(rnd.integers(3))) for k in range(n)]
    rows += [(300, rows[0][1], 0), (305, None, 0), (310, [0.5] * d, None), (315, [float("nan")] * d, 1), (320, [0.0] * d, 1), (325, [None] + [0.1] * 5, 1),
             (330, [0.25] * 3, 1), (331, [0.5] * 3, 1), (332, [0.5] * 3, 2), (None, [0.5] * d, 1), (335, [], 0), (336, [3e38] * d, 0),
             (340, [-3e38] * d, 2), (7, rows[7][1], rows[7][2]), (10, rows[10][1], rows[10][2])]
    return rows


def test_hard_negatives_against_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("tile", F.lit("x")).withColumn("score", F.lit(1))
    got = hard_negatives.hard_negatives(df.repartition(5), F.col("vec_id") % 5 == 0, cluster_rows=4, tile_rows=16)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 5 == 0)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") < 0).count() == 0
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_list_walk_ends_early_and_finds_all():
    rnd = np.random.default_rng(3)
    centre = rnd.normal(size=16)
    far = hard_negatives.scaled(rnd.normal(size=(6000, 16)), 256)
    q = np.concatenate([far, hard_negatives.scaled(centre * 3 + rnd.normal(size=(200, 16)) * 0.1, 256)])
    own = hard_negatives.scaled(centre + rnd.normal(size=(9, 16)) * 0.05, 256)
    ids = np.arange(len(q))
    c = hard_negatives.Cluster(np.arange(9), ids[:9] + 100_000, own, np.full((9, 1), hard_negatives.LOWEST + 1), np.full((9, 1), hard_negatives.HIGHEST), 5)
    walked = c.walk(ids, q)
    assert walked < len(q) / 2
    for k in range(9):
        s = own[k].astype(int) @ q.astype(int).T
        want = sorted(zip(-s, ids, strict=True))[:5]
        assert [(-a, b) for a, b in zip(c.best[k, 0], c.found[k, 0], strict=True)] == want


# --- licence scans --------------------------------------------------------------

def brute_base(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = [(k, label) for label, p in phrases for n in [len(p.split())] for k in range(len(words)) if words[k:k + n] == p.split()]
    starts = [k for k, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_against_search(spark, odd_docs):
    rnd, words = random.Random(4), "cc by all rights reserved general public license CC By é ð the".split()
    made = [(2000 + k, rnd.choice([" ", "-", ", "]).join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for k in range(150)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 10000, "text").toDF("doc_id", "text")).withColumn("labels", F.lit(1))
    got = licenses.scan_licenses(docs, Q.PHRASES).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) > 300
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == brute_base(r.text, Q.PHRASES), r.text
        assert 0 <= r.score <= 1 and set(r.base_labels) <= set(r.labels) and (r.score > 0) == bool(r.labels)


def test_automaton_statistics_against_all_substrings():
    rnd = random.Random(2)
    sequences = [[rnd.randrange(3) for _ in range(rnd.randrange(2, 14))] for _ in range(6)] + [[0, 1], [0, 1]]
    auto = licenses.Automaton(sequences)
    subs = {tuple(s[a:b]): [] for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    for key in subs:
        subs[key] = sorted((k, b) for k, s in enumerate(sequences) for b in range(len(key), len(s) + 1) if tuple(s[b - len(key):b]) == key)
    text = [rnd.randrange(4) for _ in range(400)]
    for end, (state, length) in enumerate(auto.statistics(text), 1):
        want = next((n for n in range(min(end, 14), 0, -1) if tuple(text[end - n:end]) in subs), 0)
        assert length == want
        if length:
            assert auto.places(state) == subs[tuple(text[end - length:end])]


def test_license_spans():
    scanner = licenses.Scanner(licenses.TEMPLATES, Q.PHRASES, licenses.LEAST_RUN, licenses.MOST_GAP, licenses.LEAST_COVER)
    mit = next(t for label, t in licenses.NOTICES if label == "mit")
    words = mit.split()
    changed = " ".join([*words[:9], "strange", "insertion", *words[9:20], *words[21:]])
    cases = {mit: {"mit"}, f"alpha beta {changed} gamma": {"mit"}, f"Released under the MIT License.\n{mit}\n{mit}": {"mit"},
             " ".join(words[:8]): set(), "the software without the license": set(), "Licensed under CC BY-NC 4.0.": {"cc-by-nc-4.0"},
             "This program is free software": set(), "Licensed under the Apache License, Version 2.0.": {"apache-2.0"},
             "Licensed under the GNU General Public License, version 3.": {"gpl-3.0"}, "": set(), "   ": set()}
    for text, want in cases.items():
        n, _, spans = scanner.scan(text)
        assert {label for _, _, label, _ in spans} == want, (text, spans)
        assert all(0 <= a < b <= n and 0.8 <= c <= 1 for a, b, _, c in spans)
    assert len(scanner.scan(f"{mit}\n{mit}")[2]) == 2
    with pytest.raises(ValueError):
        licenses.Scanner([("x", "word")], [], 4, 6, 0.8)


def test_chains_against_all_chains():
    rnd = random.Random(9)
    for _ in range(60):
        found = []
        for _ in range(7):
            s, t, n = rnd.randrange(20), rnd.randrange(12), rnd.randrange(1, 6)
            found.append((s, s + n, t))
        found = sorted(set(found))
        best = 0
        for n in range(1, len(found) + 1):
            for c in itertools.combinations(found, n):
                covered, ok = c[0][1] - c[0][0], True
                for (ps, pe, pt), (s, e, t) in itertools.pairwise(c):
                    pt_end, gain = pt + pe - ps, e - s - max(0, pe - s, pt + pe - ps - t)
                    ok &= ps < s and pe < e and pt < t and pt_end < t + e - s and s - pe <= 3 and t - pt_end <= 3 and gain > 0
                    covered += gain
                if ok:
                    best = max(best, covered)
        got = licenses.chains(found, 18, 3, 0.0)
        assert max(c for *_, c in got) == min(1.0, best / 18)


# --- divergence audit -----------------------------------------------------------

def brute_audit(rows, least, top):
    groups, by_lang, df = {}, {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        groups.setdefault((lang, source), Counter()).update(words)
        by_lang.setdefault(lang, Counter()).update(words)
        df.setdefault(lang, Counter()).update(set(words))
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    out = []
    for lang in by_lang:
        kept = [t for t, n in df[lang].items() if n >= least]
        v, n_lang = len(kept), sum(by_lang[lang][t] for t in kept)
        p = {s: {t: share(c[t], sum(c[x] for x in kept), v) for t in kept} for (g, s), c in groups.items() if g == lang}
        for s in p:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            q = {t: share(by_lang[lang][t], n_lang, v) for t in kept}
            terms = [(q[t] - p[s][t], t) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("cell_entries, row_groups", [(1 << 20, 1024), (7, 2)])
def test_audit_against_brute_force(spark, cell_entries, row_groups):
    rnd = random.Random(8)
    words = ["Tree", "tree", "été", "日本", "a", "b", "c", "d", "stone", "x1y", "zz"]
    rows = [(" ".join(rnd.choices(words, range(len(words), 0, -1), k=rnd.randrange(30))) + rnd.choice(["", ".", "\n "]),
             rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "é", None])) for _ in range(160)]
    rows += [(None, "en", "empty"), ("", "fr", "one"), ("lonely words", "it", "only"), ("few", "fr", "two")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("group", F.lit(1)).withColumn("term", F.lit("z"))
    got = divergence.audit(df.repartition(4), least_docs=12, top_terms=4, cell_entries=cell_entries, row_groups=row_groups)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, 12, 4)


def test_share_is_exact(spark):
    rnd = random.Random(1)
    cases = [(c, b) for c, b in ((rnd.randrange(10**rnd.randrange(1, 14)), rnd.randrange(1, 8 * 10**15)) for _ in range(300))]
    want = [1 + 10**9 * (c + 5) // b for c, b in cases]
    ok = [k for k, w in enumerate(want) if w < 2**62]
    c, b = (np.array([cases[k][i] for k in ok]) for i in (0, 1))
    assert divergence.share(c, b).tolist() == [want[k] for k in ok]
    df = spark.createDataFrame([cases[k] for k in ok], "c long, b long").select(divergence.share_sql("c", "b").alias("p"))
    assert [r.p for r in df.collect()] == [want[k] for k in ok]


def test_new_operators_on_empty_tables(spark, no_docs, odd_docs):
    assert licenses.scan_licenses(no_docs, Q.PHRASES).count() == 0 and divergence.audit(no_docs).count() == 0
    assert licenses.scan_licenses(odd_docs, Q.PHRASES).count() == odd_docs.count()
    assert divergence.audit(odd_docs).where("part = 'term'").count() == 0
