"""Operators on rows, pairs and urls against brute force: mixing, joins, filters, shards."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlake.llm import common, embed_dedup, mixing, ngram_join, pii, quality, sharding, url_filter
from quizlake.llm import queries as Q
from tools.oracle_check import duck, frame_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, name):
    df = Q.SPARK[name](spark, SF)
    cur = duck(SF).execute(Q.ORACLE[name])
    assert frame_rows(df.columns, [tuple(r) for r in df.collect()]) == frame_rows([d[0] for d in cur.description], cur.fetchall())


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in linked:
        root[find(j)] = find(i)
    return [find(i) for i in range(n)]


def smallest(ids, root):
    out = {}
    for i, r in zip(ids, root, strict=True):
        out[r] = i if out.get(r) is None else min(out[r], i) if i is not None else out[r]
    return [out[r] for r in root]


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(6)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)] + [(300 + k, 300 + (k + 1) % 9) for k in range(9)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(300, 309), 300)}


def test_prefix_sums_with_ties(spark):
    df = spark.createDataFrame([(k % 5, k % 3, k) for k in range(400)], "a int, b int, v long")
    got = common.prefix_sums(df, ["a", "b", "v"], ["v"], "t", partitions=7).orderBy("a", "b", "v").collect()
    total = 0
    for r in got:
        assert r.v_before == total
        total += r.v


@pytest.mark.parametrize("n, threshold", [(3, (90, 100)), (5, (80, 100))])
def test_ngram_join_against_all_pairs(spark, odd_docs, n, threshold):
    rnd, base = random.Random(7), [f"w{k}" for k in range(200)]
    near = []
    for k in range(120):  # a group of near copies, each with a few words changed
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(200)] = f"x{rnd.randrange(9)}"
        near.append((1000 + k, " ".join(w)))
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    local, sets = docs.collect(), []
    for r in local:
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    p, q = threshold
    linked = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
              if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])]
    component = smallest([r.doc_id for r in local], groups(len(sets), linked))
    want = sorted(((r.doc_id, len(s), c) for r, s, c in zip(local, sets, component, strict=True)), key=str)
    got = ngram_join.ngram_groups(docs, n, threshold, tile_rows=16)
    first = got.groupBy("root").agg(F.min("doc_id").alias("c")).collect()
    least = {r.root: r.c for r in first}
    assert want == sorted(((r.doc_id, r.n_shingles, r.doc_id if r.root is None else least[r.root]) for r in got.collect()), key=str)


def test_one_of_each_keeps_one_row_of_a_group(odd_docs):
    out = ngram_join.one_of_each(odd_docs, 5, (80, 100))
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert ids.count(5) + ids.count(6) == 1 and 7 in ids and 8 not in ids and 9 not in ids and {1, 2, 3} <= set(ids)
    assert out.columns == odd_docs.columns


def test_embedding_dedup_against_all_pairs(spark):
    rnd = np.random.default_rng(8)
    centre = rnd.normal(size=8)
    v = [(centre + rnd.normal(size=8) * s).astype(np.float32).tolist() for s in rnd.choice([0.02, 0.1, 0.15, 3], 200)]
    rows = [(k, x, int(k % 2)) for k, x in enumerate(v)] + [(300, v[0], 0), (301, v[0], 0), (302, v[0], None), (303, None, 0), (304, [], 0),
            (305, [0.0] * 8, 0), (306, [float("nan")] + [1.0] * 7, 0), (307, [float("inf")] * 8, 0), (308, [None] + [1.0] * 7, 0),
            (309, [1e38] * 8, 1), (310, [1e-38] * 8, 1), (311, [1.0] * 5, 1), (None, v[2], 0), (300, v[0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("fp", F.lit(1))
    data = [(i, None if x is None or None in x else np.array(np.array(x, np.float32), float), lab) for i, x, lab in rows]
    ok = [x is not None and len(x) > 0 and np.isfinite(x).all() and (x != 0).any() and lab is not None for _, x, lab in data]
    linked = [(i, j) for i, j in itertools.combinations(range(len(data)), 2) if ok[i] and ok[j] and data[i][2] == data[j][2]
              and len(data[i][1]) == len(data[j][1])
              and data[i][1] @ data[j][1] / (np.linalg.norm(data[i][1]) * np.linalg.norm(data[j][1])) >= 0.98]
    n = [0] * len(data)
    for i, j in linked:
        n[i], n[j] = n[i] + 1, n[j] + 1
    component = smallest([r[0] for r in rows], groups(len(rows), linked))
    got = embed_dedup.near_duplicates(df, 0.98, tile_rows=16)
    assert sorted(((r[0], k, c, r[0] is not None and r[0] == c) for r, k, c in zip(rows, n, component, strict=True)), key=str) == sorted(
        map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_quantisation_bound_holds():
    rnd = np.random.default_rng(9)
    u = rnd.normal(size=(300, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, step, err = embed_dedup.quantise(u)
    approx = (q.astype(float) @ q.astype(float).T) * step[:, None] * step[None, :]
    assert (np.abs(u @ u.T - approx) <= (1 + err)[:, None] * err[None, :] + err[:, None] + 1e-12).all()


def test_mixing_targets_and_whole_documents(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (sorted(map(tuple, mixing.mix(docs).collect())) for _ in range(2))
    assert a == b
    by = mixing.mix(docs).withColumn("k", F.col("source_size")).groupBy("k", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 1 and r.target <= 2 * r.k for r in by)
    out = mixing.mixed_documents(docs)
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and max(copies.values()) <= 2
    odd = mixing.mix(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("taken > 2 * size or taken < 0").count() == 0
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns


def test_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x/", "block"),
                                   ("b.org", "", "block"), ("b.org", "", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://x.net/", "http://x.net", "https://www.EXAMPLE.net/en/1?q#f", "http://a.example.net/en/x/y", "http://a.example.net/en/y",
            "http://network/", "http://notexample.net/en/", "ftp://b.org?x", "c.b.org/x", None, "", "http://", "://b.org/a://c.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("key", F.lit("z"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert [got[k] for k in range(len(urls))] == [
        ("x.net", "/", "net/", "block"), ("x.net", "", None, "allow"), ("www.example.net", "/en/1", "example.net/en/", "allow"),
        ("a.example.net", "/en/x/y", "a.example.net/en/x/", "block"), ("a.example.net", "/en/y", "example.net/en/", "allow"),
        ("network", "/", None, "allow"), ("notexample.net", "/en/", "net/", "block"), ("b.org", "", "b.org", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("b.org", "/a://c.net/", "b.org", "block")]
    assert url_filter.judge_urls(pages, rules).count() == len(urls) + 1
    assert url_filter.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_urls_against_all_rules(spark):
    rnd = random.Random(12)
    hosts = ["net", "a.net", "b.a.net", "org", "c.org", "x.c.org"]
    rules = sorted({(rnd.choice(hosts), "/" + "".join(rnd.choice("xy/") for _ in range(rnd.randrange(5))), rnd.choice(["allow", "block"])) for _ in range(60)})
    urls = [(k, f"http://{rnd.choice(['', 'w.', 'b.', 'zz.b.'])}{rnd.choice(hosts)}/" + "".join(rnd.choice("xyz/") for _ in range(rnd.randrange(7)))) for k in range(900)]
    got = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string").repartition(7),
                                spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        fit = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fit)[3:] if fit else (None, "allow")), r


def brute_shards(docs, shards, slack=0.01):
    """Texts by md5 in one line of bytes, cut at equal targets; a cut inside a group of equal
    texts goes to the nearer end of the group if that is near enough."""
    rows = sorted(((hashlib.md5((t or "").encode()).hexdigest(), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, i) for i, t in docs),
                  key=lambda r: (r[:3], r[3] is not None, r[3]))
    total, at, group = sum(r[2] for r in rows), 0, {}
    placed = []
    for r in rows:
        placed.append((at, r))
        first, _ = group.get(r[:3], (at, 0))
        at += r[2]
        group[r[:3]] = (first, at)
    cuts = []
    for k in range(1, shards):
        t = total * k / shards
        near = min((e for a, b in group.values() if a < t < b for e in (a, b)), key=lambda e: abs(e - t), default=t)
        cuts.append(near if abs(near - t) <= slack * total / shards else t)
    out, used = [], Counter()
    for before, (_, crc, size, i) in placed:
        shard = sum(before + size / 2 >= c for c in cuts)
        out.append((i, size, crc, shard, used[shard]))
        used[shard] += 1
    return out


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_shards_against_brute_force(spark, odd_docs, shards):
    docs = odd_docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    got = sharding.shard_documents(docs.repartition(5), shards)
    want = brute_shards([tuple(r) for r in docs.collect()], shards)
    assert sorted(map(tuple, got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str) == sorted(want, key=str)


def test_a_cut_between_two_equal_texts_moves(spark):
    docs = spark.createDataFrame([(k, f"text {k // 2:04d}") for k in range(1600)], "doc_id long, text string")
    where = {}
    for r in sharding.shard_documents(docs, 8, slack=0.02).join(docs, "doc_id").collect():
        where.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_columns_that_clash_with_internal_names(spark, odd_docs):
    """Stage functions keep a user's columns, whatever they are called."""
    names = ["__measures", "__clean", "__copy", "__key", "__cut", "__kept", "__spans", "__spans_raw", "k1", "of", "spans", "mix_last", "row"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names))
    for out in (quality.quality_filter(docs), ngram_join.one_of_each(docs), pii.redact(docs), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)


def test_one_of_each_picks_the_same_row_again(spark):
    rows = [(1, "one two three four five six", "en", f"s{k}", 1) for k in range(40)]
    seen = {tuple(ngram_join.one_of_each(spark.createDataFrame(random.Random(k).sample(rows, 40), "doc_id long, text string, lang string, source string, n_chars long")
                                         .repartition(k + 1)).collect()[0]) for k in range(4)}
    assert len(seen) == 1


def test_one_of_each_combines_repeated_rows_before_the_shuffle(spark):
    """A third of all rows are one row: each task passes on one of them at most."""
    text = F.when(F.col("id") % 3 == 0, F.lit("one two three four five six")).otherwise(F.concat_ws(" ", *(F.md5(F.concat("id", F.lit(f":{k}"))) for k in range(6))))
    docs = spark.range(0, 6000, 1, 6).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), text.alias("text"))
    out = ngram_join.one_of_each(docs)
    assert out.count() == out.select("doc_id").distinct().count() == 4001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def test_components_of_a_hot_star(spark):
    """One centre with a hundred thousand edges, half of them through another node."""
    edges = spark.range(100_000).select(F.lit(5).cast("long").alias("a"), (F.col("id") + 10).alias("b")).unionByName(
        spark.range(100_000).select((F.col("id") + 10).alias("a"), (F.col("id") + 200_000).alias("b")))
    got = common.components(edges, "t")
    assert got.count() == 200_001 and got.where("root <> 5").count() == 0


def test_shards(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    parts = {k: [r for r in got if r.shard == k] for k in range(8)}
    total = [sum(r.size for r in p) for p in parts.values()]
    assert max(total) - min(total) <= 0.05 * max(total)
    assert all(sorted(r.slot for r in p) == list(range(len(p))) for p in parts.values())
    where = {}
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 0
    odd = sharding.shard_documents(odd_docs, 40).collect()
    assert len(odd) == odd_docs.count() and {r.size for r in odd if r.doc_id in (1, 2)} == {1}


def test_empty_tables(spark, no_docs):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    for df in (mixing.mix(no_docs), mixing.mixed_documents(no_docs), embed_dedup.near_duplicates(vectors), ngram_join.ngram_join(no_docs),
               ngram_join.one_of_each(no_docs), url_filter.judge_urls(pages, rules), sharding.shard_documents(no_docs)):
        assert df.count() == 0
