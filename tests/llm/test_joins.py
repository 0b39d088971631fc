"""Joins against all pairs: the n-gram join, the vector join, and what the pipeline keeps."""
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfline.llm import grid_join, ngram_join


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def grams(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(ngram_join.LOWER_AZ))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n, percent):
    sets = {i: grams(t, n) for i, t in texts.items()}
    root, ids = {i: i for i in sets}, sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(root, i), find(root, j)))
                root[b] = a
    return {i: (len(sets[i]), find(root, i)) for i in sets}


def corpus(seed):
    """Copies with edits of every strength, shared passages, short texts and exact copies."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(40)]
    texts = {}
    for base in range(12):
        own = [word() for _ in range(rng.choice([3, 6, 12, 40, 90, 200]))] + (passage if base % 3 == 0 else [])
        for _ in range(rng.randrange(2, 9)):
            copy = list(own)
            for _ in range(rng.randrange(0, 1 + len(own) // 15)):
                copy[rng.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy) if rng.random() < 0.8 else "\n ".join(copy).upper()
    return texts


@pytest.mark.parametrize("seed,n,percent,block", [(1, 4, 85, 1000), (2, 5, 80, 1000), (3, 4, 85, 3), (4, 3, 60, 4)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, n, percent, block):
    monkeypatch.setattr(ngram_join, "COMMON_DOCS", 2 + seed)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1 if block < 10 else 16)
    monkeypatch.setattr(ngram_join, "KEYS_PER_TASK", 100 if seed % 2 else 700_000)      # keys in several rounds, or in one
    texts = corpus(seed)
    out = ngram_join.link_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(texts, n, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    pool = np.unique(rng.integers(0, 2 ** 63, 400).astype(np.uint64))
    maker = ngram_join.Segments(percent, pool)
    for _ in range(1500):
        size = int(rng.choice([1, 2, 3, 5, 8, 13, 21, 40, 100, 300]))
        a = np.unique(np.concatenate([rng.integers(0, 2 ** 63, size).astype(np.uint64), rng.choice(pool, int(rng.choice([0, 1, 5, 40, 300])))]))
        drop = rng.integers(0, int(len(a) * (1 - percent / 100)) + 1)
        keep = rng.permutation(a)[drop:]
        add = rng.integers(0, max(1, int(len(a) * (100 / percent - 1))) + 1)
        b = np.unique(np.concatenate([keep, rng.integers(0, 2 ** 63, add).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if len(b) and 100 * inter >= percent * (len(a) + len(b) - inter):
            assert np.intersect1d(maker.keys(a), maker.keys(b)).size


def test_prefix_tree_finds_what_pairs_find():
    rng = np.random.default_rng(5)
    for _ in range(30):
        pool = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
        sets = [np.unique(rng.choice(pool, rng.integers(1, 30))) for _ in range(40)]
        links = ngram_join.spanning_links(sets, list(range(40)), 70)
        root, want = list(range(40)), list(range(40))
        for a, b in links:
            k = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * k >= 70 * (len(sets[a]) + len(sets[b]) - k)
        for pairs, r in ((links, root), ([(a, b) for b in range(40) for a in range(b)], want)):
            for a, b in pairs:
                k = len(np.intersect1d(sets[a], sets[b]))
                if 100 * k >= 70 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(r, a), find(r, b)))
                    r[y] = x
        assert [find(root, i) for i in range(40)] == [find(want, i) for i in range(40)]


def test_a_join_on_the_chunk_leaves_the_keys_where_they_are(spark):
    rows = spark.range(400).select(F.col("id").alias("chunk"), F.expr("cast(uuid() as binary)").alias("keys"))
    keys = ngram_join._by_chunk(rows, 7)
    go_by = ngram_join.settle(spark.range(0, 400, 3).select(F.col("id").alias("chunk"), F.col("id").alias("to")), "go_by")
    both = keys.join(go_by.hint("merge"), "chunk", "left")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and both.count() == 400 and both.where("to is not null").count() == 134


def test_keys_are_packed_and_seated():
    key = np.sort(np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 1000))
    data = ngram_join._packed(key)
    assert len(data) == 6 * len(key) and (ngram_join._unpacked(data) == key & (2 ** 48 - 1)).all()
    assert ngram_join._cuts([]) == [] and ngram_join._cuts([1] * 5_000) == [2_000, 4_000, 5_000]
    assert ngram_join._cuts([600_000, 600_000, 5, 2_000_000, 1]) == [1, 3, 4, 5]


def test_every_seat_is_a_partition_of_its_own(spark):
    seats = ngram_join._seats(spark, 13)
    got = spark.createDataFrame([(x,) for x in seats], "task long").repartition(13, "task").select(F.spark_partition_id().alias("p"), "task").collect()
    assert [r.task for r in sorted(got, key=lambda r: r.p)] == seats


def test_odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, long), (7, long + " end"), (6, long), (None, long), (8, "one"), (9, "two one")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(df, 4, 85).collect()]
    assert sorted(out, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 29997, 6), (6, 29997, 6), (7, 29998, 6), (None, 29997, None),
                                           (8, 1, 8), (9, 1, 9)], key=str)
    kept = ngram_join.deduplicate(df, 4, 85)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 4, 6, 8, 9, None]
    assert ngram_join.link_documents(df.limit(0)).count() == 0


def vectors(seed, n, dims=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dims))
    x = base[rng.integers(0, len(base), n)] * rng.uniform(0.5, 3, (n, 1)) + rng.normal(scale=0.12, size=(n, dims))
    x[: n // 8] = x[0]
    return x


@pytest.mark.parametrize("block,leaf", [(2048, 128), (16, 4)])
def test_vectors_equal_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(grid_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(grid_join, "LEAF_ROWS", leaf)
    x = vectors(3, 240).astype(np.float32)
    rows = [(i, v.tolist(), None if i % 40 == 3 else i % 2, 1) for i, v in enumerate(x)]
    rows += [(900, None, 1, 1), (901, [0.0] * 12, 1, 1), (902, [float("nan")] * 12, 1, 1), (903, [None] * 12, 1, 1), (904, [1.0], 1, 1), (905, [2.0], 1, 1),
             (906, [float("inf")] + [0.0] * 11, 1, 1), (907, [], 1, 1), (908, [3e38] * 12, 0, 1), (909, [3e38] * 12, 0, 1), (910, [-0.0, 1.0], 0, 1), (911, [0.0, 2.0], 0, 1)]
    out = grid_join.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int")).collect()
    able = {i: np.array(v, float) for i, v, label, _ in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: (c, len(v) if v else 0) for i, v, c, _ in rows}
    root, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}
    for i in able:
        for j in able:
            if i < j and label[i] == label[j]:
                a, b = able[i] / np.abs(able[i]).max(), able[j] / np.abs(able[j]).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    p, q = sorted((find(root, i), find(root, j)))
                    root[q] = p
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {i: (links[i], find(root, i), find(root, i) == i) for i in root}


def test_vectors_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert grid_join.link_vectors(spark.createDataFrame([], schema)).count() == 0
    out = grid_join.link_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in out) == [("1", 1, True), ("1", 1, True), ("None", 0, False)]


def test_stars_connect_what_links_connect():
    rng = np.random.default_rng(8)
    for density in (0.002, 0.02, 0.2):
        whole, root = grid_join.Connected(120), list(range(120))
        for _ in range(6):
            a, b = rng.permutation(120)[:50], rng.permutation(120)[:40]
            hits = rng.random((50, 40)) < density
            whole.join(a, b, hits)
            for i, j in zip(*np.nonzero(hits)):
                p, q = sorted((find(root, int(a[i])), find(root, int(b[j]))))
                root[q] = p
        assert whole.label.tolist() == [find(root, i) for i in range(120)]
        stars = whole.stars(np.arange(120) * 3 + 7)
        assert stars.tolist() == [[3 * find(root, i) + 7, 3 * i + 7] for _, i in sorted((find(root, i), i) for i in range(120)) if find(root, i) != i]


def test_a_large_group_of_near_copies(spark):
    """20,000 vectors that all link: 200 million links, counted and connected without touching each."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=32) + rng.normal(scale=0.01, size=(20_000, 32))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": list(x), "label": 1}), "vec_id long, embedding array<double>, label int")
    out = grid_join.link_vectors(df).toPandas()
    assert (out.n_links == 19_999).all() and (out.component_id == 0).all() and out.kept.sum() == 1


def test_of_repeated_ids_the_smallest_hash_stays(spark):
    rows = [(1, f"words of text number {i} are here", i, {"k": i}) for i in range(20)] + [(2, "other words", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, m map<string,int>")
    want = df.where("doc_id = 1").select("text", F.xxhash64("doc_id", "text", "n").alias("h")).orderBy("h").first()["text"]
    for copies in (df, df.repartition(7, "text")):
        kept = ngram_join.deduplicate(copies)
        assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, want), (2, "other words")]
