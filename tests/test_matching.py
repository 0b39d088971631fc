"""Rule cascade, nearest names and links against plain loops, and what their plans must not hold."""
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shelfline import session
from shelfline.operators import matching as M


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_join_is_never_broadcast(spark):
    short = spark.createDataFrame([("a b",), ("x",)], "cut string")
    full = spark.range(400).select(F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    hits = M.prefix_hits(short, full, "cut", "text")
    assert "Broadcast" not in plan(hits)
    assert hits.count() == 400


def test_names_of_many_ids(spark):
    post = spark.range(300).select(F.col("id").cast("string").alias("product_id"), F.lit("red ring Brand#1 100 Gr").alias("name"))
    post = post.unionByName(spark.createDataFrame([("900", "blue nut 50 Gr")], "product_id string, name string"))
    todo = spark.createDataFrame([("red ring ...",), ("BLUE NUT 50 GR",), ("nothing",)], "name string")
    rules = M.rule_matches(todo, post, M.name_table(post.select("name").unionByName(todo)))
    assert "Join" not in plan(rules)            # read by many steps, so written once
    got = {r.name: (r.rule, r.series_id, r.n_ids) for r in rules.collect()}
    assert got == {"red ring ...": ("3b_truncated_prefix_ambiguous", None, 300), "BLUE NUT 50 GR": ("3c_normalized", "900", 1), "nothing": ("no_rule_match", None, 0)}


def test_never_same_day(spark):
    rng = random.Random(3)
    days = [(f"n{rng.randrange(20)}", f"2020-01-{rng.randint(1, 28):02}") for _ in range(60)] + [("n3", None)]
    rows = spark.createDataFrame(days, "name string, d string").select("name", F.col("d").cast("date").alias("date"))
    pairs = [(f"n{i}", f"n{j}") for i in range(22) for j in range(22) if i != j]
    own = {n: {d for m, d in days if m == n and d} for n in {p for q in pairs for p in q}}
    got = M.never_same_day(spark.createDataFrame(pairs, "a string, b string"), rows, "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(p for p in pairs if not own[p[0]] & own[p[1]])


def test_nearest_norms_in_blocks_equal_a_loop(spark):
    rng = random.Random(5)
    words = ["red", "blue", "ring", "nut", "brand", "b1", "b22", "large", "xyzzy", "quux"]
    texts = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})
    q, c = texts[::3] + texts[:5], texts[1:]
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "norm string")
    w = M.gram_weights(frame(q).unionAll(frame(c)).groupBy("norm").agg(F.count("*").alias("copies")))
    vec: dict = {}
    for r in w.collect():
        vec.setdefault(r.norm, {})[r.gram] = r.w
    want = []
    for a in sorted(set(q)):
        sims = [(round(sum(x * vec[b][g] for g, x in vec[a].items() if g in vec[b]), 7), b) for b in sorted(set(c)) if set(vec[a]) & set(vec[b])]
        want += [(a, b, s) for s, b in sorted(sims, key=lambda x: (-x[0], x[1]))[:4]]
    for block in ((3, 7), (1_000, 20_000)):
        got = M.nearest_norms(frame(q), frame(c), w, 4, block=block, tasks=4)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rare_and_frequent_grams_add_up():
    import pyarrow as pa
    rng = random.Random(1)
    side = lambda n, at: [(at + i, sorted(rng.sample(range(40), 6))) for i in range(n)]
    table = lambda rows: pa.table({"n": pa.array([r[0] for r in rows], pa.int64()), "grams": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                                   "w": pa.array([[.1 + g / 100 for g in r[1]] for r in rows], pa.list_(pa.float64()))})
    q, c = side(30, 0), side(50, 100)
    for dense_bytes in (1, 8 * 50 * 10, 1 << 20):          # one, ten and all columns dense
        out = M._nearest_in_block(5, 7, dense_bytes)(table(q), table(c)).to_pylist()
        for (n, grams), row in zip(q, out):
            sims = [(-int(np.floor(sum((.1 + g / 100) ** 2 for g in set(grams) & set(h)) * 1e7 + .5)), m) for m, h in c if set(grams) & set(h)]
            assert row["q"] == n and sorted((t["n"], t["c"]) for t in row["top"]) == sorted(sims)[:5]


def test_links_are_solved_once(spark):
    rows = [(f"g{i}", f"s{i + j}", .5 + j / 10, 3) for i in range(40) for j in (0, 1)]
    links = M.assign_links(spark.createDataFrame(rows, "group string, series_id string, score double, gap_days int"))
    assert "InPandas" not in plan(links) and "InArrow" not in plan(links)
    assert Counter(r.tier for r in links.collect()) == {"5_handover_short_gap": 40}


def test_neighbours_are_numbers_until_the_last_join(spark, tmp_path):
    """Blocks hand on one number a neighbour, and what only they read is deleted once the neighbours are written."""
    texts = [f"nut {i} ring {i % 3} bolt" for i in range(12)]
    frame = spark.createDataFrame([(t,) for t in texts], "norm string")
    w = M.gram_weights(frame.groupBy("norm").agg(F.count("*").alias("copies")))
    before = len(session._settled)
    pairs, places = M.nearest_places(frame, frame, w, 3, block=(2, 5), tasks=4)
    assert dict(pairs.dtypes) == {"q": "bigint", "c": "bigint", "sim": "double"}
    assert sorted(r.norm for r in places.orderBy("n").collect()) == [r.norm for r in places.orderBy("n").collect()] == sorted(texts)
    left = [p.rsplit("/", 1)[1].split("-")[1] for p in session._settled[before:]]
    assert "nearest" in left and not {"grams", "gram_numbers", "vectors"} & set(left)
    best = pairs.groupBy("q").agg(F.max_by("c", "sim").alias("c")).collect()
    assert len(best) == 12 and all(r.q == r.c for r in best)


def test_blocked_candidates_equal_a_plain_ranking(spark):
    rng = random.Random(8)
    words = ["red", "blue", "ring", "nut", "brand", "large", "xyzzy"]
    groups = sorted({" ".join(rng.sample(words, 3)) for _ in range(15)})
    rows = sorted({(f"p{rng.randrange(25)}", " ".join(rng.sample(words, rng.randint(2, 4)))) for _ in range(60)})
    rows += [(f"p{i}", f"{n.upper()}") for i, (_, n) in enumerate(rows[:20])]      # other names of the same text
    g, c = spark.createDataFrame([(x,) for x in groups], "group string"), spark.createDataFrame(rows, "product_id string, name string")
    names = M.name_table(g.select(F.col("group").alias("name")).unionByName(c.select("name")))
    norm = {r.name: r.norm for r in names.collect()}
    near = M.nearest_norms(*[spark.createDataFrame([(norm[x],) for x in xs], "norm string") for xs in (groups, [n for _, n in rows])],
                           M.gram_weights(spark.createDataFrame([(norm[x],) for x in groups + [n for _, n in sorted(set(rows))]], "norm string")
                                          .groupBy("norm").agg(F.count("*").alias("copies"))), 7).collect()
    want = []
    for group in groups:
        sims = {r.c: r.sim for r in near if r.q == norm[group]}
        ranked = sorted((-sims[norm[n]], norm[n], p, n) for p, n in set(rows) if norm[n] in sims)[:7]
        seen: dict = {}
        for s, _, p, n in ranked:
            seen.setdefault(p, (n, -s))
        want += [(group, p, n, round(s, 6), i + 1) for i, (p, (n, s)) in enumerate(list(seen.items())[:4])]
    got = M.blocked_candidates(g, c, names, top_names=7, top_ids=4)
    assert sorted((r.group, r.product_id, r.candidate_name, round(r.cosine, 6), r.place) for r in got.collect()) == sorted(want)


def test_grams_are_never_broadcast(spark):
    """The texts are small, their grams are not; neither side of the join with the frequencies may go to the driver."""
    docs = spark.createDataFrame([(f"nut {i} ring",) for i in range(30)], "norm string").groupBy("norm").agg(F.count("*").alias("copies"))
    w = M.gram_weights(docs)
    w.collect()
    assert "Broadcast" not in plan(w)
    sizes = w.groupBy("norm").agg(F.sum(F.col("w") * F.col("w")).alias("s")).collect()
    assert len(sizes) == 30 and all(abs(r.s - 1) < 1e-9 for r in sizes)
