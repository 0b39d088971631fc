"""The auction against an exact solver, and first-come names against a plain loop."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfline import fixed_values as V
from shelfline.operators import auction, matching as M


def solve_in_chunks(rows, n_chunks, resolution=10 ** 6, shrink=64):
    """The phases and rounds of the auction over chunks of bidders, without Spark."""
    groups, ids = ({x: i for i, x in enumerate(sorted({r[k] for r in rows}))} for k in (0, 1))
    big, unit = (len(groups) + 1) * (resolution + 1), len(groups) + len(ids) + 1
    ways = {}
    for g, s, v in rows:
        worth = (big + round(v * resolution)) * unit
        ways.setdefault(2 * groups[g], []).append((2 * ids[s], worth))
        ways.setdefault(2 * ids[s] + 1, []).append((2 * groups[g] + 1, worth))
    for i in groups.values():
        ways[2 * i].append((2 * i + 1, 0))
    for i in ids.values():
        ways[2 * i + 1].append((2 * i, 0))
    chunks = [{b: w for b, w in ways.items() if b % n_chunks == k} for k in range(n_chunks)]
    price, step = {}, big * unit // shrink
    while True:
        holder, bids = {}, {0: None}
        while bids:
            bids = {}
            for chunk in chunks:
                p, h = dict(price), dict(holder)
                for r in auction.bid(chunk, p, h, step):
                    bids[r] = max(bids.get(r, (-1, -1)), (p[r], h[r]))
            price.update({r: b[0] for r, b in bids.items()})
            holder.update({r: b[1] for r, b in bids.items()})
        if step == 1:
            break
        step = max(1, step // shrink)
    back = [{v: k for k, v in d.items()} for d in (groups, ids)]
    return {(back[0][h // 2], back[1][r // 2]) for r, h in holder.items() if r % 2 == 0 and h % 2 == 0}


@pytest.mark.parametrize("seed", range(12))
def test_bids_in_chunks_are_exact(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 14), rng.randint(1, 10)
    rows = sorted({(g, rng.randrange(m)): rng.choice([0.5, round(rng.random(), 3)]) for g in range(n) for _ in range(3)}.items())
    rows = [(g, s, v) for (g, s), v in rows]
    worth = {(g, s): v for g, s, v in rows}
    best = M._assign(pd.DataFrame(rows, columns=["group", "series_id", "score"]))
    got = solve_in_chunks(rows, rng.choice([1, 2, 3]))
    assert len(got) == len({g for g, _ in got}) == len({s for _, s in got}) == len(best)
    assert sum(worth[p] for p in got) == pytest.approx(best.score.sum())


def test_links_of_large_and_small_components(spark):
    rng = random.Random(2)
    rows = [(f"g{i:02}", f"s{j}", 0.5 if rng.random() < .5 else round(rng.random(), 3), 3) for i in range(24) for j in (i * 2 // 3, i * 2 // 3 + 1)]
    rows += rows[:3] + [("alone", "s99", 0.4, 30), ("other", "s99", 0.7, 3)]
    df = spark.createDataFrame(rows, "group string, series_id string, score double, gap_days int")
    best = M._assign(pd.DataFrame(sorted(set(rows)), columns=["group", "series_id", "score", "gap_days"]))
    for kw in ({"small": 10}, {"small": 10, "chunk_links": 110}, {}):
        got = M.assign_links(df.distinct() if not kw else df, **kw).collect()
        assert len({r.group for r in got}) == len({r.series_id for r in got}) == len(got) == len(best)
        assert sum(r.score for r in got) == pytest.approx(best.score.sum())
        assert {r.tier for r in got if r.series_id == "s99"} == {"5_handover_short_gap"}
    assert M.assign_links(df.where("false")).count() == 0
    assert auction.auction(df.where("false").withColumn("component", F.lit("c"))).count() == 0


def test_first_come_names_equal_a_loop(spark):
    rng = random.Random(4)
    days = {f"n{i}": sorted({d for _ in range(rng.randint(1, 3)) for d in [rng.randrange(400)] * rng.randint(1, 2)} | {i // 2}) for i in range(300)}
    mapped = [(n, rng.choice(["a", "a", "a", "b", None]), rng.choice(list(V.METHOD_RANK)) + rng.choice(["", "+4_trunc_link"])) for n in days]
    pre = [(n, d, k) for n, own in days.items() for d in own for k in range(1 + len(n) % 2)]
    start = F.lit("2020-01-01").cast("date")
    dates = spark.createDataFrame(pre, "name string, d int, k int").select("name", F.date_add(start, "d").alias("date"))
    out = {r.name: r for r in M.one_name_per_day(spark.createDataFrame(mapped, "name string, series_id string, method string"), dates).collect()}
    size, busy, lost = {n: sum(p[0] == n for p in pre) for n in days}, {}, []
    for n, s, m in sorted(mapped, key=lambda x: (V.METHOD_RANK[x[2].split("+")[0]], -size[x[0]], x[0])):
        own = busy.setdefault(s, set())
        if own & set(days[n]):
            lost.append(n)
        else:
            own |= set(days[n])
    assert {n for n, r in out.items() if "demoted" in r.method} == set(lost) and len(out) == len(mapped)
    assert [out[n].series_id for n in sorted(lost)] == [f"d_{i:04}" for i in range(len(lost))]


def test_components_of_a_chunk_need_no_rounds(spark, monkeypatch):
    """Many components that fit into a chunk, together far more than one: none of them is cut up."""
    rng = random.Random(9)
    rows = [(f"c{c}", f"g{c}-{i}", f"s{c}-{i * 2 // 3 + j}", round(rng.random(), 3)) for c in range(30) for i in range(9) for j in (0, 1)]
    df = spark.createDataFrame(rows, "component string, group string, series_id string, score double")
    monkeypatch.setattr(auction, "_round", lambda *_: pytest.fail("a component of one chunk was cut up"))
    got = auction.auction(df, chunk_links=100).collect()
    best = [M._assign(pd.DataFrame([r[1:] for r in rows if r[0] == c], columns=["group", "series_id", "score"])) for c in {r[0] for r in rows}]
    assert len(got) == len({r.group for r in got}) == len({r.series_id for r in got}) == sum(map(len, best))
    assert sum(r.score for r in got) == pytest.approx(sum(b.score.sum() for b in best))
