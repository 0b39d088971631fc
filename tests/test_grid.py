"""Next observations and pack segments against plain loops; no frame of a window may run to the end of its key."""
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfline.operators import grid as G


def no_frame_to_the_end(df):
    """A frame from a row to the end of its key is run through anew for every row."""
    frames = re.findall(r"specifiedwindowframe\(RowFrame, (.+?), (.+?)\)\)", df._jdf.queryExecution().analyzed().toString())
    return frames and not [f for f in frames if "unboundedfollowing" in f[1] and "unboundedpreceding" not in f[0]]


@pytest.fixture(scope="module")
def cells():
    rng = random.Random(4)
    return sorted({(f"s{rng.randrange(6)}", rng.randrange(1, 200)): rng.choice([None, 1.0, 2.5, 3.0]) for _ in range(300)}.items())


def test_next_observation_equals_a_loop(spark, cells):
    rng = random.Random(9)
    probes = [(f"s{rng.randrange(8)}", i, rng.randrange(0, 220)) for i in range(80)]
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), F.col(c).cast("int"))
    seen = spark.createDataFrame([(*k, p) for k, p in cells], "series_id string, d int, price double").select("series_id", day("d").alias("date"), "price")
    probe = spark.createDataFrame(probes, "series_id string, i int, d int").select("series_id", "i", day("d").alias("last"))
    found = G.next_observation(probe, seen, ["series_id"], "last")
    assert no_frame_to_the_end(found)
    got = {r.i: (r.n, r.next_price) for r in found.select("i", F.datediff("next_date", F.lit("2020-01-01")).alias("n"), "next_price").collect()}
    assert got == {i: min(((d, p) for (s, d), p in cells if s == key and d > after and p is not None), default=(None, None)) for key, i, after in probes}


def test_pack_segments_equal_a_loop(spark, cells):
    rows = spark.createDataFrame([(*k, p) for k, p in cells], "series_id string, d int, p double").select(
        F.lit("x").alias("store"), "series_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), "d", F.col("p").cast("string").alias("pack_key"))
    out = G.pack_segments(rows)
    assert no_frame_to_the_end(out)
    want = {}
    for key in {k[0] for k, _ in cells}:
        held, n, first = None, 1, next(p for (s, _), p in cells if s == key and p is not None)
        for (s, d), p in cells:
            if s == key:
                now = p if p is not None else held if held is not None else first
                n += held is not None and now != held
                held, want[key, d] = now, n
    assert {(r.series_id, r.d): r.pack_segment for r in out.collect()} == want


def test_grid_is_dealt_by_observations(spark):
    """A task's rows follow the number of observations, not Spark's guess by compressed bytes; the grid stays the same."""
    rng = random.Random(6)
    rows = sorted({(f"s{i}", rng.randrange(0, 90)): rng.choice([1.0, 2.0, 1.5]) for i in range(40) for _ in range(25)}.items())
    obs = spark.createDataFrame([(*k, p) for k, p in rows], "segment_id string, d int, shelf_price double").select(
        F.lit("x").alias("store"), "segment_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), "shelf_price")
    dealt, whole = G.causal_grid(obs, task_rows=100), G.causal_grid(obs)
    assert "hashpartitioning(store#" in (plan := dealt._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan
    assert dealt.select(F.spark_partition_id()).distinct().count() > 4
    assert whole.select(F.spark_partition_id()).distinct().count() == 1
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
